"""Recordings and their position samples: the accuracy report and the fleet KPIs.

Samples are always reduced per recording before they meet the recordings, so the join is
one row to one row and moves the aggregate, not the samples.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.functions import scalars as S

# How samples name their recording; a source with unique file names may leave the device out
KEYS = ("device_id", "file_name")

# Accuracy buckets in metres, conditions and labels of the accuracy report
BUCKETS = (("le_2", 2.0), ("le_3_5", 3.5), ("le_6", 6.0), ("le_10", 10.0))
NO_GPS_LABEL = "No GPS"
VERSION_CHANGED = "OTA Updated"
NO_GPS_MARK = "91.0000_181.0000"


def conditions() -> list[tuple[str, Column]]:
    """The three named conditions of the report (FLT-05); a NULL fails."""
    on = F.col("ignition_status") == 1
    return [("cond1", on & (F.col("uptime") > 300)), ("cond2", on & (F.col("max_speed") > 5)), ("cond3", on)]


def apply_conditions(df: DataFrame, named: Sequence[tuple[str, Column]] | None = None) -> DataFrame:
    """FLT-05: one row per condition a row meets, in one pass over the input."""
    tags = F.array(*[F.when(rule, F.lit(name)) for name, rule in named or conditions()])
    return df.withColumn("condition", F.explode(F.filter(tags, lambda t: t.isNotNull())))


def _within(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be {low} .. {high}")
    return value


def window_filter(
    df: DataFrame,
    hours: int | None = None,
    start: str | None = None,
    end: str | None = None,
    device: str | None = None,
    version: str | None = None,
    now: Column | None = None,
    ts: str = "start_time",
) -> DataFrame:
    """FLT-01: rolling hours (1 .. 2160) or explicit inclusive bounds, plus device and version.

    Bounds are literals of the column's own type, so they reach the scan.
    """
    kind = df.schema[ts].dataType
    out = df
    if start or end:
        if start:
            out = out.filter(F.col(ts) >= F.lit(start.strip()).cast(kind))
        if end:
            text = end.strip()
            out = out.filter(F.col(ts) <= F.lit(text + " 23:59:59" if len(text) == 10 else text).cast(kind))
    else:
        span = _within("hours", hours if hours is not None else 24, 1, 2160)
        base = now if now is not None else F.current_timestamp()
        out = out.filter(F.col(ts) >= (base - F.expr(f"INTERVAL {span} HOURS")).cast(kind))
    if device:
        out = out.filter(F.col("device_id") == device.strip())
    if version:
        out = out.filter(F.col("ota") == version.strip())
    return out


def before_inclusive_end(df: DataFrame, end: str, ts: str = "start_time") -> DataFrame:
    """FLT-02: keep rows up to an inclusive end, as one half-open comparison."""
    text, step = S.inclusive_end(end)
    bound = (F.lit(text).cast("timestamp") + F.expr(step)).cast(df.schema[ts].dataType)
    return df.filter(F.col(ts) < bound)


# ── per recording ────────────────────────────────────────────────────────────


def sample_agg(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """AGG-01 .. AGG-03: one row per recording from its samples."""
    acc, valid = F.col("accuracy"), F.coalesce(F.col("valid") == 1, F.lit(False))
    known = acc.isNotNull()

    def texts(rule: Column) -> Column:
        # A recording holds about a minute of samples; its list is the report's column
        rows = F.array_sort(F.collect_list(F.when(known & rule, F.struct("seq_no", "accuracy"))))
        return F.array_join(F.transform(rows, lambda r: r["accuracy"].cast("string")), " - ")

    def first(name: str) -> Column:
        return F.min_by(F.col(name), F.when(valid & F.col(name).isNotNull(), F.col("seq_no"))).alias(f"first_{name}")

    return samples.groupBy(*keys).agg(
        F.count_if(known & valid).alias("acc_count"),
        F.count_if(known & ~valid).alias("invalid_acc_count"),
        *[F.count_if(known & valid & (acc <= limit)).alias(f"acc_{name}") for name, limit in BUCKETS],
        F.count_if(known & valid & (acc > 10)).alias("acc_gt_10"),
        F.avg(F.when(valid, acc)).alias("avg_accuracy"),
        F.max(F.when(valid, acc)).alias("max_accuracy"),
        F.min(F.when(valid & (acc > 0), acc)).alias("min_accuracy"),
        texts(valid).alias("acc_list"),
        texts(~valid).alias("inv_acc_list"),
        first("lat"), first("lon"), first("sample_ts"),
    )


def durations(df: DataFrame) -> DataFrame:
    """AGG-04: whole seconds and ms between start and end, never negative."""
    a, b = F.col("start_time").cast("timestamp"), F.col("end_time").cast("timestamp")
    return df.withColumns({
        "duration_sec": F.greatest(F.unix_timestamp(b) - F.unix_timestamp(a), F.lit(0)),
        "duration_ms": F.greatest(F.unix_millis(b) - F.unix_millis(a), F.lit(0)),
    })


def in_window(df: DataFrame, start: str | None, end: str | None, ts: str = "start_time") -> DataFrame:
    if start:
        df = df.filter(F.col(ts) >= F.lit(start).cast(df.schema[ts].dataType))
    return before_inclusive_end(df, end, ts) if end else df


def per_file(obs: DataFrame, samples: DataFrame, start: str | None = None, end: str | None = None,
             devices: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """JOI-01: recordings with their sample aggregate, both sides cut to the same window.

    The sample side is filtered on the start time it inherited from its recording, so both
    scans prune.  Unmatched recordings have NULL counts.
    """
    obs = in_window(obs, start, end)
    if "start_time" in samples.columns:
        samples = in_window(samples, start, end)
    if devices is not None:
        listed = devices.select("device_id").distinct()
        obs = obs.join(listed, "device_id", "left_semi")
        if "device_id" in keys:
            samples = samples.join(listed, "device_id", "left_semi")
    return durations(obs).join(sample_agg(samples, keys), list(keys), "left")


def gps_observation_report(files: DataFrame, label: str, tenants: DataFrame | None = None,
                           named: Sequence[tuple[str, Column]] | None = None) -> DataFrame:
    """AGG-05: per device and condition the accuracy shares, losses and extremes.

    Ignition counts come from all recordings of the device, not from the condition's.
    """
    ignition = files.groupBy("device_id").agg(
        F.count_if(F.col("ignition_status") > 0).alias("ign_high"),
        F.count_if(F.col("ignition_status") == 0).alias("ign_low"))
    n = F.coalesce(F.sum("acc_count"), F.lit(0))
    expected = F.coalesce(F.sum("duration_sec"), F.lit(0))
    invalid = F.coalesce(F.sum("invalid_acc_count"), F.lit(0))

    def share(part: Column, base: Column) -> Column:
        return F.coalesce(F.round(part * 100.0 / F.nullif(base, F.lit(0)), 2), F.lit(0.0))

    def text(value: Column) -> Column:
        return F.coalesce(F.round(value, 2).cast("string"), F.lit(NO_GPS_LABEL))

    report = apply_conditions(files, named).groupBy("condition", "device_id").agg(
        F.lit(label).alias("date_range"),
        S.single_or("ota", VERSION_CHANGED).alias("ota"),
        F.count(F.lit(1)).alias("obs_count"),
        *[share(F.coalesce(F.sum(f"acc_{b}"), F.lit(0)), n).alias(f"pct_{b}") for b, _ in BUCKETS],
        share(F.coalesce(F.sum("acc_gt_10"), F.lit(0)), n).alias("pct_gt_10"),
        share(invalid, expected).alias("gps_loss_pct"),
        share(F.count_if(F.contains(F.col("file_name").cast("string"), F.lit(NO_GPS_MARK))),
              F.count(F.lit(1))).alias("no_gps_pct"),
        expected.alias("expected_count"), n.alias("actual_count"), invalid.alias("invalid_count"),
        text(S.weighted_mean("avg_accuracy", "acc_count")).alias("avg_accuracy"),
        text(F.max("max_accuracy")).alias("max_accuracy"),
        text(F.min("min_accuracy")).alias("min_accuracy"),
    ).join(ignition, "device_id")
    if tenants is None:
        return report.withColumn("tenant", F.lit(""))
    return report.join(tenants, "device_id", "left").withColumn("tenant", F.coalesce("tenant", F.lit("")))


def gps_summary(files: DataFrame) -> DataFrame:
    """AGG-06: one report row per recording."""
    opt = [c for c in ("nw_source", "rssi", "sinr", "min_speed", "udid", "metadatastatus") if c in files.columns]
    epoch = F.col("nw_recorded_time") if "nw_recorded_time" in files.columns else F.lit(None).cast("bigint")
    return files.select(
        "device_id", "file_name",
        F.coalesce("acc_count", F.lit(0)).alias("accuracy_count"),
        F.coalesce("invalid_acc_count", F.lit(0)).alias("invalid_accuracy_count"),
        "start_time", F.coalesce("duration_ms", F.lit(0)).alias("duration"), "uptime", "ignition_status",
        epoch.alias("recorded_epoch"), S.epoch_text(epoch).alias("recorded_time"), *opt,
        F.coalesce("acc_list", F.lit("")).alias("accuracy"),
        F.coalesce("inv_acc_list", F.lit("")).alias("invalid_accuracy"),
        F.col("ota").alias("app_ver"), "max_speed", "avg_accuracy",
        F.col("first_lat").alias("latitude"), F.col("first_lon").alias("longitude"),
        F.col("first_sample_ts").alias("timestamp"))


# ── fleet KPIs (recordings may repeat a key: files are collapsed first) ──────


def _rows(df: DataFrame, where: Column | None) -> DataFrame:
    return df if where is None else df.filter(where)


def files_of(obs: DataFrame, keep: Sequence[str] = ("ota",)) -> DataFrame:
    """One row per (device, file); a repeated key keeps its smallest values (JOI-02)."""
    return obs.groupBy("device_id", "file_name").agg(
        *[F.min(c).alias(c) for c in keep],
        F.min("start_time").alias("min_start"), F.max("start_time").alias("max_start"))


def sample_counts(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("pts"))


def files_with_counts(obs: DataFrame, samples: DataFrame, where: Column | None = None,
                      keep: Sequence[str] = ("ota",), keys: Sequence[str] = KEYS, samples_where: Column | None = None) -> DataFrame:
    """JOI-02: distinct recordings with the number of their samples, 0 without any.

    ``samples_where`` is the same window in the columns of the samples (start time, device), here and below: it reaches
    their scan, which a predicate on recordings can't.
    """
    files = files_of(_rows(obs, where), keep)
    return (files.join(sample_counts(_rows(samples, samples_where), keys), list(keys), "left")
            .withColumn("pts", F.coalesce("pts", F.lit(0))))


def obs_with_samples(obs: DataFrame, samples: DataFrame, where: Column | None = None, samples_where: Column | None = None,
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """JOI-03: samples of the recordings that meet a predicate; file names may repeat over devices, so both keys count."""
    extra = [c for c in samples.columns if c not in ("device_id", "file_name", "start_time")]
    return _rows(obs, where).join(_rows(samples, samples_where).select(*keys, *extra), list(keys))


def gps_kpis(obs: DataFrame, samples: DataFrame, where: Column | None = None, expected: int = 60,
             levels: Sequence[str] = ("fleet", "device", "version"), keys: Sequence[str] = KEYS, samples_where: Column | None = None) -> DataFrame:
    """AGG-07: accuracy KPIs for the fleet, per device and per version from one pass (grouping sets)."""
    n = _within("expected", expected, 1, 600)
    acc = F.col("accuracy")
    points = _rows(samples, samples_where).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pts"), F.count_if(acc > 0).alias("valid_acc"),
        F.count_if(acc.isNull() | (acc <= 0)).alias("invalid_acc"),
        *[F.count_if((acc > 0) & (acc <= limit)).alias(name) for name, limit in BUCKETS],
        F.count_if(acc > 10).alias("gt_10"), F.sum(F.when(acc > 0, acc)).alias("acc_sum"))
    counts = ["pts", "valid_acc", "invalid_acc", *[b for b, _ in BUCKETS], "gt_10"]
    joined = files_of(_rows(obs, where)).join(points, list(keys), "left")
    sets = {"fleet": [], "device": [F.col("device_id")], "version": [F.col("ota")]}
    total = F.count(F.lit(1)) * n
    missing = F.greatest(total - F.coalesce(F.sum("valid_acc"), F.lit(0)), F.lit(0))
    out = joined.groupingSets([sets[x] for x in levels], "device_id", "ota").agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("file_count"), F.count_if(F.col("pts") > 0).alias("files_with_samples"),
        F.min("min_start").alias("min_start_time"), F.max("max_start").alias("max_start_time"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
        (F.sum("acc_sum") / F.nullif(F.sum("valid_acc"), F.lit(0))).alias("avg_accuracy"),
        total.alias("expected_count"), missing.alias("missing_count"),
        (missing * 100.0 / total).alias("gps_loss_pct"))
    named = out.withColumn("level", F.when(F.col("gid") == 3, "fleet").when(F.col("gid") == 1, "device")
                           .otherwise("version"))
    key = F.when(F.col("gid") == 1, F.col("device_id")).when(F.col("gid") == 2, F.col("ota"))
    named = named.withColumn("group_key", key)
    # Groups without a name are left out; the fleet row has none by nature
    keep = (F.col("gid") == 3) | (F.coalesce("group_key", F.lit("")) != "")
    return named.filter(keep).drop("gid", "device_id", "ota")


def _frames() -> Column:
    text = F.col("num_frames_out")
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def _frames_per_file(obs: DataFrame, samples: DataFrame, where: Column | None, keys: Sequence[str],
                     samples_where: Column | None) -> DataFrame:
    files = files_with_counts(obs, samples, where, ("num_frames_out",), keys, samples_where)
    return files.select(
        "device_id", "file_name", F.col("min_start").alias("start_time"),
        F.coalesce(_frames(), F.nullif("pts", F.lit(0)), F.lit(0).cast("bigint")).alias("observed_frames"),
        F.when(F.coalesce(~F.col("num_frames_out").rlike("^[0-9]+$"), F.lit(True)) & (F.col("pts") == 0), 1)
        .otherwise(0).alias("missing_signal"))


def video_loss(obs: DataFrame, samples: DataFrame, where: Column | None = None, expected: int = 60,
               keys: Sequence[str] = KEYS, samples_where: Column | None = None) -> DataFrame:
    """AGG-08: frames seen against frames expected over all recordings."""
    n = _within("expected", expected, 1, 600)
    total = F.count(F.lit(1)) * n
    missing = F.greatest(total - F.coalesce(F.sum("observed_frames"), F.lit(0)), F.lit(0))
    return _frames_per_file(obs, samples, where, keys, samples_where).agg(
        F.count(F.lit(1)).alias("file_count"), F.min("start_time").alias("min_start_time"),
        F.max("start_time").alias("max_start_time"), F.sum("observed_frames").alias("observed_total"),
        total.alias("expected_total"), missing.alias("missing_total"),
        F.sum("missing_signal").alias("rows_missing_signal"),
        (missing * 100.0 / F.nullif(total, F.lit(0))).alias("video_loss_pct"))


def loss_hotspots(obs: DataFrame, samples: DataFrame, where: Column | None = None, expected: int = 60,
                  k: int = 10, keys: Sequence[str] = KEYS, samples_where: Column | None = None) -> DataFrame:
    """TOP-01: the recordings that miss most frames, newest first on ties."""
    n = _within("expected", expected, 1, 600)
    miss = F.greatest(F.lit(n) - F.col("observed_frames"), F.lit(0))
    return (_frames_per_file(obs, samples, where, keys, samples_where)
            .select("device_id", "file_name", "start_time", "observed_frames", miss.alias("missing_frames"),
                    (miss * 100.0 / n).alias("missing_pct"))
            .orderBy(F.desc("missing_frames"), F.desc_nulls_last("start_time"), "device_id", "file_name").limit(k))


_HEALTH = ("ota", "ignition_status", "num_frames_out", "metadatastatus")


def session_health(obs: DataFrame, samples: DataFrame, where: Column | None = None,
                   keys: Sequence[str] = KEYS, samples_where: Column | None = None) -> DataFrame:
    """AGG-09: health of all recordings in one row."""
    f = files_with_counts(obs, samples, where, _HEALTH, keys, samples_where)
    return f.agg(
        F.count(F.lit(1)).alias("total_files"), F.countDistinct("device_id").alias("devices"),
        F.countDistinct("ota").alias("versions"), F.min("min_start").alias("earliest_start"),
        F.max("min_start").alias("latest_start"),
        F.count_if(F.col("ignition_status") == 1).alias("ignition_on"),
        F.count_if(F.col("ignition_status").isNull()).alias("ignition_null"),
        F.count_if(F.col("pts") > 0).alias("with_samples"),
        F.count_if(_frames().isNotNull()).alias("with_frames"),
        F.round(F.avg(F.coalesce(_frames(), F.lit(0))), 1).alias("avg_frames"),
        F.count_if(F.col("metadatastatus") == "full").alias("full_metadata"),
        F.count_if(F.col("metadatastatus") == "").alias("empty_metadata"))


def session_health_by_device(obs: DataFrame, samples: DataFrame, where: Column | None = None,
                             n: int = 20, keys: Sequence[str] = KEYS, samples_where: Column | None = None) -> DataFrame:
    """AGG-10: health per device and version, the n with most recordings."""
    f = files_with_counts(obs, samples, where, _HEALTH, keys, samples_where).filter(F.col("device_id") != "")
    out = f.groupBy("device_id", "ota").agg(
        F.count(F.lit(1)).alias("file_count"), F.min("min_start").alias("first_session"),
        F.max("min_start").alias("last_session"),
        F.count_if(F.col("ignition_status") == 1).alias("ignition_on"),
        F.count_if(F.col("pts") > 0).alias("with_samples"),
        F.count_if(_frames().isNotNull()).alias("with_frames"),
        F.round(F.avg(F.coalesce(_frames(), F.lit(0))), 1).alias("avg_frames"),
        F.count_if(F.col("metadatastatus") == "full").alias("full_metadata"))
    return out.orderBy(F.desc("file_count"), "device_id", "ota").limit(_within("n", n, 1, 100))


def sample_overview(obs: DataFrame, samples: DataFrame, where: Column | None = None,
                    keys: Sequence[str] = KEYS, samples_where: Column | None = None) -> DataFrame:
    """AGG-11: recordings with samples, sample totals and the speed range."""
    points = _rows(samples, samples_where).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pts"), F.count_if(F.col("valid") == 1).alias("valid_pts"),
        F.min("speed").alias("lo"), F.max("speed").alias("hi"))
    files = _rows(obs, where).select("device_id", "file_name").distinct()
    return files.join(points, list(keys), "left").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("pts") > 0).alias("files_with_samples"),
        F.coalesce(F.sum("pts"), F.lit(0)).alias("samples"),
        F.coalesce(F.sum("valid_pts"), F.lit(0)).alias("valid_samples"),
        F.min("lo").alias("min_speed"), F.max("hi").alias("max_speed"))


def observation_overview(obs: DataFrame, where: Column | None = None) -> DataFrame:
    """AGG-12: rows, time range, frame texts, devices and versions."""
    return _rows(obs, where).agg(
        F.count(F.lit(1)).alias("total_rows"), F.min("start_time").alias("min_start_time"),
        F.max("start_time").alias("max_start_time"),
        F.count("num_frames_out").alias("rows_with_frames"),
        F.countDistinct("device_id").alias("devices"), F.countDistinct("ota").alias("versions"))


def top_devices(df: DataFrame, n: int) -> DataFrame:
    """AGG-13: devices with most rows, unnamed ones left out."""
    return (df.filter(F.col("device_id") != "").groupBy("device_id").agg(F.count(F.lit(1)).alias("rows_count"))
            .orderBy(F.desc("rows_count"), "device_id").limit(n))


def files_per_day(obs: DataFrame) -> DataFrame:
    """AGG-14: recordings per calendar day."""
    return obs.groupBy(F.to_date("start_time").alias("day")).agg(F.count(F.lit(1)).alias("files"))


def table_health(df: DataFrame) -> DataFrame:
    """FLT-08: counts of rows with missing key facts."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  F.count_if(F.col("start_time").isNull()).alias("null_start_time"),
                  F.count_if(F.col("device_id") == "").alias("empty_device_id"),
                  F.count_if(F.col("num_frames_out").isNull()).alias("null_frames"))


def capped_groups(df: DataFrame, n: int, count: str, key: str) -> DataFrame:
    """TOP-02: the n largest groups, with the number of all groups and whether some are missing."""
    total = df.agg(F.count(F.lit(1)))
    return (df.orderBy(F.desc(count), key).limit(n).withColumn("total_groups", total.scalar())
            .withColumn("truncated", F.col("total_groups") > n))


# ── documents ────────────────────────────────────────────────────────────────


def explode_samples(docs: DataFrame, array: str = "samples", parent: Mapping[str, str] | None = None) -> DataFrame:
    """PRJ-03: sample rows of documents; positions count all elements, NULL elements are skipped."""
    keep = parent or {c: c for c in ("device_id", "file_name", "start_time", "end_time")}
    rows = docs.select(*[F.col(v).alias(k) for k, v in keep.items()], F.posexplode(array).alias("seq_no", "__s"))
    return rows.filter(F.col("__s").isNotNull()).select(*keep, "seq_no", "__s.*")


#: Members of the processing sections that are no models.
_NOT_INWARD = ("annotation_image_scale", "annotation_driver_side", "process_fps", "drop_packet", "nrt_code_version", "frame_rate", "annotation_start_idx",
               "frames_processed_info", "process_rate", "annotation_driving_side")
_NOT_OUTWARD = ("peak_intensity", "locale", "frameRate", "highg_thread_retries", "localSpeedUnit", "videoDelay", "splitVideoMode", "dnnSubsampleFactor",
                "lowg_thread_retries", "module", "highg_classification_enabled", "lowg_classification_enabled", "numFrames", "laneCalSuccess",
                "objTrackerMinTrackLength")
_NOT_DMS = ("nrt_code_version", "privacy", "frame_rate", "process_fps", "drop_packet", "frames_processed_info", "process_rate")


def project_observation(docs: DataFrame, narrow: bool = False) -> DataFrame:
    """PRJ-01 / PRJ-02: flat recording columns out of the nested document (``readers.OBSERVATION_SCHEMA``).

    Structured members stay compact JSON text, numbers that are none give NULL, and lists of models are sorted.  ``file_name`` is the
    video's name without its extension, ``current_videoname`` the whole.  ``path``, ``product_line`` and ``trigger_hash`` of the caller's are taken where
    ``docs`` has them.  The narrow form is the same select with fewer columns; the reader prunes the rest.
    """
    inf = lambda path: F.get_json_object("inference_data", f"$.{path}")
    mode = lambda name: F.get_json_object("deviceModes", f"$.{name}")
    own = lambda name: F.col(name) if name in docs.columns else F.lit(None).cast("string")
    n_keys = lambda c: F.coalesce(F.size(F.json_object_keys(c)), F.lit(0))
    n_rows = lambda c: F.coalesce(F.json_array_length(c), F.lit(0))
    models = lambda section, skip: F.coalesce(S.keys_except(inf(section), skip), F.array().cast("array<string>"))
    processed = lambda kind: S.any_contains(F.from_json(inf("observations_data.module"), "array<string>"), kind)
    joined = lambda name: F.coalesce(F.array_join(F.filter(F.transform(F.from_json("irled_states", f"array<struct<{name}:string>>"), lambda x: x[name]),
                                                           lambda x: x.isNotNull()), ","), F.lit(""))

    def alerts(section: str, **fields: str) -> Column:
        """Some members of a section's alerts as JSON text; members without a value are null."""
        rows = F.from_json(inf(f"{section}.alerts"), "array<struct<" + ",".join(f"{x}:string" for x in fields.values()) + ">>")
        cut = F.transform(F.filter(rows, lambda a: a.isNotNull()), lambda a: F.struct(*[a[x].alias(n) for n, x in fields.items()]))
        return F.coalesce(F.to_json(cut, {"ignoreNullFields": "false"}), F.lit("[]"))

    cols = {
        "device_id": F.col("deviceId").cast("string"),
        "file_name": F.regexp_replace("videoName", r"\.[A-Za-z0-9]+$", ""),
        "ota": F.col("app_ver"),
        "start_time": S.epoch_to_timestamp("startTime"),
        "end_time": S.epoch_to_timestamp("endTime"),
        "ignition_status": S.to_int(mode("ignition_status"), 64),
        "uptime": S.to_int("systemUpTime", 64),
    }
    if not narrow:
        speeds = F.transform("videoMetaData", lambda m: m["speed"])
        stamp = F.regexp_extract("videoName", r"_(\d{13})_", 1).try_cast("long")
        cols |= {
            "product_line": own("product_line"), "trigger_hash": own("trigger_hash"), "s3_path": own("path"), "udid": F.col("udid"),
            "file_timestamp": F.when(stamp.between(0, S.LAST_EPOCH_MS), stamp),
            "service_uptime": S.to_int("serviceUpTime", 64), "privacymode": S.to_int(mode("privacymode"), 64), "dismode": mode("disMode"),
            "voltage": S.to_float(F.col("`Voltage in Volts`")), "processing_mode": S.to_int(mode("processing_mode"), 64),
            "inertial_processed": processed("inertial"), "vision_processed": processed("vision"), "inward_vision_processed": processed("inward_vision"),
            "nrt_status": F.col("NRT_STATUS"), "tripno": F.col("tripNo"),
            "sample_count": F.coalesce(F.size("videoMetaData"), F.lit(0)),
            "videometadatastatus": F.coalesce(F.size("videoMetaData"), F.lit(0)),
            "min_speed": S.array_low(speeds), "max_speed": S.array_high(speeds), "speed_data": F.lit(None).cast("string"),
            "sensormetadata_count": n_rows("sensorMetaData"), "driverinvariantsession": F.col("driverInvariantSession"),
            "driverid": F.element_at(F.split(F.nullif(F.get_json_object("driverId", "$[0]"), F.lit("")), ": "), -1),
            "vehclass": F.col("vehClass"), "vehicleid": F.col("vehicleId"), "cameras": S.to_int("cameras", 64),
            "prevvideoname": F.col("prevVideoName"), "current_videoname": F.col("videoName"), "nextvideoname": F.col("nextVideoName"),
            "devicemodes_itemscount": n_keys("deviceModes"), "inference_data_itemscount": n_keys("inference_data"),
            "canmetadata": F.coalesce(inf("observations_data.canMetaData"), F.lit("[]")),
            "alerts_data_num_alerts": S.to_int(inf("alerts_data.num_alerts"), 64), "alerts_data": alerts("alerts_data", uuid="uuid"),
            "audio_events_num_alerts": S.to_int(inf("audio_events.num_alerts"), 64),
            "audio_events_data": alerts("audio_events", uuid="uuid", event_code="event_code", playback_reason="reason", playback_success="playback_success"),
            "events_data_num_alerts": S.to_int(inf("events_data.num_alerts"), 64),
            "events_data": alerts("events_data", uuid="uuid", event_code="event_code", description="description", event_initialization_time="event_initialization_time"),
            "num_alerts": S.to_int(inf("events_data.num_alerts"), 64),
            "metadatastatus": F.coalesce(F.col("metadataStatus"), F.lit("full")),
            "starttime": F.col("startTime").cast("string"), "starttimeld": F.col("startTimeLd"), "inwardstarttime": F.col("inwardStartTime"),
            "inwardstarttimeld": F.col("inwardStartTimeLd"),
            "rssi": S.to_int("networkInfo.rssi", 64), "sinr": S.to_float("networkInfo.sinr"),
            "nw_source": F.col("networkInfo.rat"), "nw_recorded_time": F.col("networkInfo.recordedTime"),
            "vin": F.col("vin"), "can_firmware_ver": F.col("can_firmware_ver"), "offset": F.col("offset"),
            **{n: F.coalesce(n, F.lit("{}")) for n in ("session_embedding", "burst_mode", "fuel_report")},
            "can_src": F.col("can_src"), "can_sn": F.col("can_sn"), "engine_status": F.col("engine_status"),
            "protocol_info": inf("observations_data.protocol_info"), "idling_report": F.coalesce(inf("observations_data.idling_report"), F.lit("{}")),
            "tc_recommendation": inf("video_data.transcode_recommendation"),
            "num_frames_out": S.to_int(inf("observations_data.numFrames"), 64),
            "num_frames_in": S.to_int(inf("inward.frames_processed_info.num_frames_processed"), 64),
            "num_frames_dms": S.to_int(inf("dms.frames_processed_info.num_frames_processed"), 64),
            "inward_models_processed": models("inward", _NOT_INWARD), "outward_models_processed": models("observations_data", _NOT_OUTWARD),
            "dms_models_processed": models("dms", _NOT_DMS),
            "is_inward_processed": inf("is_inward_processed_on_device").try_cast("boolean"), "is_dms_processed": inf("is_dms_processed_on_device").try_cast("boolean"),
            "irled_status": F.col("irled_status"), "irled_states_timestamp": joined("time"), "irled_states_status": joined("status"),
            "faceImageCaptured": inf("faceImageCaptured").try_cast("boolean"),
            "obs_filetype": F.when(S.has_key("inference_data", "observations_data"), "Observation").otherwise("Metadata"),
            "audioEnable": F.col("audioEnable"), "user_generated_alert": F.coalesce("user_generated_alert", F.lit("[]")),
            "rtc_valid": F.col("rtcValid"), "rtc_jump_from": F.col("rtc_jump_from"), "rtc_jump_to": F.col("rtc_jump_to"),
            "session_count": S.to_int("sessionCount", 64), "valid_gps_entries": S.to_int("validGPSEntries", 64),
            "gps_start_time": F.col("gpsStartTime"), "gps_end_time": F.col("gpsEndTime"),
            "idle": S.to_int(mode("idle"), 64), "obdformat": F.col("obdFormat"),
            "is_inward_cam_obstructed": inf("is_inward_cam_obstructed").try_cast("boolean"),
            "has_multi_lane": S.has_key(inf("observations_data"), "multiLane"),
            "has_road_boundary_tracks": S.has_key(inf("observations_data"), "roadBoundaryTracks"),
            "has_ipc_events": S.has_key(inf("inward"), "ipc_events"), "is_hd_file": S.has_key(inf("observations_data"), "carBoxTrackerListCompressed"),
            "inference_keys": S.keys_except("inference_data", ("alerts_data",)),
            "has_alerts": S.has_key("inference_data", "alerts_data"),
        }
    return docs.filter(F.coalesce("deviceId", F.lit("")) != "").select(*[c.alias(n) for n, c in cols.items()])
