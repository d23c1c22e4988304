"""Critical events: scans, dashboards, staging report, priority map upkeep."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tripline.functions import scalars as S
from tripline.functions import text as X
from tripline.operators.lists import SEGMENT, segmented_lists

# Columns of the event table
COLUMNS = {
    "device_id": "string", "ts": "timestamp", "process_name": "string", "code": "double", "code_aux": "bigint",
    "cnt": "bigint", "description": "string", "version": "string", "sys_uptime": "double", "s3_path": "string",
    "tenant_id": "bigint", "type": "string", "priority": "string",
}


def known_columns(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """The event table's columns; the ones the source lacks are NULL."""
    want = columns or COLUMNS
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in want.items()])


def _literal(df: DataFrame, ts: str, value: str) -> Column:
    return F.lit(value).cast(df.schema[ts].dataType)


def scan_events(df: DataFrame, start: str, end: str, ignored_codes: Sequence[float] = (),
                versions: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """SRC-01: events of [start, end) without ignored codes whose version contains an allowed text.

    With ignored codes a NULL code is dropped, as ``NOT IN`` does.
    """
    out = df.filter((F.col("ts") >= _literal(df, "ts", start)) & (F.col("ts") < _literal(df, "ts", end)))
    if ignored_codes:
        out = out.filter(~F.col("code").isin(*ignored_codes))
    if versions:
        rule = F.lit(False)
        for text in versions:
            rule = rule | F.contains("version", F.lit(text))
        out = out.filter(rule)
    out = known_columns(out)
    return out if limit is None else out.limit(limit)


def scan_events_exact(df: DataFrame, version: str, devices: Sequence[str] = (), start: str | None = None,
                      end: str | None = None, ordered: bool = True) -> DataFrame:
    """SRC-02: events of one version, by process, code and newest first."""
    out = df.filter(F.col("version") == version)
    if devices:
        out = out.filter(F.col("device_id").isin(*devices))
    if start:
        out = out.filter(F.col("ts") >= _literal(df, "ts", start))
    if end:
        out = out.filter(F.col("ts") < _literal(df, "ts", end))
    return out.orderBy("process_name", "code", F.desc("ts")) if ordered else out


def scan_device_events(df: DataFrame, devices: DataFrame, start: str, end: str) -> DataFrame:
    """SRC-03: events of listed devices in an inclusive range, newest first."""
    inside = F.col("ts").between(_literal(df, "ts", start), _literal(df, "ts", end))
    return (df.filter(inside).join(devices.select("device_id").distinct(), "device_id", "left_semi")
            .orderBy(F.desc("ts")))


def ota_filter(df: DataFrame, version: str, devices: Sequence[str] = (), start: str | None = None,
               end: str | None = None) -> DataFrame:
    """FLT-03: dashboard predicate."""
    return scan_events_exact(df, version, devices, start, end, ordered=False)


def detail_filter(df: DataFrame, severities: Sequence[str] = (), codes: Sequence[float] = (),
                  text: str = "") -> DataFrame:
    """FLT-04: severities, codes and a text to contain, ignoring case."""
    if severities:
        df = df.filter(F.col("type").isin(*severities))
    if codes:
        df = df.filter(F.col("code").isin(*codes))
    if text:
        df = df.filter(F.contains(F.lower("description"), F.lit(text.lower())))
    return df


# ── dashboards ───────────────────────────────────────────────────────────────


def event_overview(df: DataFrame) -> DataFrame:
    """AGG-15: totals and time range of all events."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


def rows_per_type(df: DataFrame) -> DataFrame:
    """AGG-15: rows per type."""
    return df.groupBy("type").agg(F.count(F.lit(1)).alias("rows_count"))


def top_codes(df: DataFrame, n: int = 10) -> DataFrame:
    """AGG-15: the n most frequent codes."""
    return (df.groupBy("code").agg(F.count(F.lit(1)).alias("rows_count"))
            .orderBy(F.desc("rows_count"), F.asc_nulls_last("code")).limit(n))


def version_summary(df: DataFrame, versions: Sequence[str] | None = None) -> DataFrame:
    """AGG-16: summed counts per version and type."""
    rows = df if not versions else df.filter(F.col("version").isin(*versions))
    return (rows.groupBy("version", S.clean_label("type").alias("type"))
            .agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("events")))


def version_tiles(summary: DataFrame, labels: dict[int, str] | None = None) -> DataFrame:
    """AGG-17: total, error and info events per version with the totals of its product line."""
    tiles = summary.groupBy("version").agg(
        F.sum("events").alias("total"),
        F.coalesce(F.sum(F.when(F.col("type") == "ERROR", F.col("events"))), F.lit(0)).alias("errors"),
        F.coalesce(F.sum(F.when(F.col("type") == "INFO", F.col("events"))), F.lit(0)).alias("infos"),
    ).withColumn("line", X.family_scan("version", labels))
    lines = tiles.groupBy("line").agg(F.count(F.lit(1)).alias("line_tiles"), F.sum("total").alias("line_events"))
    return tiles.join(lines, "line")


def version_bounds(df: DataFrame, version: str) -> DataFrame:
    """AGG-18: first and last event of a version."""
    return df.filter(F.col("version") == version).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def version_devices(df: DataFrame, version: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """AGG-19: devices of a version in a window, sorted."""
    rows = ota_filter(df, version, (), start, end).filter(F.coalesce("device_id", F.lit("")) != "")
    return rows.select("device_id").distinct().orderBy("device_id")


_CODE_KEYS = ["process_name", "code", "code_aux", "type", "priority", "pattern"]


def _code_keys() -> list[Column]:
    return ["process_name", "code", "code_aux", S.clean_label("type").alias("type"), S.clean_label("priority", "UNMAPPED", upper=False).alias("priority"),
            X.mask_tokens("description").alias("pattern")]


def process_code_devices(df: DataFrame, size: int = SEGMENT, aux: bool = True) -> DataFrame:
    """AGG-20 / AGG-21: devices of every row of ``process_code_table`` (or, without ``aux``, of ``merge_ignoring_aux``), in parts of ``size``."""
    keys = [k for k in _CODE_KEYS if aux or k != "code_aux"]
    return segmented_lists(df.filter(F.col("device_id") != "").select(*_code_keys(), "device_id"), keys, "device_id", size, name="devices")


def process_code_table(df: DataFrame, lists: bool = True) -> DataFrame:
    """AGG-20: per process, code, aux, type, priority and masked text: sample, summed count, devices.

    Devices are made distinct by partial aggregation before the sorted list is built.  The list is one cell of the report; without ``lists`` the
    table has their number, ``n_devices``, and ``process_code_devices`` has the devices of any number.
    """
    keys = _code_keys()
    if not lists:
        once = df.groupBy(*keys, F.when(F.col("device_id") != "", F.col("device_id")).alias("__d")).agg(F.min("description").alias("sample"), F.sum("cnt").alias("n"))
        return once.groupBy(*_CODE_KEYS).agg(F.min("sample").alias("sample"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"), F.count("__d").alias("n_devices"))
    return df.groupBy(*keys).agg(
        F.min("description").alias("sample"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("occurrences"),
        F.array_sort(F.collect_set(F.when(F.col("device_id") != "", F.col("device_id")))).alias("devices"))


def merge_ignoring_aux(table: DataFrame) -> DataFrame:
    """AGG-21: the same table without aux: sample of the most frequent row, union of devices."""
    keys = ["process_name", "code", "type", "priority", "pattern"]
    # Ties take the smallest aux, the first in the table's order
    order = F.struct(F.col("occurrences"), -F.coalesce("code_aux", F.lit(1 << 60)))
    sums = table.groupBy(*keys).agg(F.max_by("sample", order).alias("sample"),
                                    F.sum("occurrences").alias("occurrences"))
    devices = (table.select(*keys, F.explode_outer("devices").alias("d")).groupBy(*keys)
               .agg(F.array_sort(F.collect_set("d")).alias("devices")))
    same = [sums[k].eqNullSafe(devices[k]) for k in keys]
    rule = same[0]
    for part in same[1:]:
        rule = rule & part
    return sums.join(devices, rule).select(*[sums[k] for k in keys], "sample", "occurrences", "devices")


def staging_rows(df: DataFrame) -> DataFrame:
    """Columns the staging report groups by."""
    return df.withColumns({
        "process": F.coalesce("process_name", F.lit("")), "code_text": F.col("code").cast("string"),
        "aux_text": F.coalesce(F.col("code_aux").cast("string"), F.lit("")),
        "pattern": X.normalize_prefix("description"), "severity": S.severity("type"),
        "times": F.coalesce(F.nullif("cnt", F.lit(0)), F.lit(1)),
    })


def staging_detail(df: DataFrame) -> DataFrame:
    """AGG-22: per process, code, aux and prefix pattern; the first row in scan order names the group.

    A count of 0 or NULL is one occurrence.
    """
    keys = ["process", "code_text", "aux_text", "pattern"]
    first = F.struct(F.col("ts").cast("timestamp").cast("double") * -1, "device_id", F.coalesce("description", F.lit("")))
    head = F.min_by(F.struct("severity", F.coalesce("priority", F.lit("")).alias("priority"),
                             F.coalesce("description", F.lit("")).alias("sample")), first)
    return (staging_rows(df).groupBy(*keys).agg(
        head.alias("h"), F.sum("times").alias("occurrences"),
        F.countDistinct(F.when(F.col("device_id") != "", F.col("device_id"))).alias("devices"))
        .select(*keys, "h.*", "occurrences", "devices"))


def staging_processes(detail: DataFrame) -> DataFrame:
    """AGG-23: patterns and occurrences per process."""
    return detail.groupBy("process").agg(
        F.count(F.lit(1)).alias("patterns"), F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "info").alias("info"), F.sum("occurrences").alias("occurrences"),
    ).orderBy(F.desc("errors"), F.desc("patterns"), "process")


def staging_totals(df: DataFrame) -> DataFrame:
    """AGG-24: error rows, info rows and devices of the report."""
    return df.agg(F.count_if(S.severity("type") == "error").alias("error_rows"),
                  F.count_if(S.severity("type") == "info").alias("info_rows"),
                  F.countDistinct(F.when(F.col("device_id") != "", F.col("device_id"))).alias("devices"))


def staging_devices(df: DataFrame) -> DataFrame:
    """AGG-24: devices of the report with the version of their first row in scan order."""
    order = F.struct("process_name", "code", F.col("ts").cast("timestamp").cast("double") * -1, "version")
    return (df.filter(F.col("device_id") != "").groupBy("device_id")
            .agg(F.coalesce(F.min_by("version", order), F.lit("")).alias("version")).orderBy("device_id"))


def unique_combinations(df: DataFrame, version: str = "", processes: Sequence[str] = (),
                        tenants: Sequence[int] = (), limit: int | None = None) -> DataFrame:
    """AGG-26: distinct code, aux and description with their rows, most frequent first."""
    if version:
        df = df.filter(F.contains("version", F.lit(version)))
    if processes:
        df = df.filter(F.col("process_name").isin(*processes))
    if tenants:
        df = df.filter(F.col("tenant_id").isin(*tenants))
    keys = ["code", "code_aux", "description"]
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_count")).orderBy(F.desc("rows_count"), *[F.asc_nulls_last(k) for k in keys])
    return rows if limit is None else rows.limit(limit)


def distinct_codes(df: DataFrame, version: str, start: str, end: str) -> DataFrame:
    """AGG-27: distinct code and aux over a range; one filter prunes the days."""
    rows = df.filter(F.contains("version", F.lit(version)) & (F.col("ts") >= _literal(df, "ts", start))
                     & (F.col("ts") < _literal(df, "ts", end)))
    return rows.select("code", "code_aux").distinct()


def priority_summary(df: DataFrame) -> DataFrame:
    """AGG-28: how many rows have a priority."""
    empty = F.coalesce(F.trim("priority"), F.lit("")) == ""
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(~empty).alias("with_priority"),
                  F.count_if(empty).alias("without_priority"))


def priority_breakdown(df: DataFrame) -> DataFrame:
    """AGG-28: rows per type and priority."""
    return df.groupBy("type", "priority").agg(F.count(F.lit(1)).alias("rows_count"))


def rank_issues(df: DataFrame) -> DataFrame:
    """TOP-04: issues by priority, then frequency."""
    issues = df.groupBy("code", "priority", X.mask_tokens("description").alias("pattern")).agg(
        F.count(F.lit(1)).alias("rows_count"))
    return issues.orderBy(X.priority_key("priority"), F.desc("rows_count"), "code", "pattern")


# ── pattern map upkeep ───────────────────────────────────────────────────────


def apply_pattern_map(df: DataFrame, pattern_map: DataFrame, pattern: str | None = None) -> DataFrame:
    """JOI-07: type and priority of mapped patterns replace the stored ones; other rows stay."""
    pm = pattern_map.select(F.col("description_pattern").alias("__p"), F.col("type").alias("__type"),
                            F.col("priority").alias("__prio"))
    if pattern is not None:
        pm = pm.filter(F.col("__p") == pattern)
    joined = df.withColumn("__key", X.normalize_description("description")).join(
        pm, F.col("__key") == F.col("__p"), "left")
    return joined.select(*[F.coalesce("__type", "type").alias("type") if c == "type"
                           else F.coalesce("__prio", "priority").alias("priority") if c == "priority"
                           else F.col(c) for c in df.columns])


def verify_pattern_map(df: DataFrame, pattern_map: DataFrame) -> DataFrame:
    """JOI-08: groups whose stored type or priority differs from the map's, largest first."""
    groups = df.groupBy(X.normalize_description("description").alias("description_pattern"),
                        F.col("type").alias("stored_type"), F.col("priority").alias("stored_priority")).agg(
        F.count(F.lit(1)).alias("rows_count"))
    differs = ~(F.col("stored_type").eqNullSafe(F.col("type")) & F.col("stored_priority").eqNullSafe(F.col("priority")))
    return (groups.join(pattern_map.select("description_pattern", "type", "priority"), "description_pattern")
            .filter(differs).orderBy(F.desc("rows_count"), "description_pattern"))


def rebuild_patterns(src: DataFrame) -> DataFrame:
    """JOI-09: one row per code, type and pattern with its smallest sample and priority."""
    return src.groupBy("code", "type", X.normalize_description("description").alias("description_pattern")).agg(
        F.min("description").alias("sample_description"), F.min("priority").alias("priority"))


def sync_patterns(src: DataFrame, existing: DataFrame) -> DataFrame:
    """JOI-09: the rows of a rebuild the table does not have yet."""
    return rebuild_patterns(src).join(existing, ["code", "type", "description_pattern"], "left_anti")


def append_patterns(pattern_map: DataFrame, new: DataFrame) -> DataFrame:
    """JOI-10: the map plus the new patterns it lacks."""
    add = new.join(pattern_map, "description_pattern", "left_anti").dropDuplicates(["description_pattern"])
    return pattern_map.unionByName(add.select(*pattern_map.columns))


def join_priority(events: DataFrame, pmap: DataFrame) -> DataFrame:
    """JOI-20: events with the map rows of their code whose LIKE pattern fits; others unmatched.

    Codes and texts repeat, so distinct (code, text) pairs are matched and joined back.
    """
    pairs = events.select("code", "description").distinct()
    pm = pmap.select(F.col("code").alias("__code"), "like_pattern", F.col("map_type"), F.col("map_priority"))
    hits = pairs.join(pm, (F.col("code") == F.col("__code"))
                      & F.expr("description like like_pattern")).drop("__code", "like_pattern")
    return events.join(hits, ["code", "description"], "left")


def neighbours(df: DataFrame, rows: DataFrame, by: Sequence[str], ts: str = "ts", minutes: int = 5) -> DataFrame:
    """JOI-19: rows of the same key within ± minutes of the chosen ``rows`` (column ``ref_id`` names them).

    The equi key holds a time bucket as wide as the reach, so a row meets three buckets of its
    key and not the whole key.
    """
    reach = minutes * 60
    sec = F.col(ts).cast("timestamp").cast("double")
    chosen = rows.select(*by, "ref_id", F.col(ts).alias("ref_ts")).withColumn(
        "__b", F.explode(F.expr(f"sequence(cast(floor(cast(cast(ref_ts as timestamp) as double) / {reach}) as bigint) - 1, "
                                f"cast(floor(cast(cast(ref_ts as timestamp) as double) / {reach}) as bigint) + 1)")))
    near = F.abs(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("ref_ts").cast("timestamp")))
    return (df.withColumn("__b", F.floor(sec / reach).cast("bigint")).join(chosen, [*by, "__b"])
            .filter(near <= reach * 1_000_000).drop("__b"))


# ── devices, minutes, issues ─────────────────────────────────────────────────


def drive_minutes(metrics: DataFrame, start: str, end: str, devices: DataFrame | None = None) -> DataFrame:
    """JOI-06: drive minutes per device over inclusive dates."""
    rows = metrics.filter(F.col("record_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if devices is not None:
        rows = rows.join(devices.select("device_id").distinct(), "device_id", "left_semi")
    return rows.groupBy("device_id").agg(F.sum("valid_drive_time_in_minutes").alias("minutes"))


def join_minutes(df: DataFrame, minutes: DataFrame) -> DataFrame:
    """JOI-06: minutes per device, 0 without any, most first."""
    return (df.join(minutes, "device_id", "left").withColumn("minutes", F.coalesce("minutes", F.lit(0.0)))
            .orderBy(F.desc("minutes"), "device_id"))


def enrich_tenant(devices: DataFrame, master: DataFrame, vehicle: DataFrame, tenant: DataFrame) -> DataFrame:
    """JOI-04: tenant of every device over master and vehicle; the last match wins."""
    found = (master.join(vehicle, "vehicle_id").join(tenant, "tenant_id")
             .groupBy("device_id").agg(F.max_by(F.struct("tenant_id", "tenant_name"),
                                                F.struct("vehicle_id", "tenant_id")).alias("t")))
    return devices.join(found, "device_id", "left").select(*devices.columns, "t.tenant_id", "t.tenant_name")


def device_configs(master: DataFrame, configs: DataFrame, vehicle: DataFrame, tenant: DataFrame,
                   devices: DataFrame | None = None) -> DataFrame:
    """JOI-05: configuration per device with vehicle and tenant when known."""
    rows = master if devices is None else master.join(devices.select("device_id").distinct(), "device_id", "left_semi")
    return (rows.join(configs, "config_id").join(vehicle, "vehicle_id", "left").join(tenant, "tenant_id", "left")
            .withColumns({"vehicle_name": F.coalesce("vehicle_name", F.lit("UNKNOWN")),
                          "tenant_name": F.coalesce("tenant_name", F.lit("UNKNOWN"))}))


def gram_codes(df: DataFrame, key: str, text: str, short: bool) -> DataFrame:
    """(key, gram): the distinct grams of three characters of each row's text, as numbers; null has none.

    A number holds 21 bits per code point, so different grams differ.  With ``short``, grams of one and two
    characters are added, their last places 0; without, a text of fewer than three characters is its own gram.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, at = [np.zeros(0, np.int64)], [0]
            for one in batch.column(1).to_pylist():
                code = np.frombuffer(f"{one or ''}\0\0".encode("utf-32-le"), np.uint32).astype(np.int64)
                three = code[:-2] << 42 | code[1:-1] << 21 | code[2:]
                if short:
                    three = np.unique(three)
                    two = np.unique(three >> 21) << 21
                    three = np.concatenate((three, two, np.unique(two >> 42) << 42))
                else:
                    three = three[: max(len(three) - 2, 1)]
                grams.append(np.unique(three))
                at.append(at[-1] + len(grams[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(grams)))], [key, "grams"])

    kind = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("grams", T.ArrayType(T.LongType()))])
    return df.select(key, text).mapInArrow(run, kind).select(key, F.explode("grams").alias("gram"))


def related_issues(rows: DataFrame, issues: DataFrame, k: int = 10) -> DataFrame:
    """JOI-21: per distinct error phrase the k newest issues whose text contains it.

    Phrase and text meet on one gram (three characters, or the whole phrase when it is
    shorter): the phrase's rarest over the issues.  A text that contains the phrase has all
    its grams, so no match is missed, and containment is tested on those candidates only.
    Grams are numbers: as texts, one by one, they cost more than all the rest.
    """
    phrases = (rows.filter(F.upper("type") == "ERROR").select(F.lower(X.search_phrase("description")).alias("phrase"))
               .filter("phrase != ''").distinct())

    texts = issues.select("issue_id", "created", F.lower("text").alias("text"))
    index = gram_codes(texts, "issue_id", "text", True)
    wanted = gram_codes(phrases.withColumn("text", F.col("phrase")), "phrase", "text", False)
    counts = index.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"))
    rare = (wanted.join(counts, "gram", "left").groupBy("phrase")
            .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram")))
    hits = (rare.join(index, "gram").join(texts, "issue_id")
            .filter(F.contains("text", "phrase")).select("phrase", "issue_id", "created"))
    newest = W.partitionBy("phrase").orderBy(F.desc("created"), F.desc("issue_id"))
    return hits.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= k)


def download_targets(rows: DataFrame, n: int = 2) -> DataFrame:
    """WIN-40: for unexplained error groups: the n devices seen last, with the day seen and the next."""
    key = ["process", "code_text", "pattern"]
    last = rows.groupBy(*key, "device_id").agg(F.max("ts").alias("last_ts"))
    w = W.partitionBy(*key).orderBy(F.desc("last_ts"), "device_id")
    chosen = last.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    day = F.to_date("last_ts")
    return chosen.select("device_id", F.explode(F.array(day, F.date_add(day, 1))).alias("day")).distinct()


# ── device lists ─────────────────────────────────────────────────────────────


def state_counts(df: DataFrame) -> DataFrame:
    """AGG-29: devices per state over all versions."""
    return df.groupBy("state").agg(F.count(F.lit(1)).alias("devices"))


def devices_capped(df: DataFrame, limit: int, field_states: Sequence[str] = ("INSTALLED",)) -> DataFrame:
    """AGG-29: per version at most ``limit`` devices, field states first."""
    rank = F.when(F.col("state").isin(*field_states), 0).otherwise(1)
    w = W.partitionBy("version").orderBy(rank, "state", "device_id")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def device_list(df: DataFrame, version: str, states: dict[int, str]) -> DataFrame:
    """SRC-07: devices of a firmware version with named states; an unknown id is its text."""
    names = F.create_map(*[F.lit(x) for k, v in states.items() for x in (k, v)])
    return df.filter(F.col("version") == version).withColumn(
        "state", F.coalesce(F.try_element_at(names, F.col("state_id").cast("int")), F.col("state_id").cast("string")))


def select_versions(df: DataFrame, product_lines: Sequence[str], versions: Sequence[str],
                    labels: dict[int, str] | None = None) -> DataFrame:
    """FLT-09: versions of the product lines, or the exact versions that belong to a known line."""
    line = X.family_scan("version", labels, None)
    known = df.withColumn("line", line)
    rule = known["line"].isin(*product_lines) if product_lines else (
        F.col("version").isin(*versions) & F.col("line").isNotNull())
    return known.filter(rule).dropDuplicates(["version"])


def merge_versions(*dfs: DataFrame) -> DataFrame:
    """TXT-20: version lists merged: trimmed, first list wins, newest first."""
    union = None
    for i, df in enumerate(dfs):
        part = df.select(F.trim("version").alias("version")).filter("version != ''").withColumn("list", F.lit(i))
        union = part if union is None else union.unionByName(part)
    once = union.groupBy("version").agg(F.min("list").alias("list"))
    return once.orderBy(X.version_key("version").desc())


def latest_versions(df: DataFrame, prefixes: dict[str, str], exclude: str = ".IN.",
                    excluded_lines: Sequence[str] = ()) -> DataFrame:
    """TXT-21: newest version per product line by its prefix, regional builds left out for some lines."""
    line = None
    for name, prefix in prefixes.items():
        test = F.startswith("version", F.lit(prefix))
        line = F.when(test, name) if line is None else line.when(test, name)
    rows = df.select("version", line.alias("line")).filter(F.col("line").isNotNull())
    if excluded_lines:
        rows = rows.filter(~(F.col("line").isin(*excluded_lines) & F.contains("version", F.lit(exclude))))
    return rows.groupBy("line").agg(F.max_by("version", X.version_key("version")).alias("version"))


def order_versions(df: DataFrame, configured: DataFrame) -> DataFrame:
    """JOI-25: configured versions first in their order, the rest newest first."""
    rows = df.join(configured.select("version", "rank"), "version", "left")
    return rows.orderBy(F.asc_nulls_last("rank"), X.version_key("version").desc())


def known_versions(reports: DataFrame, runs: DataFrame, env: str, limit: int | None = None) -> DataFrame:
    """JOI-26: versions of reports and runs with their newest time."""
    both = reports.select("environment", "version", "at").unionByName(runs.select("environment", "version", "at"))
    rows = both.filter(F.col("environment") == env).groupBy("version").agg(F.max("at").alias("newest")).orderBy(F.desc("newest"), "version")
    return rows if limit is None else rows.limit(limit)
