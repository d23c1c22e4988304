"""Metrics of device logs: hits -> samples -> boot, device and fleet values (KPI-01 .. KPI-30, AGG-33 .. AGG-36).

A *hit* is (device, key, ts, groups).  A *sample* is (device, metric, ts, value, text).
Metrics of one shape are computed together: the rule table is compiled into one expression
over the hits, so twelve pairings cost one as-of join and not twelve.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.operators.asof import asof_join, asof_many, assign_interval, pair_events
from tripline.operators.quantiles import quantiles
from tripline.operators.sequences import (anchor_clusters, carry_key, nth_in_session, request_batches, silence_points,
                                          unanswered)
from tripline.operators.timeline import scan
from tripline.plans import registry as R
from tripline.session import settle

# Fixed values (ms)
CLUSTER = 5_000
SINCE_POWER_ON = 900_000
AFTER_IGNITION = 300_000
ALIVE_GAP = 20_000
BUCKET = 600_000
MOVE_AFTER_LIST = 2_000
TARGET_BEFORE_SIZE = 300_000
EMPTY_INERTIAL_BYTES = 31
MIN_FILE_BYTES = 10_000
CYCLE_GAP = 5_000

SAMPLE = ["device", "metric", "ts", "value", "text"]


def g(name: str) -> Column:
    """A captured group of the line, NULL when it did not take part."""
    return F.try_element_at("groups", F.lit(name))


def num(name: str) -> Column:
    return g(name).try_cast("double")


def _hits(hits: DataFrame, *keys: str) -> DataFrame:
    return hits.filter(F.col("key").isin(*keys))


def _samples(df: DataFrame, metric: Column | str, value: Column | None = None, text: Column | None = None,
             ts: Column | str = "ts") -> DataFrame:
    name = F.lit(metric) if isinstance(metric, str) else metric
    return df.select("device", name.alias("metric"), (F.col(ts) if isinstance(ts, str) else ts).alias("ts"),
                     (value if value is not None else F.lit(None)).cast("double").alias("value"),
                     (text if text is not None else F.lit(None)).cast("string").alias("text"))


def _all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _tagged(hits: DataFrame, rules: Sequence[tuple[Column, Column]], name: str = "r") -> DataFrame:
    """Hits repeated for every rule they meet: (test, struct) pairs."""
    tags = F.array(*[F.when(test, tag) for test, tag in rules])
    return hits.withColumn(name, F.explode(F.filter(tags, lambda x: x.isNotNull())))


def alive_points(lines: DataFrame) -> DataFrame:
    """``alive`` hits: the last line of a service's file before a silence, and its last line (WIN-05)."""
    timed = lines.filter(F.col("service").isin(*R.ALIVE_SERVICES) & F.col("ts").isNotNull())
    quiet = silence_points(timed, ["device", "service", "file"], "ts", ALIVE_GAP, ["line_no"])
    return quiet.select("device", F.lit("alive").alias("key"), "ts", F.create_map(F.lit("svc"), "service").alias("groups"))


def bucket_sum(hits: DataFrame, key: str = "frame_count", width_ms: int = BUCKET, group: str = "frames") -> DataFrame:
    """AGG-33: frequent lines reduced per bucket and other groups: first time, sum and number of lines."""
    rest = F.to_json(F.array_sort(F.filter(F.map_entries("groups"), lambda e: e["key"] != group)))
    rows = _hits(hits, key).select("device", "ts", num(group).alias("v"), rest.alias("rest"), g("cam").alias("cam"),
                                   F.floor(F.col("ts") / width_ms).alias("bucket"))
    return rows.groupBy("device", "bucket", "rest", "cam").agg(
        F.min("ts").alias("ts"), F.sum("v").alias("total"), F.count(F.lit(1)).alias("n")).drop("rest")


# ── power-ons, units ─────────────────────────────────────────────────────────


def power_ons(hits: DataFrame) -> DataFrame:
    """Power-on times: clusters of (time - uptime) candidates, best source first (WIN-02)."""
    prio = F.array_position(F.array(*[F.lit(k) for k in R.POWER_KEYS]), F.col("key"))
    cand = _hits(hits, *R.POWER_KEYS).select("device", (F.col("ts") - F.round(num("s") * 1000)).cast("bigint").alias("ts"),
                                             prio.alias("prio"))
    found = anchor_clusters(cand, ["device"], "ts", CLUSTER, ["prio"]).select("device", "ts").distinct()
    return scan(found.withColumn("one", F.lit(1)), ["device"], "ts", total={"segment": "one"}, lead={"next_ts": "ts"}).drop("one")


def with_units(hits: DataFrame, powers: DataFrame, boots: DataFrame) -> DataFrame:
    """Hits with their unit: the power-on they follow, or the boot on devices without power-ons."""
    b = boots.select("device", "boot_index", F.col("eff_start").alias("start"), "end")
    seg = powers.select("device", F.col("ts").alias("anchor"), "segment")
    both = asof_many(hits, {"": (seg, "anchor"), "b_": (b, "start")}, ["device"], "ts")
    inside = F.col("b_start").isNotNull() & (F.col("b_end").isNull() | (F.col("ts") < F.col("b_end")))
    both = both.withColumn("boot_index", F.when(inside, F.col("b_boot_index"))).drop("b_boot_index")
    has = powers.select("device").distinct().withColumn("has_power", F.lit(True))
    both = both.join(has, "device", "left")
    unit = F.when(F.col("has_power"), F.concat(F.lit("p"), F.col("segment").cast("string"))).otherwise(
        F.concat(F.lit("b"), F.col("boot_index").cast("string")))
    return both.withColumn("unit", unit).drop("b_start", "b_end", "has_power")


def unit_reasons(units: DataFrame) -> DataFrame:
    """KPI-09: text of the first reason lines of every unit."""
    rows = _hits(units, "prev_shutdown", "sm_prev_shutdown", "wakeup_reason").filter(F.col("unit").isNotNull())
    first = rows.groupBy("device", "unit", "key").agg(
        F.min_by(F.array_join(F.map_values("groups"), " "), F.col("ts")).alias("text"))
    return first.groupBy("device", "unit").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("reasons"))


# ── families of metrics ──────────────────────────────────────────────────────

# Metric, key and test of counted lines; some count distinct groups
_COUNTS = (
    ("alerts_unique", "upload_state", ("key",), None), ("alerts_ed_calls", "eventdata_call", None, None),
    ("alerts_cards", "eventdata_ok", ("key",), None), ("rt_eventdata_n", "retry_details", None, ("type", "100")),
    ("rt_obs_n", "retry_details", None, ("type", "110")), ("rt_videolist_n", "videolist_failed", None, None),
    ("rt_status_n", "health_post_failed", None, None), ("hc_attempted", "hc_call", None, None),
    ("hc_success", "hc_ok", None, None), ("hc_missing", "hc_response", None, ("missing", "{")),
)
# Metric, start keys, end key, pairing group, kept start
_PAIRS = (
    ("cyclic_crank_high", ("pass_high",), "soak_done", None, "last"),
    ("shutdown_time", ("shutdown_initiated",), "shutdown_exec", None, "last"),
    ("down_ota", ("updater_stop",), "first_frame", None, "first"),
    ("down_cyclic", ("sm_cyclic",), "first_frame", None, "first"),
    ("down_iot", ("iot_reboot",), "first_frame", None, "first"),
    ("down_cam_crash", ("cam_crash",), "record_start", "cam", "first"),
    ("down_lte_disconnect", ("conn_exit",), "data_connected", None, "first"),
    ("rt_eventdata_s", ("eventdata_fail",), "eventdata_ok", "key", "first"),
    ("rt_video_s", ("vod_attempt_failed",), "vod_deleted", "vod", "first"),
    ("rt_obs_s", ("obs_fail",), "obs_uploaded", "tid", "first"),
    ("rt_videolist_s", ("videolist_failed",), "videolist_ok", None, "first"),
    ("rt_status_s", ("health_post_failed",), "health_ok", None, "first"),
    ("hc_upload_s", ("hc_attempt",), "hc_ok", "thr", "last"),
)
# Metric, key, group holding the time, word the unit's reasons must contain
_SINCE = (
    ("boot_reboot_log", "reboot_entering", None, None), ("svc_start", "svc_start", None, None),
    ("analytics_start", "analytics_start", None, None), ("zmq_socket", "zmq_socket", None, None),
    ("first_frame", "first_frame", "epoch", None), ("data_connectivity", "lte_session", None, None),
    ("keep_alive_reboot", "ka_reached", None, None), ("dl_ign", "bt_ignition_on", None, None),
    ("wdt_pm_start", "pm_start", None, "WATCHDOG"),
)
# Metric, sources (key, group, scale) in order, every value or the first, reason words
_FIRST = (
    ("system_uptime", (("ndc_system_uptime", "s", 1.0),), False, ()),
    ("service_uptime", (("ndc_service_uptime", "s", 1.0),), False, ()),
    ("modem_enum", (("gps_enum", "s", 1.0), ("sm_gps_enum", "ms", 0.001)), False, ()),
    ("gps_ttff_lpw", (("gps_ttff", "s", 1.0),), False, ("LOWPOWER",)),
    ("gps_ttff_cyclic", (("gps_ttff", "s", 1.0),), False, ("CYCLIC", "IGNITION", "CRANK")),
    ("ota_update_time", (("sm_update_time", "s", 1.0), ("updater_update_time", "s", 1.0)), True, ()),
)
_AFTER_IGNITION = (("dl_adv", "driver_adv_start"), ("dl_scan_start", "driver_scan_start"), ("dl_scan_stop", "driver_scan_stop"))


def counts(hits: DataFrame) -> DataFrame:
    """WIN-27 metrics: one sample per line, or per distinct group tuple of the device (earliest kept).

    KPI-26, the retries of a transfer, counts a failed attempt +1 and a given-up one -1.
    """
    rules = []
    for metric, key, unique, where in _COUNTS:
        test = F.col("key") == key
        if where:
            test = test & (g(where[0]) == where[1])
        ident = F.concat_ws("|", *[F.coalesce(g(u), F.lit("")) for u in unique]) if unique else F.lit(None).cast("string")
        rules.append((test, F.struct(F.lit(metric).alias("metric"), ident.alias("ident"))))
    crash = F.col("key") == "cam_crash"
    rules.append((crash, F.struct(F.concat(F.lit("crash_cam"), g("cam")).alias("metric"),
                                  F.floor(F.col("ts") / 1000).cast("string").alias("ident"))))
    rows = _tagged(hits, rules).select("device", F.col("r.metric").alias("metric"), "ts", F.col("r.ident").alias("ident"))
    plain = rows.filter(F.col("ident").isNull()).select("device", "metric", "ts")
    once = rows.filter(F.col("ident").isNotNull()).groupBy("device", "metric", "ident").agg(F.min("ts").alias("ts"))
    both = plain.unionByName(once.select("device", "metric", "ts"))
    retries = _hits(hits, "vod_attempt_failed", "vod_exhausted")
    signed = F.when(F.col("key") == "vod_exhausted", -1).otherwise(1)
    return _samples(both, F.col("metric"), F.lit(1)).unionByName(_samples(retries, "rt_video_n", signed))


def pairs(hits: DataFrame, powers: DataFrame) -> DataFrame:
    """JOI-17 metrics: seconds from a start line to the next end line, dated at the end."""
    def side(keys_of) -> DataFrame:
        rules = [(F.col("key").isin(*keys_of(rule)), F.struct(
            F.lit(rule[0]).alias("metric"), (g(rule[3]) if rule[3] else F.lit(None).cast("string")).alias("pair")))
            for rule in _PAIRS]
        return _tagged(hits, rules).select("device", F.col("r.metric").alias("metric"), F.col("r.pair").alias("pair"), "ts")

    starts, ends = side(lambda r: r[1]), side(lambda r: (r[2],))
    last = [r[0] for r in _PAIRS if r[4] == "last"]
    out = _all([pair_events(starts.filter(test), ends.filter(test), ["device", "metric"], "ts", ["pair"], keep=keep)
                for keep, test in (("first", ~F.col("metric").isin(*last)), ("last", F.col("metric").isin(*last)))])
    # One of them must not have a power-on between its ends
    seg = powers.select("device", F.col("ts").alias("p_ts"), "segment")
    free = F.col("metric") != "down_lte_disconnect"
    at_end = asof_join(out.filter(~free), seg, ["device"], "end_ts", "p_ts", prefix="e_")
    both = asof_join(at_end, seg, ["device"], "start_ts", "p_ts", prefix="s_")
    same = both.filter(F.col("e_segment").eqNullSafe(F.col("s_segment"))).select(*out.columns)
    return _samples(out.filter(free).unionByName(same), F.col("metric"), (F.col("end_ts") - F.col("start_ts")) / 1000, ts="end_ts")


def since_power_on(units: DataFrame, reasons: DataFrame) -> DataFrame:
    """WIN-25 metrics: seconds from power-on to the first line, within 0 .. 900 s."""
    rules = [(F.col("key") == key, F.struct(
        F.lit(metric).alias("metric"), (g(at).cast("bigint") if at else F.col("ts")).alias("at"),
        F.lit(word).cast("string").alias("word"))) for metric, key, at, word in _SINCE]
    rows = _tagged(units.filter(F.col("anchor").isNotNull() & F.col("unit").startswith("p")), rules)
    first = rows.groupBy("device", "unit", "r.metric", "r.word").agg(
        F.min_by(F.struct("ts", "anchor", F.col("r.at").alias("at")), F.struct("ts", "r.at")).alias("f"))
    first = first.join(reasons, ["device", "unit"], "left")
    ok = F.col("word").isNull() | F.contains(F.coalesce("reasons", F.lit("")), F.col("word"))
    gap = F.col("f.at") - F.col("f.anchor")
    return _samples(first.filter(ok & gap.between(0, SINCE_POWER_ON)), F.col("metric"), gap / 1000, ts="f.ts")


def first_values(units: DataFrame, reasons: DataFrame) -> DataFrame:
    """WIN-26 metrics: first (or every) value per unit of the best source the unit has."""
    rules = [(F.col("key") == key, F.struct(
        F.lit(metric).alias("metric"), F.lit(rank).alias("rank"), (num(group) * scale).alias("value"),
        F.lit(every).alias("every"), F.array(*[F.lit(w) for w in words]).cast("array<string>").alias("words")))
        for metric, sources, every, words in _FIRST for rank, (key, group, scale) in enumerate(sources)]
    rows = _tagged(units.filter(F.col("unit").isNotNull()), rules).select("device", "unit", "ts", "r.*")
    rows = rows.join(reasons, ["device", "unit"], "left")
    rows = rows.filter((F.size("words") == 0) | F.exists("words", lambda w: F.contains(F.coalesce("reasons", F.lit("")), w)))
    best = rows.groupBy("device", "unit", "metric").agg(F.min("rank").alias("best"))
    kept = rows.join(best, ["device", "unit", "metric"]).filter(F.col("rank") == F.col("best"))
    every = kept.filter("every")
    one = kept.filter("not every").groupBy("device", "unit", "metric").agg(
        F.min_by(F.struct("ts", "value"), F.struct("ts", "value")).alias("f"))
    return _samples(every, F.col("metric"), F.col("value")).unionByName(
        _samples(one, F.col("metric"), F.col("f.value"), ts="f.ts"))


def after_ignition(units: DataFrame) -> DataFrame:
    """KPI-21: seconds from the unit's first ignition line to the next line of each kind, within 300 s."""
    ign = _hits(units, "bt_ignition_on").filter(F.col("unit").isNotNull()).groupBy("device", "unit").agg(F.min("ts").alias("on"))
    rules = [(F.col("key") == key, F.lit(metric)) for metric, key in _AFTER_IGNITION]
    rows = _tagged(units.filter(F.col("unit").isNotNull()), rules, "metric").join(ign, ["device", "unit"])
    first = rows.filter(F.col("ts") >= F.col("on")).groupBy("device", "unit", "metric", "on").agg(F.min("ts").alias("ts"))
    gap = F.col("ts") - F.col("on")
    return _samples(first.filter(gap <= AFTER_IGNITION), F.col("metric"), gap / 1000)


def simple_values(hits: DataFrame) -> DataFrame:
    """KPI-01, KPI-07, KPI-17: values read off single lines."""
    def bucket(kind: str, cam: str, what: int) -> Column:
        return F.nullif(F.regexp_extract(g(kind), rf'"{cam}": "(\d+)/([\d.]+)"', what), F.lit("")).cast("double")

    def count(kind: str, cam: str, plus: str | None = None) -> Column:
        n = bucket(kind, cam, 1)
        return n + F.coalesce(bucket(plus, cam, 1), F.lit(0.0)) if plus else n

    def mean(kind: str, cam: str) -> Column:
        return bucket(kind, cam, 2) * 1.048576 / F.nullif(bucket(kind, cam, 1), F.lit(0.0))

    obs = F.nullif(F.regexp_extract(g("obs"), r"^(\d+)/", 1), F.lit("")).cast("double")
    st = F.col("key") == "storage_info"
    upper = F.replace(F.upper(g("ver")), F.lit("0X"), F.lit("0x"))
    table = [
        ("obs_ld_avg", F.col("key") == "obs_ld_size", num("size") * 1e-3, None),
        ("aon_version", F.col("key").isin("aon_sm", "aon_apm"), None, upper), ("obd_version", F.col("key") == "obd_fw", None, g("ver")),
        ("pv_ld_cam0", st, mean("lq", "0"), None), ("pv_ld_cam1", st, mean("lq", "1"), None),
        ("pv_hd_cam0", st, mean("hq", "0"), None), ("pv_hd_cam1", st, mean("hq", "1"), None),
        ("obs_hd_max", st, obs, None), ("emmc_obs", st, obs, None), ("emmc_hours", st, count("lq", "0") / 60, None),
        ("emmc_cam0", st, count("hq", "0", "lq"), None), ("emmc_cam1", st, count("hq", "1", "lq"), None),
        ("emmc_cam2", st, count("hq", "2"), None), ("emmc_cam3", st, count("hq", "3"), None),
        ("emmc_ext", st, count("hq", "N", "lq"), None),
    ]
    rules = [(test, F.struct(F.lit(m).alias("metric"), (v if v is not None else F.lit(None)).cast("double").alias("value"),
                             (t if t is not None else F.lit(None)).cast("string").alias("text"))) for m, test, v, t in table]
    rows = _tagged(hits, rules)
    return _samples(rows, F.col("r.metric"), F.col("r.value"), F.col("r.text")).filter(
        F.col("value").isNotNull() | F.col("text").isNotNull())


def bands(hits: DataFrame, boots: DataFrame) -> DataFrame:
    """KPI-11: band numbers of the masks of a boot; a 64-bit mask is read as two halves."""
    b = boots.select("device", "boot_index", F.col("eff_start").alias("b_start"), F.col("end").alias("b_end"))
    placed = assign_interval(_hits(hits, "band_mask", "band_ext"), b, ["device"], "ts", "b_start", "b_end", how="inner")
    mask = F.lpad(g("mask"), 16, "0")
    high, low = (F.conv(F.substring(mask, p, 8), 16, 10).cast("bigint") for p in (1, 9))
    base = F.when(g("range") == "65_128", 64).otherwise(0)
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(
        i < 32, F.getbit(low, i)).otherwise(F.getbit(high, F.greatest(i - 32, F.lit(0)))) == 1)
    rows = placed.select("device", "boot_index", "ts", F.transform(bits, lambda i: i + 1 + base).alias("bands"))
    per = rows.groupBy("device", "boot_index").agg(
        F.max("ts").alias("ts"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("bands")))).alias("bands"))
    text = F.array_join(F.transform("bands", lambda n: F.concat(F.lit("B"), n.cast("string"))), ",")
    return _samples(per.filter(F.size("bands") > 0), "bands", None, text)


def files(hits: DataFrame) -> DataFrame:
    """KPI-15: last size per file; placeholders are dropped, one metric wants a position in the name."""
    name = g("name")
    last = _hits(hits, "pushed_file").groupBy("device", g("cam").alias("cam"), g("ext").alias("ext"), name.alias("name")).agg(
        F.max_by(F.struct("ts", num("size").alias("size")), F.struct("ts", num("size"))).alias("f"))
    kept = last.filter(F.col("f.size") >= MIN_FILE_BYTES)
    fix = r"_(-?\d+\.\d+)_(-?\d+\.\d+)_[\d.]+_\d{13}_y$"
    lat, lon = F.regexp_extract("name", fix, 1), F.regexp_extract("name", fix, 2)
    has_fix = F.col("name").rlike(fix) & ~((lat == "91.0000") & (lon == "181.0000"))
    ld_cams = ("0", "1", *[str(c) for c in R.OPTIONAL_CAMS])
    size = F.col("f.size")
    rules = [
        (F.col("ext") == ".mp4", F.struct(F.concat(F.lit("hd_size_cam"), "cam").alias("m"), (size / 1e6).alias("v"))),
        ((F.col("ext") == ".mp4.ld.mp4") & F.col("cam").isin(*ld_cams),
         F.struct(F.concat(F.lit("ld_size_cam"), "cam").alias("m"), (size / 1e6).alias("v"))),
        ((F.col("ext") == ".zip") & (F.col("cam") == "0"), F.struct(F.lit("obs_hd_avg").alias("m"), (size / 1e3).alias("v"))),
        ((F.col("ext") == ".zip") & (F.col("cam") == "0") & has_fix,
         F.struct(F.lit("obs_gps_size").alias("m"), (size / 1e3).alias("v"))),
    ]
    return _samples(_tagged(kept, rules), F.col("r.m"), F.col("r.v"), ts="f.ts")


def frame_rates(hits: DataFrame) -> DataFrame:
    """KPI-16: frames per second of ten-minute buckets (a line covers 5 s)."""
    rows = bucket_sum(hits)
    rate = F.col("total") / (F.col("n") * 5)
    hd = _samples(rows, F.concat(F.lit("hd_fps_cam"), "cam"), rate)
    return hd.unionByName(_samples(rows.filter(F.col("cam").isin("0", "1")), F.concat(F.lit("ld_fps_cam"), "cam"), rate))


def storage_root(hits: DataFrame) -> DataFrame:
    """KPI-18: size of the root partition: free bytes and the used MiB logged at most 15 min before."""
    used = _hits(hits, "disk_used").groupBy("device", "ts").agg(F.max(num("used")).alias("used"))
    free = _hits(hits, "disk_free").select("device", "ts", num("bytes").alias("free"))
    at = asof_join(free, used, ["device"], "ts", tolerance_ms=900_000, prefix="u_").filter(F.col("u_used").isNotNull())
    return _samples(at, "root_size", (F.col("free") + F.col("u_used") * 1024 * 1024) / 1e9)


def write_amplification(hits: DataFrame) -> DataFrame:
    """KPI-19: first line of a diagnostic cycle is the inner storage, second the outer."""
    rows = _hits(hits, "waf").select("device", "ts", num("waf").alias("waf"))
    return _all([_samples(nth_in_session(rows, ["device"], "ts", CYCLE_GAP, n, ["waf"]), m, F.col("waf"))
                 for n, m in ((1, "waf_int"), (2, "waf_ext"))])


def package_sizes(hits: DataFrame, boots: DataFrame) -> DataFrame:
    """KPI-02: size of a package, dated at the first boot on the version named just before the size line."""
    targets = _hits(hits, "ota_target_check", "ota_target_upgrade").groupBy("device", "ts").agg(F.max(g("version")).alias("version"))
    sized = asof_join(_hits(hits, "ota_size").select("device", "ts", num("bytes").alias("bytes")), targets, ["device"], "ts",
                      tolerance_ms=TARGET_BEFORE_SIZE, prefix="t_").filter(F.col("t_version").isNotNull())
    sized = sized.withColumnRenamed("t_version", "version")
    at = boots.select("device", "version", F.col("eff_start").alias("b_start")).filter(F.col("version").isNotNull()).distinct()
    found = asof_join(sized, at, ["device", "version"], "ts", "b_start", direction="forward", allow_exact=False)
    return _samples(found.filter(F.col("b_start").isNotNull()), "ota_size", F.col("bytes") / 1e6, ts="b_start")


def boot_start(boots: DataFrame) -> DataFrame:
    """KPI-08: seconds from power-on to the boot's first service start."""
    ok = boots.filter(F.col("anchor").isNotNull() & F.col("svc_start").isNotNull())
    return _samples(ok, "boot_power_on", (F.col("svc_start") - F.col("anchor")) / 1000, ts="eff_start")


def cyclic_uptime(hits: DataFrame) -> DataFrame:
    """KPI-10: hours up at the end of a soak that a cyclic restart follows within two minutes."""
    restarts = _hits(hits, "shutdown_reason").filter(F.contains(g("reason"), F.lit("CYCLIC")) & (g("mode") == "restarting"))
    soak = _hits(hits, "soak_done").select("device", "ts")
    next_one = asof_join(soak, restarts.select("device", F.col("ts").alias("restart")).distinct(), ["device"], "ts", "restart",
                         direction="forward", tolerance_ms=120_000)
    up = _hits(hits, "uptime_long").groupBy("device", "ts").agg(F.max(num("s")).alias("s"))
    both = asof_join(next_one, up, ["device"], "ts", tolerance_ms=60_000, prefix="u_")
    return _samples(both.filter(F.col("restart").isNotNull() & F.col("u_s").isNotNull()), "cyclic_reboot_uptime", F.col("u_s") / 3600)


def abrupt_power(units: DataFrame, hits: DataFrame) -> DataFrame:
    """KPI-12: loss and reboot time of power-ons after an abrupt power cut, by kind of cut."""
    first = _hits(units, "sm_prev_shutdown").filter(F.col("unit").isNotNull()).groupBy("device", "unit").agg(
        F.min_by(g("reason"), "ts").alias("reason"))
    cap = F.contains("reason", F.lit("SUPERCAP_DISCHARGE"))
    bare = ~cap & F.col("reason").rlike(r"^:?(?:SHUTDOWN_STATE:)?POWER_DOWN\b")
    kinds = first.filter(~F.contains("reason", F.lit("SOFT_REBOOT")) & (cap | bare)).select("device", "unit", cap.alias("supercap"))
    frames = _hits(units, "first_frame").filter(F.col("unit").isNotNull()).groupBy("device", "unit").agg(
        F.min("ts").alias("frame"), F.max("anchor").alias("anchor"))
    at = kinds.join(frames, ["device", "unit"]).filter(F.col("anchor").isNotNull())
    alive = _hits(hits, "alive").select("device", F.col("ts").alias("alive")).distinct()
    seen = asof_join(at, alive, ["device"], "anchor", "alive", allow_exact=False)
    metric = F.when(F.col("supercap"), "down_abrupt_supercap").otherwise("down_abrupt")
    loss = _samples(seen.filter(F.col("alive").isNotNull()), metric, (F.col("frame") - F.col("alive")) / 1000, ts="frame")
    gap = F.col("frame") - F.col("anchor")
    return loss.unionByName(_samples(at.filter(gap <= SINCE_POWER_ON), "down_abrupt_reboot", gap / 1000, ts="frame"))


def update_outage(hits: DataFrame) -> DataFrame:
    """KPI-13: data session outage of an update: last loss or last line of the manager to the next connect."""
    start = scan(_hits(hits, "updater_start").select("device", "ts"), ["device"], "ts", lead={"next_ts": "ts"})
    up = _hits(hits, "data_connected").select("device", F.col("ts").alias("up")).distinct()
    got = asof_join(start, up, ["device"], "ts", "up", direction="forward", allow_exact=False, tolerance_ms=1_800_000)
    got = got.filter(F.col("up").isNotNull() & (F.col("next_ts").isNull() | (F.col("up") <= F.col("next_ts"))))
    lost = _hits(hits, "conn_session_lost", "conn_exit").select("device", F.col("ts").alias("lost")).distinct()
    quiet = _hits(hits, "alive").filter(g("svc") == "conn_mgr").select("device", F.col("ts").alias("quiet")).distinct()
    at = asof_join(got, lost, ["device"], "up", "lost", allow_exact=False)
    at = asof_join(at, quiet, ["device"], "up", "quiet", allow_exact=False)
    since = F.greatest(F.when(F.col("lost") >= F.col("ts"), F.col("lost")), F.when(F.col("quiet") >= F.col("ts"), F.col("quiet")))
    return _samples(at.filter(since.isNotNull()), "down_lte_ota", (F.col("up") - since) / 1000, ts="up")


def watchdog(units: DataFrame, powers: DataFrame, reasons: DataFrame, hits: DataFrame) -> DataFrame:
    """KPI-20: power-ons caused by the watchdog, and the time from the last sign of life to the restart."""
    hung = reasons.filter(F.contains("reasons", F.lit("WATCHDOG"))).select("device", "unit")
    p = powers.withColumn("unit", F.concat(F.lit("p"), F.col("segment").cast("string")))
    resets = p.join(hung, ["device", "unit"], "left_semi")
    first = _hits(units, "pm_start").groupBy("device", "unit").agg(F.min("ts").alias("started"))
    alive = _hits(hits, "alive").select("device", F.col("ts").alias("alive")).distinct()
    at = asof_join(resets.join(first, ["device", "unit"]), alive, ["device"], "ts", "alive", allow_exact=False)
    return _samples(resets, "wdt_resets", F.lit(1)).unionByName(_samples(
        at.filter(F.col("alive").isNotNull()), "wdt_reboot_time", (F.col("started") - F.col("alive")) / 1000, ts="started"))


def crash_share(hits: DataFrame, boots: DataFrame) -> DataFrame:
    """KPI-14: 1 or 0 per boot with drive time and camera: whether it crashed."""
    b = boots.select("device", "boot_index", F.col("eff_start").alias("b_start"), F.col("end").alias("b_end"))
    crashed = assign_interval(_hits(hits, "cam_crash"), b, ["device"], "ts", "b_start", "b_end", how="inner").select(
        "device", "boot_index", g("cam").cast("int").alias("cam")).distinct().withColumn("hit", F.lit(1))
    drove = boots.filter(F.col("drive_minutes") > 0).select("device", "boot_index", F.col("eff_start").alias("ts"),
                                                            F.explode(F.array(*[F.lit(c) for c in R.CAMS])).alias("cam"))
    rows = drove.join(crashed, ["device", "boot_index", "cam"], "left")
    return _samples(rows, F.concat(F.lit("crash_cam"), F.col("cam").cast("string"), F.lit("_pct")), F.coalesce("hit", F.lit(0)))


# ── alert sessions ───────────────────────────────────────────────────────────


def alert_lists(hits: DataFrame) -> DataFrame:
    """KPI-03: final alert lists with the session moved right after them and where it went."""
    moves = _hits(hits, "upload_state", "delete_state").select(
        "device", F.col("ts").alias("moved"), g("key").alias("session"),
        F.when(F.col("key") == "upload_state", "UPLOAD").otherwise("DELETE").alias("state"))
    lists = _hits(hits, "commn_set").select("device", "ts", F.regexp_extract_all(
        F.coalesce(g("codes"), F.lit("")), F.lit("'([^']*)'"), F.lit(1)).alias("codes"))
    return asof_join(lists, moves, ["device"], "ts", "moved", direction="forward", tolerance_ms=MOVE_AFTER_LIST,
                     tie=["session", "state"])


def alert_keys(hits: DataFrame, lists: DataFrame) -> DataFrame:
    """KPI-04: alert sessions: a non-empty list, or an event card."""
    named = lists.filter((F.size("codes") > 0) & F.col("session").isNotNull()).select("device", "session")
    return named.union(_hits(hits, "eventdata_ok").select("device", g("key").alias("session"))).distinct()


def alert_counts(lists: DataFrame) -> DataFrame:
    """KPI-05: number of alerts, by outcome."""
    some = lists.filter(F.size("codes") > 0)
    n = F.size("codes")
    return _all([_samples(some, "alerts_detected", n), _samples(some.filter("state = 'UPLOAD'"), "alerts_uploaded", n),
                 _samples(some.filter("state = 'DELETE'"), "alerts_not_uploaded", n)])


def alert_videos(hits: DataFrame, keys: DataFrame) -> DataFrame:
    """KPI-06: first upload per alert session and camera."""
    rows = _hits(hits, "video_ok").select("device", "ts", g("cam").alias("cam"), g("key").alias("session"))
    first = rows.join(keys, ["device", "session"], "left_semi").groupBy("device", "cam", "session").agg(F.min("ts").alias("ts"))
    return _samples(first, F.concat(F.lit("alerts_video_cam"), "cam"), F.lit(1))


def session_calls(hits: DataFrame) -> DataFrame:
    """Event calls with the session of the last summary on their thread (WIN-28)."""
    rows = _hits(hits, "eventdata_summary", "eventdata_call").select(
        "device", "ts", F.coalesce(g("tid"), F.lit("")).alias("tid"), "key", g("key").alias("session"))
    return carry_key(rows, ["device", "tid"], "ts", "session", ["key"]).filter(
        (F.col("key") == "eventdata_call") & F.col("session").isNotNull()).select("device", "ts", "session")


def alert_sessions(hits: DataFrame, lists: DataFrame, keys: DataFrame) -> DataFrame:
    """KPI-22: first time of every step of an alert session with a detection."""
    def rows(df: DataFrame, session: Column, step: Column | str) -> DataFrame:
        return df.select("device", session.alias("session"), (F.lit(step) if isinstance(step, str) else step).alias("step"), "ts")

    steps = _all([
        rows(_hits(hits, "lla_msg_send"), g("key"), "rt"), rows(_hits(hits, "upload_state"), g("key"), "nrt"),
        rows(lists.filter((F.size("codes") > 0) & F.col("session").isNotNull()), F.col("session"), "nrt"),
        rows(_hits(hits, "ialerts_found").filter(num("size") > EMPTY_INERTIAL_BYTES), g("key"), "inertial"),
        rows(session_calls(hits), F.col("session"), "api_call"), rows(_hits(hits, "eventdata_ok"), g("key"), "api_ok"),
        rows(_hits(hits, "vod_req"), g("key"), F.concat(F.lit("vod_req_cam"), g("cam"))),
        rows(_hits(hits, "video_ok"), g("key"), F.concat(F.lit("video_ok_cam"), g("cam"))),
    ])
    first = steps.groupBy("device", "session", "step").agg(F.min("ts").alias("ts"))

    def at(*names: str) -> Column:
        return F.min(F.when(F.col("step").isin(*names), F.col("ts")))

    cams = [f"{s}_cam{c}" for s in ("vod_req", "video_ok") for c in R.CAMS]
    wide = first.join(keys, ["device", "session"], "left_semi").groupBy("device", "session").agg(
        at("rt", "nrt", "inertial").alias("det"), at("rt", "nrt").alias("vision"),
        *[at(n).alias(n) for n in ("inertial", "api_call", "api_ok", *cams)],
        F.max(F.when(F.col("step").startswith("video_ok_cam"), F.col("ts"))).alias("total"))
    rec = F.regexp_extract("session", r"_(\d{13})_y$", 1).try_cast("bigint")
    return wide.filter(F.col("det").isNotNull()).withColumn("rec", rec)


def _step_rules() -> list[tuple[str, Column, Column, Column]]:
    """(metric, time, from, test) of every upload step (KPI-23)."""
    det, rec = F.col("det"), F.col("rec")
    rules = [("au_rec_start", det, rec, rec.isNotNull())]
    rules += [(m, F.col(c), rec, rec.isNotNull()) for m, c in (("au_inertial", "inertial"), ("au_vision", "vision"))]
    later = [("au_api_trigger", "api_call"), ("au_api_ok", "api_ok"), ("au_total", "total")]
    later += [(f"au_{s}_cam{c}", f"{s}_cam{c}") for s in ("vod_req", "video_ok") for c in R.CAMS]
    return rules + [(m, F.col(c), det, F.col(c) >= det) for m, c in later]


def alert_steps(sessions: DataFrame) -> DataFrame:
    """KPI-23: seconds of every step from the recording's start or the detection."""
    rules = [(test & t.isNotNull(), F.struct(F.lit(m).alias("m"), t.alias("t"), ((t - base) / 1000).alias("v")))
             for m, t, base, test in _step_rules()]
    return _samples(_tagged(sessions, rules), F.col("r.m"), F.col("r.v"), ts="r.t")


def alert_session_rows(hits: DataFrame, lists: DataFrame, keys: DataFrame, sessions: DataFrame) -> DataFrame:
    """KPI-24: one row per alert session: outcome, codes, calls, card, cameras and all step seconds."""
    by = ["device", "session"]
    lst = lists.filter((F.size("codes") > 0) & F.col("session").isNotNull()).groupBy(*by).agg(
        F.max_by(F.struct(F.col("ts").alias("processed"), "codes", "state"), "ts").alias("l"))
    calls = session_calls(hits).groupBy(*by).agg(F.count(F.lit(1)).alias("eventdata_calls"))
    cards = _hits(hits, "eventdata_ok").groupBy("device", g("key").alias("session")).agg(F.max("ts").alias("card_ts"))
    videos = _hits(hits, "video_ok").groupBy("device", g("key").alias("session")).agg(
        F.array_sort(F.collect_set(g("cam").cast("int"))).alias("videos"))
    out = keys.join(lst, by, "left").join(calls, by, "left").join(cards, by, "left").join(videos, by, "left").join(
        sessions, by, "left")
    secs = [F.round(F.when(test & t.isNotNull(), (t - base) / 1000), 3).alias(m) for m, t, base, test in _step_rules()]
    return out.select(*by, F.coalesce("l.processed", "det", "card_ts").alias("ts"), "l.processed", "l.codes", "l.state",
                      F.coalesce("eventdata_calls", F.lit(0)).alias("eventdata_calls"), F.col("card_ts").isNotNull().alias("card"),
                      "videos", "rec", *secs)


# ── upload batches, health uploads, low-latency alerts ───────────────────────


def batch_steps(hits: DataFrame) -> DataFrame:
    """KPI-25: steps of upload batches opened by a request line on their thread."""
    steps = ("obs_zip_start", "obs_zip_done", "obs_call", "obs_uploaded")
    rows = _hits(hits, "obs_req", *steps).select("device", "ts", F.coalesce(g("tid"), F.lit("")).alias("tid"), "key",
                                                 F.floor(num("rt") / 1000).alias("rt"))
    b = request_batches(rows.select("device", "tid", "ts", "key"), ["device", "tid"], "ts", "key", "obs_req", steps)
    req = F.col("request")
    rules = [(F.col(c).isNotNull(), F.struct(F.lit(m).alias("m"), F.col(c).alias("t"), ((F.col(c) - req) / 1000).alias("v")))
             for m, c in (("ou_files_added", "obs_zip_start"), ("ou_upload_start", "obs_call"), ("ou_upload_ok", "obs_uploaded"))]
    zipped = F.col("obs_zip_start").isNotNull() & F.col("obs_zip_done").isNotNull()
    rules.append((zipped, F.struct(F.lit("ou_zip").alias("m"), F.col("obs_zip_done").alias("t"),
                                   ((F.col("obs_zip_done") - F.col("obs_zip_start")) / 1000).alias("v"))))
    # A request time repeats for later batches and retries: its first line only
    first = rows.filter("key = 'obs_req'").groupBy("device", "rt").agg(F.min("ts").alias("ts")).filter(F.col("ts") >= F.col("rt"))
    return _samples(_tagged(b, rules), F.col("r.m"), F.col("r.v"), ts="r.t").unionByName(
        _samples(first, "ou_received", (F.col("ts") - F.col("rt")) / 1000))


def failed_uploads(hits: DataFrame) -> DataFrame:
    """Health uploads without a success before their thread's next call (WIN-30)."""
    def side(key: str) -> DataFrame:
        return _hits(hits, key).select("device", "ts", F.coalesce(g("thr"), F.lit("")).alias("thr"))

    return _samples(unanswered(side("hc_call"), side("hc_ok"), ["device", "thr"]), "hc_failed", F.lit(1))


def low_latency(hits: DataFrame) -> DataFrame:
    """KPI-27: steps of every low-latency alert, by uuid."""
    send = _hits(hits, "lla_msg_send").groupBy("device", g("uuid").alias("uuid")).agg(F.min_by(F.struct(
        F.col("ts").alias("det"), F.regexp_extract(g("key"), r"_(\d{13})_y$", 1).try_cast("bigint").alias("rec"),
        g("end").try_cast("bigint").alias("fin")), F.struct("ts", g("key"))).alias("s")).select("device", "uuid", "s.*")
    ndc = _hits(hits, "ndc_lla_message").select("device", F.col("ts").alias("ndc")).distinct()
    out = asof_join(send, ndc, ["device"], "det", "ndc", direction="forward", tolerance_ms=30_000)
    add = _hits(hits, "lla_hs_add").filter(g("n") == "0").groupBy("device", g("uuid").alias("uuid")).agg(
        F.min_by(g("add").cast("bigint"), "ts").alias("added"))
    tries = _hits(hits, "lla_hs_result").select("device", g("uuid").alias("uuid"), g("n").cast("int").alias("n"),
                                                g("start").cast("bigint").alias("b"), g("end").cast("bigint").alias("e"),
                                                g("status").alias("status"))
    order = F.struct("n", "b", "e", "status")
    passed = F.when(F.col("status") == "pass", order)
    att = tries.groupBy("device", "uuid").agg(
        F.min_by("b", order).alias("first_start"), F.min_by("e", order).alias("first_end"), F.min_by("e", passed).alias("passed"),
        F.max_by("n", order).alias("retries"), F.max_by("e", order).alias("last_end"))
    out = out.join(add, ["device", "uuid"], "left").join(att, ["device", "uuid"], "left")
    det = F.col("det")

    def rule(metric: str, t: Column, v: Column, test: Column):
        return test, F.struct(F.lit(metric).alias("m"), t.alias("t"), v.cast("double").alias("v"))

    rules = [rule("lla_rec_start", det, (det - F.col("rec")) / 1000, F.col("rec").isNotNull()),
             rule("lla_total", F.col("passed"), (F.col("passed") - F.col("fin")) / 1000,
                  F.col("passed").isNotNull() & F.col("fin").isNotNull()),
             rule("lla_retry_n", det, F.col("retries"), F.col("retries").isNotNull()),
             rule("lla_retry_s", det, (F.coalesce("passed", "last_end") - F.col("first_end")) / 1000, F.col("retries") > 0)]
    for m, c in (("lla_ndc_create", "ndc"), ("lla_ndc_notify", "added"), ("lla_api_trigger", "first_start"), ("lla_api_ok", "passed")):
        rules.append(rule(m, F.col(c), (F.col(c) - det) / 1000, F.col(c) >= det))
    return _samples(_tagged(out, rules), F.col("r.m"), F.col("r.v"), ts="r.t")


# ── everything ───────────────────────────────────────────────────────────────


def cameras(hits: DataFrame) -> DataFrame:
    """KPI-28: cameras every device named in its lines."""
    return _hits(hits, *R.CAM_LINES).select("device", g("cam").cast("int").alias("cam")).distinct()


def all_samples(hits: DataFrame, boots: DataFrame) -> DataFrame:
    """Samples of every metric.  ``boots`` need eff_start, anchor, svc_start, version and drive_minutes.

    The frames every family reads are settled once: power-ons, units and alert lists.
    """
    powers = settle(power_ons(hits))
    units = settle(with_units(hits, powers, boots))
    reasons = unit_reasons(units)
    lists = settle(alert_lists(hits))
    keys = alert_keys(hits, lists)
    sessions = alert_sessions(hits, lists, keys)
    return _all([
        counts(hits), pairs(hits, powers), since_power_on(units, reasons), first_values(units, reasons),
        after_ignition(units), simple_values(hits), bands(hits, boots), files(hits), frame_rates(hits), storage_root(hits),
        write_amplification(hits), package_sizes(hits, boots), boot_start(boots), cyclic_uptime(hits),
        abrupt_power(units, hits), update_outage(hits), watchdog(units, powers, reasons, hits), crash_share(hits, boots),
        alert_counts(lists), alert_videos(hits, keys), alert_steps(sessions), batch_steps(hits), failed_uploads(hits),
        low_latency(hits)])


def metric_table(like: DataFrame) -> DataFrame:
    """The registry as a frame: table, metric, unit, agg."""
    return like.sparkSession.createDataFrame(R.metrics(), "tab string, metric string, unit string, agg string")


def fallback_boots(boots: DataFrame, ranges: DataFrame) -> DataFrame:
    """KPI-29: ``boots`` and, for every device of ``ranges`` (device, lo, hi) without one, a boot 0 that takes its range.

    Such a boot began before the logs; ``fallback`` marks it.  An open end of a range is null.
    """
    alone = ranges.join(boots.select("device").distinct(), "device", "left_anti").select(
        "device", F.lit(0).cast(boots.schema["boot_index"].dataType).alias("boot_index"), F.coalesce("lo", F.lit(-(1 << 50))).alias("eff_start"), F.col("hi").alias("end"), F.lit(True).alias("fallback"))
    return boots.withColumn("fallback", F.lit(False)).unionByName(alone, allowMissingColumns=True)


def boot_codes(lists: DataFrame, boots: DataFrame) -> DataFrame:
    """KPI-29: alerts per boot and event code of the final alert lists."""
    b = boots.select("device", "boot_index", F.col("eff_start").alias("b_start"), F.col("end").alias("b_end"))
    placed = assign_interval(lists.select("device", "ts", "codes"), b, ["device"], "ts", "b_start", "b_end", how="inner")
    return code_counts(placed, ["device", "boot_index"])


def boot_samples(samples: DataFrame, hits: DataFrame, boots: DataFrame) -> DataFrame:
    """KPI-29: samples placed in boots; count metrics are 0 where their lines could have been logged.

    Optional cameras count only on devices that named them.  A boot marked ``fallback`` began before the logs, so it has no start-up
    metrics.
    """
    fallback = F.col("fallback") if "fallback" in boots.columns else F.lit(False)
    b = boots.select("device", "boot_index", F.col("eff_start").alias("b_start"), F.col("end").alias("b_end"), F.coalesce(fallback, F.lit(False)).alias("fallback"))
    placed = assign_interval(samples, b, ["device"], "ts", "b_start", "b_end", how="inner").select(
        "device", "boot_index", "metric", "ts", "value", "text", "fallback")
    marks = assign_interval(_hits(hits, *R.DETAILED, *R.ZERO_ONLY_WITH.values()).select("device", "key", "ts"), b, ["device"], "ts",
                            "b_start", "b_end", how="inner")
    seen = marks.groupBy("device", "boot_index").agg(
        F.bool_or(F.col("key").isin(*R.DETAILED)).alias("detailed"),
        *[F.bool_or(F.col("key") == k).alias(f"has_{k}") for k in R.ZERO_ONLY_WITH.values()])
    zeros = b.select("device", "boot_index", F.col("b_start").alias("ts"), "fallback").join(seen, ["device", "boot_index"], "left")
    sums = [(t, m) for t, m, _, agg in R.metrics() if agg == "sum"]
    tests = F.array(*[F.when(
        (F.lit(True) if m in R.CRITICAL_COUNTS else F.coalesce("detailed", F.lit(False)))
        & (F.coalesce(f"has_{R.ZERO_ONLY_WITH[t]}", F.lit(False)) if t in R.ZERO_ONLY_WITH else F.lit(True)), F.lit(m))
        for t, m in sums])
    zero = zeros.select("device", "boot_index", F.explode(F.filter(tests, lambda m: m.isNotNull())).alias("metric"), "ts",
                        F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("text"), "fallback")
    start_up = [m for t, m, _, _ in R.metrics() if t == R.START_UP]
    out = placed.unionByName(zero).filter(~(F.col("fallback") & F.col("metric").isin(*start_up))).drop("fallback")
    cam = F.regexp_extract("metric", r"_cam([4-8])(?:_pct)?$", 1).try_cast("int")
    own = cameras(hits).withColumn("own", F.lit(True))
    return (out.withColumn("cam", cam).join(own, ["device", "cam"], "left")
            .filter(F.col("cam").isNull() | F.col("own")).drop("cam", "own"))


def metric_agg(samples: DataFrame, registry: DataFrame, by: Sequence[str]) -> DataFrame:
    """AGG-34: value per group and metric by the metric's kind; sums never go below 0."""
    v = F.col("value")
    out = samples.join(registry.select("metric", "unit", "agg"), "metric").groupBy(*by, "metric", "unit", "agg").agg(
        F.sum(v).alias("s"), F.avg(v).alias("m"), F.max(v).alias("x"),
        F.max_by(v, F.struct("ts", "value")).alias("l"), F.max_by("text", F.struct("ts", "text")).alias("text"),
        F.count(F.lit(1)).alias("samples"))
    kind = F.col("agg")
    value = (F.when(kind == "sum", F.greatest("s", F.lit(0.0))).when(kind == "mean", F.col("m")).when(kind == "max", F.col("x"))
             .when(kind == "pct", 100 * F.col("m")).otherwise(F.col("l")))
    return out.withColumn("value", F.round(value, 3)).select(*by, "metric", "unit", "agg", "value", "text", "samples")


def p90(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """AGG-35: (by, p90) exact 90th percentile with linear interpolation of the groups that have values."""
    return quantiles(df, by, value, 0.9, "p90")


def fleet_kpis(device_values: DataFrame) -> DataFrame:
    """AGG-36: per metric the devices, P90, total (sums) or sample-weighted mean, and commonest text.

    Ties of the commonest text go to the smaller text.
    """
    device_values = settle(device_values.select("metric", "agg", "value", "samples", "text"))  # read three times
    v, n = F.col("value"), F.col("samples")
    text = device_values.filter(F.col("text").isNotNull()).groupBy("metric", "text").agg(F.count(F.lit(1)).alias("k"))
    common = text.groupBy("metric").agg(F.min_by("text", F.struct(-F.col("k"), F.col("text"))).alias("common"))
    out = device_values.groupBy("metric", "agg").agg(
        F.count(F.lit(1)).alias("devices"), F.sum(v).alias("s"), F.sum(v * n).alias("w"),
        F.sum(F.when(v.isNotNull(), n)).alias("n"))
    total = F.when(F.col("agg") == "sum", F.col("s")).when(F.col("agg").isin("mean", "pct"), F.col("w") / F.nullif("n", F.lit(0)))
    return out.join(common, "metric", "left").join(p90(device_values, ["metric", "agg"], "value"), ["metric", "agg"], "left").select("metric", "agg", "devices", "p90", total.alias("total"), "common",
                                                     F.col("n").alias("samples"))


def event_codes(device_codes: DataFrame) -> DataFrame:
    """AGG-36: per event code the alerts, devices and P90 of the devices' counts."""
    out = device_codes.groupBy("code").agg(F.sum("n").alias("alerts"), F.count(F.lit(1)).alias("devices"))
    return out.join(p90(device_codes, ["code"], "n"), "code")


def code_counts(lists: DataFrame, by: Sequence[str] = ("device",)) -> DataFrame:
    """Alerts per code of the final lists."""
    return lists.select(*by, F.explode("codes").alias("code")).groupBy(*by, "code").agg(F.count(F.lit(1)).alias("n"))


def baseline_table(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame(
        R.baselines(), "metric string, lo double, hi double, expect double, low_factor double, high_factor double")


def check_baselines(values: DataFrame, baselines: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """KPI-30: whether a value is outside what is expected, how far, and the expectation as text.

    ``overrides`` (metric, family, lo, hi) replace the range on rows of that family.
    """
    from tripline.functions.scalars import deviation

    rows = values.join(baselines, "metric")
    if overrides is not None:
        o = overrides.select("metric", "family", F.col("lo").alias("o_lo"), F.col("hi").alias("o_hi"))
        rows = rows.join(o, ["metric", "family"], "left")
        has = F.col("o_lo").isNotNull() | F.col("o_hi").isNotNull()
        rows = rows.withColumns({"lo": F.when(has, F.col("o_lo")).otherwise(F.col("lo")),
                                 "hi": F.when(has, F.col("o_hi")).otherwise(F.col("hi"))}).drop("o_lo", "o_hi")
    v, want = F.col("value"), F.col("expect")
    low, high = (F.when(want.isNotNull(), want * F.col(f)).otherwise(F.col(b)) for f, b in (("low_factor", "lo"), ("high_factor", "hi")))
    outside = F.coalesce((v < low) | (v > high), v < low, v > high, F.lit(False))
    text = (F.when(want.isNotNull(), F.concat(F.lit("about "), want.cast("string")))
            .when(low.isNull() & (high == 0), "= 0")
            .when(low.isNotNull() & high.isNotNull(), F.concat(low.cast("string"), F.lit("-"), high.cast("string")))
            .when(high.isNotNull(), F.concat(F.lit("<= "), high.cast("string")))
            .otherwise(F.concat(F.lit(">= "), low.cast("string"))))
    return rows.withColumns({"outside": outside, "off_by": F.when(outside, deviation("value", "lo", "hi", "expect")).otherwise(0.0),
                             "expected": text})
