"""Rule findings and device profiles (CFG-09, AGG-46 .. AGG-49)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tripline.operators.lists import SEGMENT, ranked, segmented_lists

# Drive minutes per expected call by api; shares and limits of the rules
PER_DRIVE_MINUTES = {1: 10, 2: 10, 8: 5, 7: 10, 10: 10}
FAR_BELOW, FAR_ABOVE = 0.5, 3.0
GAP_LIMIT_MIN, EVENT_MIN_DRIVE, HC_GAP_FACTOR = 30, 30, 1.5
FAIL_WARN, FAIL_CRIT, FAIL_MIN = 0.1, 0.5, 3
# Level of a finding and its points
LEVELS = {
    "zero": "critical", "far_below": "critical", "no_status_after_ota_change": "critical", "no_event": "critical",
    "no_video_with_events": "critical", "zero_with_drive": "critical", "below": "warning", "far_above": "warning",
    "gap_over_limit": "warning", "most_calls_failed": "critical", "calls_failing": "warning",
}
POINTS = {"critical": 3, "warning": 2, "info": 1}
AREA_CAP = 5


def api_findings(devices: DataFrame, apis: DataFrame, rates: dict[int, float] | None = None,
                 gated: DataFrame | None = None, health: DataFrame | None = None) -> DataFrame:
    """CFG-09: rule findings per device and api, as one expression over the device's call counts.

    ``devices``: device, minutes, other_versions (boolean); ``apis``: device, api, calls, ok, failed,
    gap_max (ms).  ``gated``: (device, api) whose feature is on, judged by gaps.  ``health``:
    device, calls, expected, gap_s, interval_s of the health uploads.
    """
    per = rates or PER_DRIVE_MINUTES
    calls = apis.groupBy("device").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("api").cast("int"), "calls"))).alias("calls"))
    rows = devices.join(calls, "device", "left").withColumn("calls", F.coalesce("calls", F.create_map().cast("map<int,bigint>")))

    def n(api: int):
        return F.coalesce(F.try_element_at("calls", F.lit(api)), F.lit(0))

    tests = []
    for api, minutes in per.items():
        expected = F.floor(F.col("minutes") / minutes)
        kind = (F.when(n(api) == 0, "zero").when(n(api) < FAR_BELOW * expected, "far_below").when(n(api) < expected, "below")
                .when(n(api) > FAR_ABOVE * expected, "far_above"))
        tests.append((kind.isNotNull() & (expected > 0), api, kind, n(api), expected))
    none = F.lit(None).cast("bigint")
    tests += [
        (F.col("other_versions") & (n(6) == 0), 6, F.lit("no_status_after_ota_change"), n(5), none),
        ((F.col("minutes") > EVENT_MIN_DRIVE) & (n(3) == 0), 3, F.lit("no_event"), n(3), none),
        ((n(3) > 0) & (n(9) == 0), 9, F.lit("no_video_with_events"), n(9), none),
    ]
    found = F.array(*[F.when(test, F.struct(F.lit(api).alias("api"), kind.alias("kind"), count.cast("bigint").alias("n"),
                                            expected.cast("bigint").alias("expected"))) for test, api, kind, count, expected in tests])
    out = rows.select("device", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("device", "f.*")
    done = F.col("ok") + F.col("failed")
    failing = apis.filter((F.col("failed") >= FAIL_MIN) & (F.col("failed") >= FAIL_WARN * done)).select(
        "device", F.col("api").cast("int").alias("api"),
        F.when(F.col("failed") >= FAIL_CRIT * done, "most_calls_failed").otherwise("calls_failing").alias("kind"),
        F.col("failed").cast("bigint").alias("n"), done.cast("bigint").alias("expected"))
    out = out.unionByName(failing)
    if gated is not None:
        g = gated.select("device", "api").join(devices.select("device", "minutes"), "device").join(
            apis.select("device", "api", "calls", "gap_max"), ["device", "api"], "left")
        zero = (F.coalesce("calls", F.lit(0)) == 0) & (F.col("minutes") > GAP_LIMIT_MIN)
        gap = F.col("gap_max") > GAP_LIMIT_MIN * 60_000
        out = out.unionByName(g.filter(zero | gap).select(
            "device", F.col("api").cast("int").alias("api"), F.when(zero, "zero_with_drive").otherwise("gap_over_limit").alias("kind"),
            F.coalesce("calls", F.lit(0)).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("expected")))
    if health is not None:
        kind = (F.when(F.col("calls") == 0, "zero").when(F.col("calls") < FAR_BELOW * F.col("expected"), "far_below")
                .when(F.col("calls") < F.col("expected"), "below"))
        late = F.when(F.col("gap_s") > HC_GAP_FACTOR * F.col("interval_s"), "gap_over_limit")
        kinds = F.filter(F.array(F.when(F.col("expected") > 0, kind), late), lambda k: k.isNotNull())
        out = out.unionByName(health.select("device", F.lit(28).alias("api"), F.explode(kinds).alias("kind"),
                                            F.col("calls").cast("bigint").alias("n"), F.col("expected").cast("bigint").alias("expected")))
    levels = F.create_map(*[F.lit(x) for k, v in LEVELS.items() for x in (k, v)])
    return out.withColumn("level", F.coalesce(F.try_element_at(levels, F.col("kind")), F.lit("info")))


def device_profiles(findings: DataFrame, areas: DataFrame) -> DataFrame:
    """AGG-46: score and affected areas per device with any issue.

    ``areas``: device, failing_tests, missed_kpis, failing_keys, cloud_fail.  Tests and metrics
    score at most five points each, failing keys and a failed cloud check two each.
    """
    pts = F.create_map(*[F.lit(x) for k, v in POINTS.items() for x in (k, v)])
    api = findings.groupBy("device").agg(F.count(F.lit(1)).alias("api_issues"),
                                         F.sum(F.try_element_at(pts, F.col("level"))).alias("api_points"))
    rows = areas.join(api, "device", "full_outer")
    num = {c: F.coalesce(c, F.lit(0)) for c in ("api_issues", "api_points", "failing_tests", "missed_kpis", "failing_keys")}
    rows = rows.withColumns({**num, "cloud_fail": F.coalesce("cloud_fail", F.lit(False))})
    on = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in (
        ("api", F.col("api_issues") > 0), ("tests", F.col("failing_tests") > 0), ("config", F.col("failing_keys") > 0),
        ("kpi", F.col("missed_kpis") > 0), ("cloud_config", F.col("cloud_fail")))]), lambda a: a.isNotNull())
    score = (F.col("api_points") + F.least("failing_tests", F.lit(AREA_CAP)) + F.least("missed_kpis", F.lit(AREA_CAP))
             + F.when(F.col("failing_keys") > 0, 2).otherwise(0) + F.when(F.col("cloud_fail"), 2).otherwise(0))
    return rows.withColumns({"areas": on, "score": score}).filter(F.size("areas") > 0).withColumn(
        "multi_issue", (F.size("areas") >= 2) | (F.col("api_issues") >= 3))


def rank_profiles(profiles: DataFrame) -> DataFrame:
    """AGG-46: rank by score, then device; a score that very many devices share is ranked by many tasks."""
    return ranked(profiles.withColumn("__order", -F.col("score")), ["__order", "device"], "rank").drop("__order")


def issue_labels(findings: DataFrame, profiles: DataFrame) -> DataFrame:
    """(device, label) of every finding and every other affected area."""
    api = findings.select("device", F.concat(F.col("api").cast("string"), F.lit(": "), "kind").alias("label"))
    area = profiles.select("device", F.explode("areas").alias("label")).filter("label != 'api'")
    return api.union(area).distinct()


def issue_pairs(labels: DataFrame, k: int = 10, sample: int = 5) -> DataFrame:
    """AGG-47: pairs of issues on the same devices (two or more), the k commonest with sample devices.

    A device has at most a few dozen labels, so its pairs are made inside its row.
    """
    per = labels.groupBy("device").agg(F.array_sort(F.collect_set("label")).alias("ls"))
    pairs = F.flatten(F.transform("ls", lambda a, i: F.transform(
        F.filter("ls", lambda b, j: j > i), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = per.select("device", F.explode(pairs).alias("p")).select("device", "p.a", "p.b")
    counted = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("devices")).filter("devices >= 2")
    top = counted.orderBy(F.desc("devices"), "a", "b").limit(k)
    w = W.partitionBy("a", "b").orderBy("device")
    names = (rows.join(F.broadcast(top.select("a", "b")), ["a", "b"], "left_semi").withColumn("r", F.row_number().over(w))
             .filter(F.col("r") <= sample).groupBy("a", "b").agg(F.array_sort(F.collect_list("device")).alias("sample_devices")))
    return top.join(names, ["a", "b"])


def concentration(ranked: DataFrame) -> DataFrame:
    """AGG-48: share of all points held by the top fifth of the devices (at least one)."""
    n = ranked.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"), F.count_if(F.col("multi_issue")).alias("multi")))
    top = F.greatest(F.floor(F.col("n") / 5), F.lit(1))
    return ranked.withColumn("t", n.scalar()).select("rank", "score", "t.*").groupBy("n", "total", "multi").agg(
        F.sum(F.when(F.col("rank") <= top, F.col("score")).otherwise(0)).alias("held")).select(
        F.col("n").alias("devices_with_issues"), F.col("multi").alias("multi_issue_devices"), top.alias("top_devices"),
        F.round(100 * F.col("held") / F.greatest("total", F.lit(1))).alias("top_share_pct"))


def kpi_outliers(checked_devices: DataFrame, checked_fleet: DataFrame) -> DataFrame:
    """AGG-49: metrics outside their expectation at P90 or on a device, with the devices furthest off first."""
    out = checked_devices.filter("outside").groupBy("metric").agg(
        F.count(F.lit(1)).alias("outside_count"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("off_by")).alias("k"), "device", "value"))),
                    lambda x: x["device"]).alias("devices"))
    fleet = checked_fleet.select("metric", "expected", F.col("value").alias("p90"), F.col("outside").alias("p90_outside"))
    return fleet.join(out, "metric", "left").filter(F.col("p90_outside") | F.col("outside_count").isNotNull()).withColumn(
        "outside_count", F.coalesce("outside_count", F.lit(0)))


def outlier_devices(checked_devices: DataFrame, size: int = SEGMENT) -> DataFrame:
    """AGG-49: the devices outside of every metric, furthest off first, in parts of ``size``."""
    rows = checked_devices.filter("outside").groupBy("metric", "device").agg((-F.max("off_by")).alias("nearness"))
    return segmented_lists(rows, ["metric"], "device", size, ["nearness"], "devices")


def missed_per_device(checked_devices: DataFrame) -> DataFrame:
    """AGG-49: metrics a device misses."""
    return checked_devices.filter("outside").groupBy("device").agg(F.count(F.lit(1)).alias("missed"))
