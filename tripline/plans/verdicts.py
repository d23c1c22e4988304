"""Test verdicts per boot from ordered log steps (WIN-41 .. WIN-44) and their roll-ups (AGG-41 .. AGG-43)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tripline.operators.timeline import scan

VERDICTS = ("PASS", "FAIL", "NOT_TRIGGERED", "CONDITION_NOT_MET", "NOT_APPLICABLE", "NO_LOG_CHECKS")

# hits:  device, boot_index, test, step_no, alt (index of the step's pattern), ts
# steps: test, step_no, mode (any / all), expect (present / absent / info), alts (number of patterns); optional device_types (array):
#        the types of device the step is made for, null or empty for all
# boots: device, boot_index, start; optional device_type, null where it is not known: every step counts
_BOOT = ["device", "boot_index"]


def thin_hits(hits: DataFrame, breaks: DataFrame | None = None) -> DataFrame:
    """Hits that can decide a verdict: of a run of hits of one pattern only the first.

    A step looks for the first match at or after a cursor, and a cursor is a match of another
    step, a boot's start or one of the ``breaks`` (device, boot_index, test, ts).  Between two
    neighbouring times at which only the same pattern matched there is no such cursor, so the
    later one is never the answer.  A pattern that matches every line thus leaves few rows.
    """
    key = [*_BOOT, "test"]
    rows = hits.select(*key, "ts", F.struct("step_no", "alt").alias("kind"))
    if breaks is not None:
        mark = F.struct(F.lit(-1).alias("step_no"), F.lit(-1).alias("alt"))
        rows = rows.unionByName(breaks.select(*key, "ts", mark.alias("kind")))
    at = rows.groupBy(*key, "ts").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    seen = scan(at, key, "ts", lag={"before": "kinds"})
    same = (F.size("kinds") == 1) & F.col("kinds").eqNullSafe(F.col("before"))
    return seen.filter(~same).select(*key, F.explode("kinds").alias("kind"), "ts").filter("kind.step_no >= 0").select(
        *key, "kind.step_no", "kind.alt", "ts")


def _step_arrays(hits: DataFrame, key: Sequence[str]) -> DataFrame:
    """Sorted match times per (key, step, pattern), gathered to one row per key, of thinned hits."""
    alts = hits.groupBy(*key, "step_no", "alt").agg(F.array_sort(F.collect_list("ts")).alias("times"))
    steps = alts.groupBy(*key, "step_no").agg(F.map_from_entries(F.collect_list(F.struct("alt", "times"))).alias("alts"))
    return steps.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("step_no", "alts"))).alias("by_step"))


def _device_type(boots: DataFrame) -> Column:
    return (F.col("device_type") if "device_type" in boots.columns else F.lit(None)).cast("string").alias("device_type")


def _fits(types: Column, device_type: Column) -> Column:
    """Whether something made for ``types`` of devices counts on a device."""
    return types.isNull() | (F.size(types) == 0) | device_type.isNull() | F.array_contains(types, device_type)


def _walk(cursor: Column) -> Column:
    """Fold the ``steps`` in order, moving the cursor to every match; one status per step.

    A step that is not made for the row's ``device_type`` is NOT_FOR_DEVICE: it is not looked for, and the cursor stays.  Informational steps
    are wanted only where no expected step counts; the others that are not found say so with INFO_ in front.
    """
    none = F.lit(None).cast("bigint")
    fits = lambda s: _fits(s["device_types"], F.col("device_type"))
    expected = F.exists(F.col("steps"), lambda s: fits(s) & (s["expect"] == "present"))

    def step(state: Column, s: Column) -> Column:
        alts = F.try_element_at(F.col("by_step"), s["step_no"])
        count = s["alts"]
        nexts = F.transform(F.sequence(F.lit(0), count - 1), lambda a: F.struct(
            F.array_min(F.filter(F.coalesce(F.try_element_at(alts, a.cast("int")), F.array().cast("array<bigint>")),
                                 lambda t: t >= state["cursor"])).alias("next"),
            F.coalesce(F.size(F.try_element_at(alts, a.cast("int"))) > 0, F.lit(False)).alias("ever")))
        found = F.filter(nexts, lambda n: n["next"].isNotNull())
        times = F.transform(found, lambda n: n["next"])
        hit_all = (s["mode"] == "all") & (F.size(found) == count)
        hit_any = (s["mode"] != "all") & (F.size(found) > 0)
        hit = fits(s) & (s["expect"] != "absent") & (hit_all | hit_any)
        at = F.when(hit_all, F.array_max(times)).otherwise(F.array_min(times))
        # The first alternative that was not found names the failure
        missing = F.get(F.filter(nexts, lambda n: n["next"].isNull()), F.lit(0))["ever"]
        bad = F.when(F.coalesce(missing, F.lit(False)), "OUT_OF_ORDER").otherwise("NOT_FOUND")
        status = (F.when(~fits(s), "NOT_FOR_DEVICE").when(s["expect"] == "absent", F.when(F.size(found) > 0, "FAIL").otherwise("PASS"))
                  .when(hit, "PASS").when((s["expect"] == "info") & expected, F.concat(F.lit("INFO_"), bad)).otherwise(bad))
        return F.struct(F.when(hit, at).otherwise(state["cursor"]).alias("cursor"),
                        F.concat(state["out"], F.array(F.struct(
                            s["step_no"].alias("step_no"), s["expect"].alias("expect"), status.alias("status"),
                            F.when(hit, at).otherwise(none).alias("match_ts")))).alias("out"))

    empty = F.array().cast("array<struct<step_no:int,expect:string,status:string,match_ts:bigint>>")
    return F.aggregate(F.col("steps"), F.struct(cursor.cast("bigint").alias("cursor"), empty.alias("out")), step,
                       lambda s: s["out"])


def _judge(all_results: Column) -> Column:
    results = F.filter(all_results, lambda r: r["status"] != "NOT_FOR_DEVICE")
    present = F.exists(results, lambda r: r["expect"] == "present")
    # Informational steps are required only in tests without an expected one
    required = F.filter(results, lambda r: (r["expect"] == "present") | (r["expect"] == "absent")
                        | ((r["expect"] == "info") & ~present))
    positive = F.filter(required, lambda r: r["expect"] != "absent")
    untouched = (F.size(positive) > 0) & F.forall(positive, lambda r: r["status"] == "NOT_FOUND")
    failed = F.filter(required, lambda r: r["status"] != "PASS")
    first = F.get(failed, F.lit(0))
    what = F.when(first["status"] == "NOT_FOUND", "not found").when(
        first["status"] == "OUT_OF_ORDER", "only found before the previous step").otherwise("found but expected absent")
    return F.when(F.size(results) == 0, F.struct(F.lit("NOT_APPLICABLE").alias("verdict"), F.concat(F.lit("Not run on "), F.col("device_type")).alias("reason"))
    ).when(untouched, F.struct(F.lit("NOT_TRIGGERED").alias("verdict"),
                                      F.lit("None of the expected log lines appear in this boot").alias("reason"))).when(
        F.size(failed) == 0, F.struct(F.lit("PASS").alias("verdict"), F.lit("All expected log lines found in order").alias("reason"))
    ).otherwise(F.struct(F.lit("FAIL").alias("verdict"), F.concat(
        F.lit("step "), first["step_no"].cast("string"), F.lit(" "), what).alias("reason")))


def _test_table(steps: DataFrame) -> DataFrame:
    """One row per test with its steps in order: as long as the test suite."""
    types = F.col("device_types") if "device_types" in steps.columns else F.lit(None)
    cols = F.struct("step_no", "mode", "expect", "alts", types.cast("array<string>").alias("device_types"))
    return steps.groupBy("test").agg(F.array_sort(F.collect_list(cols)).alias("steps"))


def evaluate_steps(hits: DataFrame, steps: DataFrame, boots: DataFrame, cursor: str | None = None) -> DataFrame:
    """WIN-41: verdict of every test in every boot.

    Each step must match at or after the match before it; a step with several patterns needs
    one of them (``any``) or all.  Steps for other types of device are left out; a test of which no step is left is
    NOT_APPLICABLE.  Boots without a hit of a test are judged without a fold.
    """
    tests = _test_table(steps)
    table = tests.agg(F.collect_list(F.struct("test", "steps")))
    rows = boots.select(*_BOOT, F.coalesce(F.col(cursor or "start"), F.lit(0)).alias("cursor"), _device_type(boots)).withColumn(
        "t", F.explode(table.scalar())).select(*_BOOT, "cursor", "device_type", "t.test", "t.steps")
    key = [*_BOOT, "test"]
    breaks = rows.select(*key, F.col("cursor").alias("ts")) if cursor else None
    rows = rows.join(_step_arrays(thin_hits(hits, breaks), key), key, "left")
    none = F.create_map().cast("map<int,map<int,array<bigint>>>")
    rows = rows.withColumn("by_step", F.coalesce("by_step", none))
    out = rows.withColumn("results", _walk(F.col("cursor")))
    judged = out.withColumn("j", _judge(F.col("results")))
    return judged.select(*key, "j.verdict", "j.reason", F.transform("results", lambda r: r["match_ts"]).alias("match_ts"))


def applicable(verdicts: DataFrame, tests: DataFrame, boots: DataFrame) -> DataFrame:
    """WIN-41: tests not made for a boot's device type become NOT_APPLICABLE."""
    t = tests.select("test", "device_types")
    rows = verdicts.join(t, "test", "left").join(boots.select(*_BOOT, "device_type"), _BOOT)
    fits = _fits(F.col("device_types"), F.col("device_type"))
    return rows.withColumns({"verdict": F.when(fits, F.col("verdict")).otherwise("NOT_APPLICABLE"),
                             "reason": F.when(fits, F.col("reason")).otherwise(F.concat(F.lit("Not run on "), "device_type"))}
                            ).drop("device_types", "device_type")


def evaluate_in_windows(hits: DataFrame, steps: DataFrame, boots: DataFrame, windows: DataFrame, most: int | None = None) -> DataFrame:
    """WIN-42: verdicts judged only where a test started inside a state window (all, or the first ``most`` of a boot).

    The first window with a starting line that gives PASS or FAIL decides.  Without one the
    test is NOT_TRIGGERED when it never started, else CONDITION_NOT_MET.
    """
    w = W.partitionBy(*_BOOT).orderBy("start")
    wins = windows.withColumn("w", F.row_number().over(w))
    if most is not None:
        wins = wins.filter(F.col("w") <= most)
    # a test starts with its first expected step that counts on the device
    tests = _test_table(steps).agg(F.collect_list(F.struct("test", "steps")))
    per = boots.select(*_BOOT, _device_type(boots)).withColumn("t", F.explode(tests.scalar()))
    starting = F.get(F.filter("t.steps", lambda s: (s["expect"] != "absent") & _fits(s["device_types"], F.col("device_type"))), F.lit(0))
    trigger = per.select(*_BOOT, "t.test", starting["step_no"].alias("step_no"))
    first = hits.join(trigger, [*_BOOT, "test", "step_no"], "left_semi").select(*_BOOT, "test", "ts").distinct()
    started = first.join(wins.select(*_BOOT, "w", F.col("start").alias("lo"), F.col("end").alias("hi")), _BOOT).filter(
        (F.col("ts") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("ts") < F.col("hi")))).select(*_BOOT, "test", "w", "lo").distinct()
    starts = boots.select(*_BOOT, F.coalesce("start", F.lit(0)).alias("b_start"), _device_type(boots))
    key = [*_BOOT, "test", "w"]
    rows = started.join(starts, _BOOT).withColumn("cursor", F.greatest("lo", "b_start"))
    kept = thin_hits(hits, rows.select(*_BOOT, "test", F.col("cursor").alias("ts")))
    rows = rows.join(_test_table(steps), "test").join(_step_arrays(kept, [*_BOOT, "test"]), [*_BOOT, "test"])
    judged = rows.withColumn("j", _judge(_walk(F.col("cursor")))).select(*key, "j.verdict", "j.reason").filter(
        F.col("verdict").isin("PASS", "FAIL"))
    best = judged.groupBy(*_BOOT, "test").agg(F.min_by(F.struct("verdict", "reason"), "w").alias("b"))
    whole = evaluate_steps(hits, steps, boots)
    has_window = wins.select(*_BOOT).distinct().withColumn("has_window", F.lit(True))
    out = whole.join(best, [*_BOOT, "test"], "left").join(has_window, _BOOT, "left")
    never = F.col("has_window").isNull()
    left_out = F.col("verdict") == "NOT_APPLICABLE"
    verdict = (F.when(left_out, F.col("verdict")).when(never, "CONDITION_NOT_MET").when(F.col("b").isNotNull(), F.col("b.verdict"))
               .when(F.col("verdict") == "NOT_TRIGGERED", "NOT_TRIGGERED").otherwise("CONDITION_NOT_MET"))
    reason = (F.when(left_out, F.col("reason")).when(never, "The boot never had the state").when(F.col("b").isNotNull(), F.col("b.reason"))
              .when(F.col("verdict") == "NOT_TRIGGERED", F.col("reason"))
              .otherwise("Its log lines only appear while the boot did not have the state"))
    return out.select(*_BOOT, "test", verdict.alias("verdict"), reason.alias("reason"))


def gate_by_features(verdicts: DataFrame, test_features: DataFrame, status: DataFrame) -> DataFrame:
    """WIN-43: tests whose named features are all OFF in a boot become CONDITION_NOT_MET."""
    named = verdicts.select(*_BOOT, "test").join(test_features.select("test", "feature"), "test")
    known = named.join(status.select(*_BOOT, "feature", "status"), [*_BOOT, "feature"], "left")
    off = known.groupBy(*_BOOT, "test").agg(F.bool_and(F.coalesce(F.col("status") == "OFF", F.lit(False))).alias("off"))
    out = verdicts.join(off, [*_BOOT, "test"], "left")
    gate = F.coalesce("off", F.lit(False)) & ~F.col("verdict").isin("NOT_APPLICABLE", "NO_LOG_CHECKS")
    return out.withColumn("verdict", F.when(gate, "CONDITION_NOT_MET").otherwise(F.col("verdict"))).drop("off")


def usable_requirements(requirements: DataFrame, rules: DataFrame) -> DataFrame:
    """WIN-44: required dimensions all of whose values some rule detects (test, dimension, values)."""
    known = rules.select("dimension", "value").distinct().withColumn("known", F.lit(True))
    rows = requirements.select("test", "dimension", "value").distinct().join(known, ["dimension", "value"], "left")
    return rows.groupBy("test", "dimension").agg(F.array_sort(F.collect_list("value")).alias("values"),
                                                 F.bool_and(F.col("known").isNotNull()).alias("ok")).filter("ok").drop("ok")


# ── roll-ups ─────────────────────────────────────────────────────────────────


def verdict_rollup(verdicts: DataFrame, test_features: DataFrame | None = None) -> DataFrame:
    """AGG-41: boots per verdict of every test (and feature group)."""
    rows, keys = verdicts, ["test"]
    if test_features is not None:
        rows, keys = verdicts.join(test_features.select("test", "feature"), "test"), ["feature", "test"]
    return rows.groupBy(*keys).agg(*[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in VERDICTS[:4]])


def failing_boots(verdicts: DataFrame) -> DataFrame:
    """AGG-41: boots every test failed in."""
    return verdicts.filter("verdict = 'FAIL'").select("test", *_BOOT)


def failing_keys(fails: DataFrame, boots_checked: DataFrame) -> DataFrame:
    """AGG-41: boots per failing key, with the number of boots checked."""
    n = boots_checked.select(*_BOOT).distinct().agg(F.count(F.lit(1)))
    return fails.groupBy("key").agg(F.count(F.lit(1)).alias("failed_boots")).withColumn("boots_checked", n.scalar())


def feature_level(rollup: DataFrame) -> DataFrame:
    """AGG-42: tests per feature by their outcome, most failing first."""
    trig = (F.col("pass") > 0) | (F.col("fail") > 0)
    cnm = ~trig & (F.col("condition_not_met") > 0)
    out = rollup.groupBy("feature").agg(
        F.count(F.lit(1)).alias("tests"), F.count_if(trig).alias("triggered"),
        F.count_if(trig & (F.col("fail") == 0)).alias("passed"), F.count_if(F.col("fail") > 0).alias("failed"),
        F.count_if(~trig & ~cnm).alias("not_triggered"), F.count_if(cnm).alias("condition_not_met"))
    rate = F.col("failed") / F.col("tests")
    return out.withColumn("fail_pct", 100 * rate).orderBy(F.desc("failed"), F.desc("fail_pct"), F.lower("feature"))


def report_summary(given: DataFrame, info: DataFrame, boots: DataFrame) -> DataFrame:
    """AGG-43 / SET-03: one row per given device: where it belongs, its boots and minutes.

    ``info``: device, days, detailed_days; ``boots``: device, drive_minutes, low_power of the report's version.
    """
    per = boots.groupBy("device").agg(F.count(F.lit(1)).alias("boots"), F.sum("drive_minutes").alias("minutes"),
                                      F.bool_or("low_power").alias("low_power"))
    out = given.select("device").distinct().join(info, "device", "left").join(per, "device", "left")
    days, det = F.coalesce("days", F.lit(0)), F.coalesce("detailed_days", F.lit(0))
    part = (F.when(days == 0, "no_logs").when(F.col("boots").isNotNull(), F.when(det > 0, "detailed").otherwise("on_version"))
            .when(det == 0, "critical_only").otherwise("other_version"))
    m = F.coalesce("minutes", F.lit(0))
    return out.select("device", part.alias("part"), F.coalesce("boots", F.lit(0)).alias("boots"), m.alias("minutes"),
                      F.when(F.col("boots").isNotNull(), F.when(m <= 360, "up_to_6h").when(m <= 1440, "over_6h").otherwise("over_24h"))
                      .alias("drive_class"), F.coalesce("low_power", F.lit(False)).alias("low_power"))


def summary_counts(summary: DataFrame) -> DataFrame:
    """AGG-43: devices per part of a report."""
    c = F.col("drive_class")
    return summary.agg(
        F.count(F.lit(1)).alias("given"), F.count_if(F.col("part") == "no_logs").alias("no_logs"),
        F.count_if(F.col("part") == "other_version").alias("other_version"),
        F.count_if(F.col("part") == "critical_only").alias("critical_only"), F.count_if(F.col("part") == "detailed").alias("detailed"),
        F.sum("boots").alias("boots"), F.sum("minutes").alias("minutes"), F.count_if(c == "up_to_6h").alias("up_to_6h"),
        F.count_if(c.isin("over_6h", "over_24h")).alias("over_6h"), F.count_if(c == "over_24h").alias("over_24h"),
        F.count_if(F.col("low_power")).alias("low_power"))
