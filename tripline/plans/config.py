"""Configuration: key coverage, overrides, feature status, comparison (CFG-01 .. CFG-08, JOI-23, AGG-41 .. AGG-45)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.functions import text as X

# Share of starts that makes a key normal; share of normal keys a full start logs
REFERENCE_SHARE = 0.5
MIN_COVERAGE = 0.8
NOT_OVERRIDDEN = r"No value present for key (\S+) in override dictionary"
MATCH, DIFF, UNKNOWN = "match", "diff", "unknown"


def key_coverage(lines: DataFrame, keys: DataFrame, boot: Sequence[str] = ("device", "boot_index")) -> DataFrame:
    """CFG-01: keys a first-start line of a boot names as a whole word, with the services that do.

    Lines become distinct words (dots included) and meet the keys by equality.
    """
    words = lines.select(*boot, "service", F.explode(F.array_distinct(F.regexp_extract_all(
        F.lower("line"), F.lit(r"([\w.]+)"), F.lit(1)))).alias("word")).distinct()
    return words.join(keys.select("key", F.lower("key").alias("word")), "word").groupBy(*boot, "key").agg(
        F.array_sort(F.collect_set("service")).alias("services"))


def failed_keys(boots: DataFrame, keys: DataFrame, covered: DataFrame,
                boot: Sequence[str] = ("device", "boot_index")) -> DataFrame:
    """CFG-01: keys no service of the boot named.

    The wanted keys ride along as one array per boot (a configuration has hundreds of keys),
    so boots and keys are never paired by a shuffle.
    """
    wanted = keys.agg(F.collect_set("key"))
    named = covered.groupBy(*boot).agg(F.collect_set("key").alias("named"))
    out = boots.select(*boot).distinct().join(named, list(boot), "left").withColumn("wanted", wanted.scalar())
    miss = F.array_except("wanted", F.coalesce("named", F.array().cast("array<string>")))
    return out.select(*boot, F.explode(F.array_sort(miss)).alias("key"))


def not_overridden(lines: DataFrame, boot: Sequence[str] = ("device", "boot_index")) -> DataFrame:
    """CFG-02: keys a service logged as not overridden, per boot."""
    key = F.regexp_extract("line", NOT_OVERRIDDEN, 1)
    return lines.filter(F.contains("line", F.lit("in override dictionary"))).select(
        *boot, "service", key.alias("key")).filter("key != ''").distinct()


def reference_counts(profiles: DataFrame, boot: Sequence[str] = ("device", "boot_index")) -> DataFrame:
    """CFG-03: per service its starts, and per key the starts that logged it."""
    starts = profiles.groupBy("service").agg(F.countDistinct(*boot).alias("starts"))
    keys = profiles.groupBy("service", "key").agg(F.countDistinct(*boot).alias("n"))
    return keys.join(starts, "service")


def merge_counts(*counts: DataFrame) -> DataFrame:
    """SET-04: counts of several runs added up; a key missing in a run still gets that run's starts."""
    keys, starts = None, None
    for c in counts:
        k = c.select("service", "key", "n")
        s = c.select("service", "starts").distinct()
        keys = k if keys is None else keys.unionByName(k)
        starts = s if starts is None else starts.unionByName(s)
    return keys.groupBy("service", "key").agg(F.sum("n").alias("n")).join(
        starts.groupBy("service").agg(F.sum("starts").alias("starts")), "service")


def key_reference(counts: DataFrame) -> DataFrame:
    """CFG-03: keys a service normally logs as not overridden."""
    return counts.filter(F.col("n") >= REFERENCE_SHARE * F.col("starts")).select("service", "key")


def boot_overrides(profiles: DataFrame, reference: DataFrame, boot: Sequence[str] = ("device", "boot_index")) -> DataFrame:
    """CFG-04: keys overridden in a boot: normal for a service that started fully, yet logged by none.

    Reference keys per service and logged keys per (boot, service) are arrays of a
    configuration's length.
    """
    ref = reference.groupBy("service").agg(F.collect_set("key").alias("expected"))
    logged = profiles.groupBy(*boot, "service").agg(F.collect_set("key").alias("keys"))
    full = logged.join(ref, "service").filter(
        F.size(F.array_intersect("keys", "expected")) >= MIN_COVERAGE * F.size("expected"))
    missing = full.select(*boot, F.explode(F.array_except("expected", "keys")).alias("key")).distinct()
    return missing.join(profiles.select(*boot, "key").distinct(), [*boot, "key"], "left_anti")


def exclude_overridden(fails: DataFrame, overridden: DataFrame, logged: DataFrame,
                       boot: Sequence[str] = ("device", "boot_index")) -> DataFrame:
    """FLT-10: failing keys without those the boot overrides or whose value it logged."""
    return (fails.join(overridden.select(*boot, "key"), [*boot, "key"], "left_anti")
            .join(logged.select(*boot, "key"), [*boot, "key"], "left_anti"))


def condition_states(units: DataFrame, features: DataFrame, defaults: DataFrame, overridden: DataFrame, values: DataFrame,
                     unit: Sequence[str] = ("device",)) -> DataFrame:
    """CFG-05: state of every feature condition per unit: logged value > overridden > default > missing.

    ``units`` carry ``version`` for the defaults.  Features are a short list; each unit gets the
    whole list as one array and explodes it.
    """
    flist = features.agg(F.collect_list(F.struct("feature", "section", "key", "expected")))
    rows = units.select(*unit, "version").withColumn("f", F.explode(flist.scalar())).select(*unit, "version", "f.*")
    rows = rows.join(values.select(*unit, "section", "key", F.col("value").alias("logged")), [*unit, "section", "key"], "left")
    rows = rows.join(overridden.select(*unit, "key").distinct().withColumn("ovr", F.lit(True)), [*unit, "key"], "left")
    rows = rows.join(defaults.select("version", "section", "key", F.col("value").alias("default")), ["version", "section", "key"], "left")
    state = (F.when(F.col("logged").isNotNull(), F.when(X.same_value("logged", "expected"), "log_ok").otherwise("log_off"))
             .when(F.col("ovr"), "ovr").when(F.col("default").isNull(), "na")
             .when(X.same_value("default", "expected"), "ok").otherwise("off"))
    return rows.select(*unit, "feature", "section", "key", state.alias("state"))


def feature_status(states: DataFrame, unit: Sequence[str] = ("device",)) -> DataFrame:
    """CFG-05: OFF > OVERRIDDEN > NA > ON over a feature's conditions."""
    s = F.col("state")
    rank = F.max(F.when(s.isin("off", "log_off"), 3).when(s == "ovr", 2).when(s == "na", 1).otherwise(0))
    return states.groupBy(*unit, "feature").agg(rank.alias("r")).select(
        *unit, "feature", F.element_at(F.array(*[F.lit(x) for x in ("ON", "NA", "OVERRIDDEN", "OFF")]), F.col("r") + 1).alias("status"))


def filter_by_features(status: DataFrame, names: Sequence[str], unit: Sequence[str] = ("device",)) -> DataFrame:
    """CFG-06: units with every named feature ON, with the reason for the others."""
    rows = status.filter(F.col("feature").isin(*names))
    off = F.when(F.col("status") != "ON", F.concat("feature", F.when(F.col("status") == "OFF", F.lit(" (off)")).otherwise(
        F.lit(" (a key is not in the config)"))))
    out = rows.groupBy(*unit).agg(F.bool_and(F.col("status") == "ON").alias("kept"), F.array_sort(F.collect_set(off)).alias("off"))
    return out.select(*unit, "kept", F.when(~F.col("kept"), F.concat(F.lit("Not enabled: "), F.array_join("off", ", "))).alias("reason"))


def compare_config(cloud: DataFrame, defaults: DataFrame, logged: DataFrame, plain: DataFrame, overridden: DataFrame,
                   unit: Sequence[str] = ("device",)) -> DataFrame:
    """JOI-23: every cloud key against logged value > overridden > default > missing.

    A key named alone (not overridden, overridden) counts only when it is in one section.
    ``defaults`` and ``cloud`` are per unit.
    """
    both = cloud.select(*unit, "section", "key").union(defaults.select(*unit, "section", "key")).distinct()
    one = both.groupBy(*unit, "key").agg((F.count(F.lit(1)) == 1).alias("one"))
    rows = cloud.select(*unit, "section", "key", F.col("value").alias("cloud"))
    rows = rows.join(one, [*unit, "key"]).join(
        defaults.select(*unit, "section", "key", F.col("value").alias("default")), [*unit, "section", "key"], "left").join(
        logged.select(*unit, "section", "key", F.col("value").alias("logged")), [*unit, "section", "key"], "left")
    for name, df in (("plain", plain), ("ovr", overridden)):
        rows = rows.join(df.select(*unit, "key").distinct().withColumn(name, F.lit(True)), [*unit, "key"], "left")
    ovr = F.coalesce(F.col("ovr") & F.col("one"), F.lit(False))
    source = (F.when(F.col("logged").isNotNull(), "log").when(ovr, "overridden")
              .when(F.col("default").isNotNull(), F.when(F.coalesce(F.col("plain") & F.col("one"), F.lit(False)), "default_confirmed")
                    .otherwise("default")).otherwise("missing"))
    device = F.coalesce("logged", F.when(~ovr, F.col("default")))
    status = F.when(device.isNull(), UNKNOWN).when(X.same_value(device, F.col("cloud")), MATCH).otherwise(DIFF)
    return rows.select(*unit, "section", "key", "cloud", device.alias("device_value"), status.alias("status"), source.alias("source"))


def config_verdict(rows: DataFrame, detailed: DataFrame | None = None, unit: Sequence[str] = ("device",)) -> DataFrame:
    """CFG-07: FAIL with a difference, PASS with a match, else UNVERIFIED; SKIPPED without detailed logs."""
    s = F.col("status")
    out = rows.groupBy(*unit).agg(F.count_if(s == MATCH).alias("matches"), F.count_if(s == DIFF).alias("diffs"),
                                  F.count_if(s == UNKNOWN).alias("unknowns"))
    verdict = F.when(F.col("diffs") > 0, "FAIL").when(F.col("matches") > 0, "PASS").otherwise("UNVERIFIED")
    if detailed is not None:
        out = out.join(detailed.select(*unit, "detailed"), list(unit), "left")
        verdict = F.when(~F.coalesce("detailed", F.lit(False)), "SKIPPED").otherwise(verdict)
        return out.withColumn("verdict", verdict).drop("detailed")
    return out.withColumn("verdict", verdict)


def remaining_conditions(features: DataFrame, plain: DataFrame, defaults: DataFrame,
                         unit: Sequence[str] = ("device",)) -> DataFrame:
    """CFG-08: feature keys a boot did not list as not overridden, with their default."""
    keys = features.select("section", "key").distinct()
    klist = keys.agg(F.collect_list(F.struct("section", "key")))
    rows = plain.select(*unit).distinct().withColumn("k", F.explode(klist.scalar())).select(*unit, "k.*")
    return rows.join(plain.select(*unit, "key").distinct(), [*unit, "key"], "left_anti").join(
        defaults.select("section", "key", F.col("value").alias("default")), ["section", "key"], "left")


def config_summary(checks: DataFrame, minutes: DataFrame) -> DataFrame:
    """AGG-45: devices per verdict over devices with drive time."""
    active = minutes.filter(F.col("minutes") > 0).select("device")
    return checks.join(active, "device", "left_semi").groupBy("verdict").agg(F.count(F.lit(1)).alias("devices"))


def differing_keys(rows: DataFrame) -> DataFrame:
    """AGG-45: keys by the number of devices that differ, most first."""
    return rows.filter(F.col("status") == DIFF).groupBy("section", "key").agg(
        F.countDistinct("device").alias("devices")).orderBy(F.desc("devices"), "section", "key")


def feature_coverage(status: DataFrame) -> DataFrame:
    """AGG-44: devices with a feature ON in any boot; features known on no device are left out."""
    per = status.groupBy("device", "feature").agg(F.bool_or(F.col("status") == "ON").alias("on"),
                                                  F.bool_or(F.col("status") != "NA").alias("known"))
    return per.groupBy("feature").agg(F.count_if("on").alias("devices_on"), F.bool_or("known").alias("known")).filter(
        "known").drop("known")


def feature_sets(status: DataFrame) -> DataFrame:
    """AGG-44: distinct sets of enabled features with their devices and the features they lack."""
    on = status.groupBy("device").agg(F.array_sort(F.collect_set(F.when(F.col("status") == "ON", F.col("feature")))).alias("features"))
    names = feature_coverage(status).agg(F.array_sort(F.collect_list("feature")))
    sets = on.groupBy("features").agg(F.count(F.lit(1)).alias("devices")).withColumn("all_names", names.scalar())
    return sets.select("features", "devices", F.array_except("all_names", "features").alias("missing"))

