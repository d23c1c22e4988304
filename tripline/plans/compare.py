"""Two reports side by side (JOI-24, AGG-50, AGG-51, SET-02)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.functions import scalars as S
from tripline.functions import text as X

# Noise threshold in %, rows of the code comparison, basis of a metric table
NOISE_PCT = 10
CODE_ROWS = 25
TABLE_BASIS = {
    "kpi-boot": "boot", "kpi-downtime": "boot", "kpi-crash": "boot", "kpi-watchdog": "boot", "kpi-alerts": "drive_h",
    "kpi-retry": "drive_h", "kpi-lla": "drive_h",
}


def compare_reports(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """JOI-24: rows of either report with both values and the change from a to b in %."""
    left, right = (df.select(*keys, F.col(value).alias(n)) for df, n in ((a, "a"), (b, "b")))
    return left.join(right, list(keys), "full_outer").withColumn("change_pct", S.change_pct("a", "b"))


def differs(a: Column | str, b: Column | str, noise: float = NOISE_PCT) -> Column:
    """A change beyond the noise, or from or to zero."""
    c = S.change_pct(a, b)
    return F.coalesce(F.abs(c) >= noise, F.lit(False))


def set_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """SET-02: keys with the side they are on: a, b or both."""
    both = a.select(key).distinct().withColumn("in_a", F.lit(True)).join(
        b.select(key).distinct().withColumn("in_b", F.lit(True)), key, "full_outer")
    return both.select(key, F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "a").otherwise("b").alias("side"))


# label, numerator, denominator (None: a count), more is worse (None: neither)
_OVERVIEW = (
    ("devices", "devices", None, None), ("boots", "boots", None, None), ("drive_hours", "hours", None, None),
    ("hours_per_device", "hours", "devices", None), ("boots_per_device", "boots", "devices", None),
    ("drives_per_hour", "drives", "hours", None), ("short_drives_pct", "drives_short", "drives", True),
    ("low_power_boots_pct", "low_power_boots", "boots", True), ("low_power_devices_pct", "low_power_devices", "devices", True),
    ("over_6h_devices_pct", "over_6h_devices", "devices", None), ("sessions_per_hour", "sessions_created", "hours", None),
    ("sessions_stored_pct", "sessions_available", "sessions_created", False),
    ("session_issues_pct", "session_issues", "drives", True), ("improper_runs_per_hour", "runs_improper", "hours", True),
)


def overview_values(side: DataFrame) -> DataFrame:
    """AGG-50: (metric, value, worse) rows of one side's totals (one row in)."""
    rows = []
    for label, num, base, worse in _OVERVIEW:
        scale = 100.0 if label.endswith("_pct") else 1.0
        v = F.col(num).cast("double") if base is None else scale * F.col(num) / F.nullif(F.col(base).cast("double"), F.lit(0.0))
        rows.append(F.struct(F.lit(label).alias("metric"), v.cast("double").alias("value"),
                             F.lit(worse).cast("boolean").alias("more_is_worse")))
    return side.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def compare_overview(a: DataFrame, b: DataFrame) -> DataFrame:
    """AGG-50: overview of two sides with change, direction and whether it is beyond the noise."""
    left, right = overview_values(a), overview_values(b)
    out = compare_reports(left, right, ["metric"]).join(left.select("metric", "more_is_worse"), "metric")
    real = differs("a", "b")
    up = F.col("b") > F.col("a")
    verdict = F.when(~real | F.col("more_is_worse").isNull(), "same").when(up == F.col("more_is_worse"), "worse").otherwise("better")
    return out.withColumns({"verdict": verdict, "beyond_noise": real})


def kpi_values(fleet: DataFrame, boots: Column, hours: Column) -> DataFrame:
    """AGG-51: the value a metric is compared by: per boot, per drive hour, P90 or commonest text.

    ``fleet`` rows carry ``tab``, ``unit``, ``agg``, ``p90``, ``total``, ``common``.
    """
    bases = F.create_map(*[F.lit(x) for k, v in TABLE_BASIS.items() for x in (k, v)])
    basis = F.try_element_at(bases, F.col("tab"))
    total = F.col("total").cast("double")
    norm = (F.when((basis == "boot") & (F.col("agg") == "sum"), total / F.nullif(boots.cast("double"), F.lit(0.0)))
            .when((basis == "boot") & F.col("agg").isin("mean", "pct"), total)
            .when((basis == "drive_h") & (F.col("agg") == "sum") & (F.col("unit") == "count"), total / F.nullif(hours.cast("double"), F.lit(0.0))))
    name = F.when(F.col("unit") == "text", "most common").when(norm.isNotNull(), F.when(basis == "boot", "per boot").otherwise(
        "per drive h")).otherwise("P90")
    return fleet.withColumns({"basis": name, "value": F.coalesce(norm, F.col("p90"))})


def compare_kpis(a: DataFrame, b: DataFrame) -> DataFrame:
    """AGG-51: metrics of two sides by their basis."""
    return compare_reports(a, b, ["metric", "basis"]).withColumn("beyond_noise", differs("a", "b"))


def compare_codes(a: DataFrame, b: DataFrame, hours_a: float | Column, hours_b: float | Column, n: int = CODE_ROWS) -> DataFrame:
    """AGG-51: alerts per drive hour of every code, the largest changes first, in natural code order on ties."""
    ha, hb = (h if isinstance(h, Column) else F.lit(float(h)) for h in (hours_a, hours_b))
    both = a.select("code", F.col("alerts").alias("a_alerts")).join(b.select("code", F.col("alerts").alias("b_alerts")), "code", "full_outer")
    rows = both.select("code", F.coalesce("a_alerts", F.lit(0)).alias("a_alerts"), F.coalesce("b_alerts", F.lit(0)).alias("b_alerts"))
    rows = rows.withColumns({"a": F.col("a_alerts") / F.nullif(ha, F.lit(0.0)), "b": F.col("b_alerts") / F.nullif(hb, F.lit(0.0))})
    rows = rows.withColumn("change_pct", S.change_pct("a", "b")).filter(differs("a", "b"))
    size = F.abs(F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0)))
    return rows.orderBy(size.desc(), X.version_key("code")).limit(n)
