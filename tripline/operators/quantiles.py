"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tripline.session import settle

#: Buckets a range of values is cut into, and the distinct values of one bucket that are ordered at once.
BUCKETS, SORTED = 256, 4096


def _bucket(v: Column, lo: Column, hi: Column, buckets: int) -> Column:
    """Bucket of ``v`` in lo .. hi, lo < hi: rising with v, and different for lo and hi.

    A range over zero is cut by sign and a wide one by logarithm, so doubles of any spread are told apart in about ten rounds.
    """
    largest = F.lit(1.7976931348623157e308)
    low, high, x = (F.greatest(F.least(c, largest), -largest) for c in (lo, hi, v))
    wide = F.when(lo > 0, high > 4 * low).otherwise(low < 4 * high)
    log = lambda c: F.signum(c) * F.log(F.abs(c))
    share = F.when(wide, (log(x) - log(low)) / (log(high) - log(low))).otherwise((x - low) / (high - low))
    inner = F.when(v == hi, buckets - 1).otherwise(F.least(F.greatest(F.floor(share * (buckets - 1)), F.lit(0)), F.lit(buckets - 2)))
    return F.when((lo <= 0) & (hi >= 0), F.signum(v)).when(v == float("-inf"), -1).when(v == float("inf"), buckets).otherwise(inner).cast("bigint")


def quantiles(df: DataFrame, by: Sequence[str], value: str, q: float, name: str = "quantile", buckets: int = BUCKETS, most: int = SORTED) -> DataFrame:
    """AGG-35: per group the exact ``q`` quantile of a number with linear interpolation; groups without values have no row.

    Distributed selection: values are counted, then counted per bucket of the group's range, and only the bucket that holds a
    wanted rank is cut further, until it has at most ``most`` distinct values, which are ordered.  What a task sees of a group is one row per
    bucket, or one bucket's values, never the group.  Nulls in ``by`` are a group; NaN counts as greatest.
    """
    by = list(by)
    v = F.col(value).cast("double")
    counts = settle(df.filter(v.isNotNull()).groupBy(*by, F.when(F.isnan(v), float("inf")).otherwise(v).alias("v"), F.isnan(v).alias("nan")).agg(F.count(F.lit(1)).alias("n")))
    ids = F.struct(*[F.col(c) for c in by])
    total = counts.groupBy(*by).agg(F.sum("n").alias("size"))
    place = (F.col("size") - 1) * F.lit(float(q))
    wanted = total.select(ids.alias("g"), F.explode(F.array_distinct(F.array(F.floor(place).cast("bigint"), F.ceil(place).cast("bigint")))).alias("rank"))
    # rest: values of the bucket that holds each wanted rank; rank counts from 0 inside it
    rest = counts.select(ids.alias("g"), "v", "nan", "n").join(wanted, "g")
    found = []
    while True:
        kept = W.partitionBy("g", "want")
        rest = settle(rest if "want" in rest.columns else rest.withColumn("want", F.col("rank")))
        span = rest.groupBy("g", "want").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("values"))
        small = rest.join(span.filter((F.col("values") <= most) | (F.col("lo") == F.col("hi"))).select("g", "want"), ["g", "want"], "left_semi")
        upto = F.sum("n").over(kept.orderBy("v", "nan").rowsBetween(W.unboundedPreceding, 0))
        found.append(small.withColumn("upto", upto).filter(F.col("upto") > F.col("rank")).groupBy("g", "want").agg(F.min(F.struct("v", "nan")).alias("x")))
        large = settle(span.filter((F.col("values") > most) & (F.col("lo") < F.col("hi"))).drop("values"))
        if large.isEmpty():
            break
        placed_in = _bucket(F.col("v"), F.col("lo"), F.col("hi"), buckets)
        placed = rest.join(large, ["g", "want"]).withColumn("bucket", placed_in)
        sums = placed.groupBy("g", "want", "rank", "bucket").agg(F.sum("n").alias("n"))
        run = sums.withColumn("upto", F.sum("n").over(kept.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)))
        hit = run.filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank"))).select("g", "want", "bucket", (F.col("rank") - F.col("upto") + F.col("n")).alias("inside"))
        rest = placed.join(hit, ["g", "want", "bucket"]).select("g", "v", "nan", "n", F.col("inside").alias("rank"), "want")
    values = found[0]
    for more in found[1:]:
        values = values.unionByName(more)
    values = values.select("g", "want", F.when(F.col("x.nan"), float("nan")).otherwise(F.col("x.v")).alias("v"))
    ends = values.join(total.select(ids.alias("g"), place.alias("place")), "g").groupBy("g", "place").agg(F.min_by("v", "want").alias("a"), F.max_by("v", "want").alias("b"))
    part = F.col("place") - F.floor("place")
    result = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b"))
    return ends.select(*[F.col(f"g.{c}").alias(c) for c in by], result.alias(name))
