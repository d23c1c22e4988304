"""Sorted lists of any length, as rows of bounded parts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tripline.session import settle

#: Values of one part of a list.
SEGMENT = 10_000


def segmented_lists(df: DataFrame, by: Sequence[str], value: str, size: int = SEGMENT, order: Sequence[str] = (), name: str = "values") -> DataFrame:
    """(by, segment, first_no, values): each group's distinct values in order, cut into parts of ``size``; nulls are left out.

    The order is that of ``order`` (columns that may differ per value), then of the value.  Rows are dealt by ranges of (group, order), so a group of any length lies in several
    tasks; a value's place is its place in its task's share of the group and what the shares before it hold.  Nulls in ``by`` are a group.
    """
    by, order = list(by), [*order, value]
    rows = df.select(*dict.fromkeys([*by, *order])).filter(F.col(value).isNotNull()).distinct()
    # written down, so that a task that is run again finds the shares as they were
    dealt = settle(rows.repartitionByRange(*by, *order).withColumn("__share", F.spark_partition_id()))
    shares = dealt.groupBy(*by, "__share").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy("__share").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = shares.select(*[F.col(c).alias(f"__s_{c}") for c in by], F.col("__share").alias("__s"), before.alias("__before"))
    inside = F.row_number().over(W.partitionBy(*by, "__share").orderBy(*order))
    numbered = dealt.withColumn("__at", inside)
    same = reduce(and_, [numbered[c].eqNullSafe(starts[f"__s_{c}"]) for c in by], numbered["__share"] == starts["__s"])
    placed = numbered.join(starts, same).withColumn("__no", F.col("__at") + F.col("__before") - 1)
    segment = F.floor(F.col("__no") / size).cast("bigint").alias("segment")
    parts = placed.groupBy(*by, segment).agg(F.min("__no").alias("first_no"), F.array_sort(F.collect_list(F.struct(F.col("__no").alias("no"), F.col(value).alias("v")))).alias("__l"))
    return parts.select(*by, "segment", "first_no", F.transform("__l", lambda x: x["v"]).alias(name))


def joined_lists(segments: DataFrame, by: Sequence[str], name: str = "values", most: int | None = None) -> DataFrame:
    """(by, values): the parts of each list as one cell.  A cell must fit in memory, so this is the last step of a report; ``most`` keeps the first so many."""
    rows = segments if most is None else segments.filter(F.col("first_no") < most)
    cell = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("segment", name))), lambda x: x[name]))
    return rows.groupBy(*by).agg((cell if most is None else F.slice(cell, 1, most)).alias(name))


def ranked(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """1-based place of every row in the order of ``order`` over the whole frame; rows equal in it are numbered in any order.

    Rows are dealt by ranges, however many share the first columns of the order, and counted per range.
    """
    dealt = settle(df.repartitionByRange(*order).withColumn("__share", F.spark_partition_id()))
    shares = dealt.groupBy("__share").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(F.lit(0)).orderBy("__share").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row per task
    inside = F.row_number().over(W.partitionBy("__share").orderBy(*order))
    return dealt.withColumn("__at", inside).join(shares.select("__share", before.alias("__before")), "__share").select(*df.columns, (F.col("__at") + F.col("__before")).alias(name))
