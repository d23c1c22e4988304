"""Interval algebra by sweeping cut points (WIN-19, WIN-20, WIN-22, WIN-23, WIN-24).

Every interval set becomes +1 / -1 steps at its ends; running sums tell which sets cover a
stretch.  Nothing is range-joined, so overlapping or hot keys cost what their rows cost.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.operators.timeline import DAY_S, scan


def sweep(
    sets: Mapping[str, DataFrame],
    by: Sequence[str],
    inside: Callable[[Mapping[str, Column]], Column],
    start: str = "start",
    end: str = "end",
    width_s: int = DAY_S,
) -> DataFrame:
    """Maximal stretches where ``inside`` holds; it sees per set whether the set covers the point.

    Empty and inverted intervals cover nothing.  Stretches that touch are one stretch.
    """
    by = list(by)
    steps = None
    for name, df in sets.items():
        zero = {f"__d_{n}": F.lit(0) for n in sets}
        cut = (df.filter(F.col(start) < F.col(end))
               .select(*by, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")),
                                              F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("e"))
               .select(*by, F.col("e.t").alias("t"),
                       *[(F.col("e.d") if n == name else zero[f"__d_{n}"]).alias(f"__d_{n}") for n in sets]))
        steps = cut if steps is None else steps.unionByName(cut)
    cuts = steps.groupBy(*by, "t").agg(*[F.sum(f"__d_{n}").alias(f"__d_{n}") for n in sets])
    run = scan(cuts, by, "t", total={f"__n_{n}": f"__d_{n}" for n in sets}, width_s=width_s)
    # The state before a cut is its running count without the cut's own steps
    on = inside({n: F.col(f"__n_{n}") > 0 for n in sets})
    was = inside({n: F.col(f"__n_{n}") - F.col(f"__d_{n}") > 0 for n in sets})
    edges = run.filter(on != was).select(*by, "t", on.alias("on"))
    return (scan(edges, by, "t", lead={"__end": "t"}, width_s=width_s).filter("on")
            .select(*by, F.col("t").alias(start), F.col("__end").alias(end)))


def merge_intervals(df: DataFrame, by: Sequence[str], start: str = "start", end: str = "end",
                    width_s: int = DAY_S) -> DataFrame:
    """WIN-22: union of overlapping or touching intervals."""
    return sweep({"a": df}, by, lambda c: c["a"], start, end, width_s)


def intersect_intervals(a: DataFrame, b: DataFrame, by: Sequence[str], start: str = "start", end: str = "end",
                        width_s: int = DAY_S) -> DataFrame:
    """WIN-20: stretches covered by both sets."""
    return sweep({"a": a, "b": b}, by, lambda c: c["a"] & c["b"], start, end, width_s)


def subtract_intervals(requested: DataFrame, done: DataFrame, by: Sequence[str], start: str = "start",
                       end: str = "end", width_s: int = DAY_S) -> DataFrame:
    """WIN-23: the parts of ``requested`` that ``done`` does not cover."""
    return sweep({"a": requested, "b": done}, by, lambda c: c["a"] & ~c["b"], start, end, width_s)


def merge_segments(df: DataFrame, by: Sequence[str], value: str = "value", start: str = "start", end: str = "end",
                   width_s: int = DAY_S) -> DataFrame:
    """Neighbouring segments of one value that touch become one; the segments do not overlap."""
    cols = [*by, start, end, value]
    seen = scan(df.select(*cols), by, start, lag={"__v": value, "__e": end}, width_s=width_s)
    fresh = ~(F.col("__v").eqNullSafe(F.col(value)) & F.col("__e").eqNullSafe(F.col(start)))
    flagged = seen.withColumn("__new", fresh.cast("int"))
    runs = scan(flagged.select(*cols, "__new"), by, start, total={"__run": "__new"}, width_s=width_s)
    return runs.groupBy(*by, "__run").agg(F.min(start).alias(start), F.max(end).alias(end),
                                          F.first(value).alias(value)).select(*cols)


def overlay(
    timelines: Mapping[str, DataFrame],
    by: Sequence[str],
    fn: Callable[[Mapping[str, Column]], Column],
    value: str = "value",
    start: str = "start",
    end: str = "end",
    width_s: int = DAY_S,
) -> DataFrame:
    """WIN-19: evaluate ``fn`` of several timelines on all their cut points.

    ``fn`` sees the value of every timeline (NULL outside its segments); stretches where it
    gives NULL are left out and equal neighbours are merged.
    """
    by = list(by)
    marks = None
    for name, df in timelines.items():
        rows = df.select(*by, F.explode(F.array(
            F.struct(F.col(start).alias("t"), F.lit(1).alias("rank"), F.col(value).alias("v")),
            F.struct(F.col(end).alias("t"), F.lit(0).alias("rank"), F.lit(None).cast(df.schema[value].dataType).alias("v")),
        )).alias("e")).select(*by, F.col("e.t").alias("t"), F.col("e.rank").alias("__rank"),
                              F.struct(F.col("e.v").alias("v")).alias(f"__v_{name}"))
        marks = rows if marks is None else marks.unionByName(rows, allowMissingColumns=True)
    # A segment that starts where another ends wins at that point
    at = marks.groupBy(*by, "t").agg(*[
        F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col("__rank"))).alias(f"__v_{n}")
        for n in timelines])
    run = scan(at, by, "t", last={f"__l_{n}": f"__v_{n}" for n in timelines}, lead={"__next": "t"}, width_s=width_s)
    pieces = run.select(*by, F.col("t").alias(start), F.col("__next").alias(end),
                        fn({n: F.col(f"__l_{n}")["v"] for n in timelines}).alias(value))
    return merge_segments(pieces.filter(F.col(value).isNotNull() & F.col(end).isNotNull()), by, value, start, end,
                          width_s)


def change_points(events: DataFrame, by: Sequence[str], ts: str, value: str, width_s: int = DAY_S) -> DataFrame:
    """Segments from point events: a value holds until the next different one (open at the end)."""
    by = list(by)
    seen = scan(events.select(*by, ts, value), by, ts, [value], lag={"__was": value}, width_s=width_s)
    kept = seen.filter(~F.col(value).eqNullSafe(F.col("__was"))).drop("__was")
    out = scan(kept, by, ts, [value], lead={"end": ts}, width_s=width_s)
    return out.select(*by, F.col(ts).alias("start"), "end", value).filter(
        F.col("end").isNull() | (F.col("start") < F.col("end")))
