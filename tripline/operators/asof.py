"""As-of joins (JOI-12 .. JOI-15) and what reduces to them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.operators.timeline import DAY_S, epoch_us, scan

_SIDE = "__side"


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    ts: str,
    right_ts: str | None = None,
    *,
    direction: str = "backward",
    tolerance_ms: int | None = None,
    allow_exact: bool = True,
    tie: Sequence[str] = (),
    prefix: str = "",
    width_s: int = DAY_S,
) -> DataFrame:
    """JOI-12 .. JOI-15: every left row with the columns of its as-of match on the right (NULL without one).

    ``direction``: ``backward`` (last at or before), ``forward`` (first at or after) or
    ``nearest`` (ties go to the earlier row).  ``allow_exact=False`` excludes equal times.
    ``tie`` orders right rows of one time: a backward match takes the last, a forward
    match the first.  Right columns other than ``by`` get ``prefix``.

    Both sides are shuffled once by (key, time block); no range join and no pair list.
    """
    by = list(by)
    right_ts = right_ts or ts
    names = [c for c in right.columns if c not in by]
    match = F.struct(*[F.col(c) for c in names])
    payload = right.select(*by, F.col(right_ts).alias(ts), *[F.col(c).alias(f"__t{i}") for i, c in enumerate(tie)],
                           match.alias("__match"))
    lefts = left.withColumns({_SIDE: F.lit(1)})
    ties = [f"__t{i}" for i in range(len(tie))]

    # Right rows sort before left rows of the same time when they may match them.  For the
    # nearest row one scan serves both ways: a row of the same time is found looking back.
    back, ahead = direction in ("backward", "nearest"), direction in ("forward", "nearest")
    if not (back or ahead):
        raise ValueError(f"unknown direction {direction!r}")
    right_first = (direction != "forward") == allow_exact
    rights = payload.withColumns({_SIDE: F.lit(0 if right_first else 2)})
    both = lefts.unionByName(rights, allowMissingColumns=True)
    found = scan(both, by, ts, [_SIDE, *ties], width_s=width_s, last={"__back": "__match"} if back else None,
                 following={"__ahead": "__match"} if ahead else None)
    out = found.filter(F.col(_SIDE) == 1).drop("__match", *ties)
    if direction == "nearest":
        b, f = F.col("__back"), F.col("__ahead")
        here = epoch_us(left, ts)
        before, after = here - _us(b[right_ts], right, right_ts), _us(f[right_ts], right, right_ts) - here
        hit = F.when(after.isNull() | (before <= after), b).otherwise(f)
    else:
        hit = F.col("__back" if back else "__ahead")
    out = out.withColumn("__hit", hit)
    if tolerance_ms is not None:
        away = F.abs(epoch_us(left, ts) - _us(F.col("__hit")[right_ts], right, right_ts))
        out = out.withColumn("__hit", F.when(away <= tolerance_ms * 1000, F.col("__hit")))
    return out.select(*left.columns, *[F.col("__hit")[c].alias(f"{prefix}{c}") for c in names])


def _us(value, df: DataFrame, ts: str):
    """Epoch microseconds of a value of column ``ts`` of ``df``."""
    if df.schema[ts].dataType.typeName().startswith(("timestamp", "date")):
        return F.unix_micros(value.cast("timestamp"))
    return value.cast("bigint") * 1000


def asof_many(
    left: DataFrame,
    rights: Mapping[str, tuple[DataFrame, str]],
    by: Sequence[str],
    ts: str,
    width_s: int = DAY_S,
) -> DataFrame:
    """Backward as-of matches against several right sides in one scan.

    ``rights``: prefix -> (frame, time column).  Their columns arrive as ``<prefix><column>``.
    """
    by = list(by)
    both = left.withColumn(_SIDE, F.lit(1))
    names = {}
    for prefix, (df, right_ts) in rights.items():
        names[prefix] = [c for c in df.columns if c not in by]
        both = both.unionByName(df.select(*by, F.col(right_ts).alias(ts), F.lit(0).alias(_SIDE),
                                          F.struct(*names[prefix]).alias(f"__m_{prefix}")), allowMissingColumns=True)
    found = scan(both, by, ts, [_SIDE], last={f"__l_{p}": f"__m_{p}" for p in rights}, width_s=width_s)
    return found.filter(F.col(_SIDE) == 1).select(
        *left.columns, *[F.col(f"__l_{p}")[c].alias(f"{p}{c}") for p in rights for c in names[p]])


def assign_interval(
    events: DataFrame,
    intervals: DataFrame,
    by: Sequence[str],
    ts: str,
    start: str = "start",
    end: str = "end",
    *,
    how: str = "left",
    width_s: int = DAY_S,
) -> DataFrame:
    """JOI-16: the half-open interval [start, end) an event falls in; open end = still running.

    The intervals of one key do not overlap, so the candidate is the last start at or before
    the event and one comparison with its end decides.
    """
    cols = [c for c in intervals.columns if c not in by]
    placed = asof_join(events, intervals, by, ts, start, prefix="__i_", width_s=width_s)
    inside = F.col(f"__i_{start}").isNotNull() & (
        F.col(f"__i_{end}").isNull() | (F.col(ts) < F.col(f"__i_{end}")))
    out = placed.select(*events.columns, *[F.when(inside, F.col(f"__i_{c}")).alias(c) for c in cols])
    return out.filter(F.col(start).isNotNull()) if how == "inner" else out


def count_in_ranges(
    points: DataFrame,
    ranges: DataFrame,
    by: Sequence[str],
    ts: str,
    pairs: Sequence[tuple[str, str]],
    name: str = "n",
    width_s: int = DAY_S,
) -> DataFrame:
    """JOI-18: number of points in the inclusive ranges of every row (summed over the ranges).

    A range count is the running number of points at its upper end minus the running number
    before its lower end, so the points are counted by one scan and never joined to the
    ranges they lie in.  ``ranges`` keeps its rows and gains ``name``.
    """
    by = list(by)
    keyed = ranges.withColumn("__row", F.struct(*[F.col(c) for c in ranges.columns]))
    # Equal range rows are counted once and multiplied back at the end
    copies = keyed.groupBy(*by, "__row").agg(F.count(F.lit(1)).alias("__copies"))
    cuts = (copies.withColumn("__e", F.explode(F.array(*[
                F.struct(F.col("__row")[lo_hi].alias("t"), F.lit(side).alias("side"), F.lit(sign).alias("sign"))
                for lo, hi in pairs for lo_hi, side, sign in ((lo, 0, -1), (hi, 2, 1))])))
            .select(*by, "__row", "__copies", F.col("__e.t").alias(ts), F.col("__e.side").alias(_SIDE),
                    F.col("__e.sign").alias("__sign"), F.lit(0).alias("__point")))
    pts = (points.groupBy(*by, ts).agg(F.count(F.lit(1)).alias("__point"))
           .withColumns({_SIDE: F.lit(1)}))
    run = scan(cuts.unionByName(pts, allowMissingColumns=True), by, ts, [_SIDE], total={"__seen": "__point"},
               width_s=width_s).filter(F.col(_SIDE) != 1)
    out = run.groupBy(*by, "__row", "__copies").agg(F.sum(F.col("__seen") * F.col("__sign")).alias(name))
    return (out.withColumn("__c", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies"))))
            .select("__row.*", F.col(name).cast("bigint").alias(name)))


def pair_events(
    starts: DataFrame,
    ends: DataFrame,
    by: Sequence[str],
    ts: str = "ts",
    pair: Sequence[str] = (),
    *,
    keep: str = "first",
    width_s: int = DAY_S,
) -> DataFrame:
    """JOI-17: every start with the next end at or after it (same ``pair`` value).

    A streak of starts before one end yields one row measured from its first or last start.
    A start at exactly the end's time is a zero-length pair of its own, once per such start.
    Rows: by, pair, start_ts, end_ts.
    """
    keys = [*by, *pair]
    e = ends.select(*keys, F.col(ts).alias("end_ts")).distinct()
    s = starts.select(*keys, F.col(ts).alias("start_ts"))
    # Pairing keys may be NULL (no pair group on the line); the scan key must not be
    def dense(df: DataFrame) -> DataFrame:
        if not pair:
            return df
        return df.withColumn("__pair", F.coalesce(F.to_json(F.struct(*[F.col(c) for c in pair])), F.lit("")))

    key = [*by, "__pair"] if pair else list(by)
    e = dense(e).select(*key, "end_ts")
    found = asof_join(dense(s), e, key, "start_ts", "end_ts", direction="forward", width_s=width_s)
    found = found.filter(F.col("end_ts").isNotNull())
    pick = F.min if keep == "first" else F.max
    tie = F.col("start_ts") == F.col("end_ts")
    streaks = found.groupBy(*keys, "end_ts", tie.alias("__tie")).agg(
        pick("start_ts").alias("start_ts"), F.count(F.lit(1)).alias("__n"))
    times = F.sequence(F.lit(1).cast("bigint"), F.when(F.col("__tie"), F.col("__n")).otherwise(1))
    return streaks.withColumn("__i", F.explode(times)).select(*keys, "start_ts", "end_ts")
