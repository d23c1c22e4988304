"""Ordered scans along a timeline that never need one whole key in one task.

A plain window over ``partitionBy(device)`` sends everything one device ever logged to a
single task, and one device can hold a third of a table.  Here a timeline is cut into
*blocks* of fixed width.  Rows are shuffled by (key, block); every block is padded with an
*edge row* that carries what the blocks before it (or after it) contribute - the last value
seen, the running total, the next row - and the ordinary window functions then run inside
the block.  The edge rows come from one map-side-combined aggregate per (key, block), so the
only window over a whole key sees one row per block: its size depends on the time span, not
on the number of rows.

    data ──┬─ groupBy(key, block) ── window(key, order block) ── edge rows ─┐
           └──────────────────────────── data rows ────────────────────────┴─ union ─ window(key, block)
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

DAY_S = 86_400
_BLOCK = "__block"
_EDGE = "__edge"
_NO_TIME = -(1 << 60)

Exprs = Mapping[str, "Column | str"]


def epoch_us(df: DataFrame, ts: str) -> Column:
    """Microseconds since the epoch of a timestamp column; whole-number columns are epoch ms."""
    kind = df.schema[ts].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(ts).cast("timestamp"))
    return F.col(ts).cast("bigint") * 1000


def block_of(df: DataFrame, ts: str, width_s: int = DAY_S) -> Column:
    """Block number of a row; rows without a time share the earliest block."""
    return F.coalesce(F.floor(epoch_us(df, ts) / F.lit(width_s * 1_000_000)), F.lit(_NO_TIME)).cast("bigint")


def _col(expr: Column | str) -> Column:
    return F.col(expr) if isinstance(expr, str) else expr


def scan(
    df: DataFrame,
    by: Sequence[str],
    ts: str,
    tie: Sequence[str] = (),
    *,
    lag: Exprs | None = None,
    lead: Exprs | None = None,
    last: Exprs | None = None,
    following: Exprs | None = None,
    total: Exprs | None = None,
    peak: Exprs | None = None,
    peak_before: Exprs | None = None,
    width_s: int = DAY_S,
) -> DataFrame:
    """Add scan results to every row of ``df``; key columns must not be null.

    ``lag`` / ``lead``   value of the row before / after
    ``last``             last non-null value at or before the row
    ``following``        first non-null value at or after the row
    ``total``            running sum up to and including the row
    ``peak``             running maximum up to and including the row
    ``peak_before``      running maximum of the rows before it

    ``tie`` makes the order total; rows equal in (ts, tie) keep an arbitrary order.
    """
    by, tie = list(by), list(tie)
    groups = {
        "lag": lag or {}, "lead": lead or {}, "last": last or {}, "following": following or {},
        "total": total or {}, "peak": peak or {}, "peak_before": peak_before or {},
    }
    kind_of = {name: kind for kind, exprs in groups.items() for name in exprs}
    work = df.withColumns({_BLOCK: block_of(df, ts, width_s),
                           **{f"__x_{n}": _col(e) for exprs in groups.values() for n, e in exprs.items()}})
    place = F.struct(F.lit(0).alias("z"), *[F.col(c) for c in [ts, *tie]])

    sums = []
    for name, kind in kind_of.items():
        x = F.col(f"__x_{name}")
        boxed = F.struct(x.alias("v"))
        agg = {
            "lag": lambda: F.max_by(boxed, place)["v"],
            "lead": lambda: F.min_by(boxed, place)["v"],
            "last": lambda: F.max_by(x, F.when(x.isNotNull(), place)),
            "following": lambda: F.min_by(x, F.when(x.isNotNull(), place)),
            "total": lambda: F.sum(x),
            "peak": lambda: F.max(x),
            "peak_before": lambda: F.max(x),
        }[kind]()
        sums.append(agg.alias(f"__x_{name}"))
    per_block = work.groupBy(*by, _BLOCK).agg(*sums)

    key = W.partitionBy(*by).orderBy(_BLOCK)
    before = key.rowsBetween(W.unboundedPreceding, -1)
    after = key.rowsBetween(1, W.unboundedFollowing)
    heads, tails = {}, {}
    for name, kind in kind_of.items():
        x = F.col(f"__x_{name}")
        if kind in ("lead", "following"):
            tails[name] = F.lead(x).over(key) if kind == "lead" else F.first(x, ignorenulls=True).over(after)
        else:
            heads[name] = {
                "lag": lambda: F.lag(x).over(key),
                "last": lambda: F.last(x, ignorenulls=True).over(before),
                "total": lambda: F.sum(x).over(before),
                "peak": lambda: F.max(x).over(before),
                "peak_before": lambda: F.max(x).over(before),
            }[kind]()
    parts = [work.withColumn(_EDGE, F.lit(0))]
    for mark, values in ((-1, heads), (1, tails)):
        if values:
            parts.append(per_block.select(*by, _BLOCK, F.lit(mark).alias(_EDGE),
                                          *[v.alias(f"__x_{n}") for n, v in values.items()]))
    padded = parts[0]
    for part in parts[1:]:
        padded = padded.unionByName(part, allowMissingColumns=True)

    w = W.partitionBy(*by, _BLOCK).orderBy(_EDGE, *[F.col(c) for c in [ts, *tie]])
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    prior = w.rowsBetween(W.unboundedPreceding, -1)
    onward = w.rowsBetween(0, W.unboundedFollowing)
    out = {}
    for name, kind in kind_of.items():
        x = F.col(f"__x_{name}")
        out[name] = {
            "lag": lambda: F.lag(x).over(w),
            "lead": lambda: F.lead(x).over(w),
            "last": lambda: F.last(x, ignorenulls=True).over(upto),
            "following": lambda: F.first(x, ignorenulls=True).over(onward),
            "total": lambda: F.sum(x).over(upto),
            "peak": lambda: F.max(x).over(upto),
            "peak_before": lambda: F.max(x).over(prior),
        }[kind]()
    keep = [c for c in df.columns if c not in out]
    done = padded.select(*keep, _EDGE, *[c.alias(n) for n, c in out.items()])
    return done.filter(F.col(_EDGE) == 0).drop(_EDGE)
