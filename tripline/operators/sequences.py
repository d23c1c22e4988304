"""Sessions, duplicate suppression and other rules along a timeline (WIN-01 .. WIN-06, WIN-25 ..)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tripline.operators.timeline import DAY_S, block_of, epoch_us, scan
from tripline.session import settle


def session_numbers(df: DataFrame, by: Sequence[str], ts: str, gap_ms: int, tie: Sequence[str] = (),
                    name: str = "session", width_s: int = DAY_S) -> DataFrame:
    """Number of a row's gap session within its key: a gap above ``gap_ms`` to the row before starts one.

    Sessions are counted inside time blocks; each block's first row is compared with the last
    row of the block before, and the block totals are summed along the key.
    """
    by, gap = list(by), gap_ms * 1000
    work = df.withColumns({"__us": epoch_us(df, ts), "__b": block_of(df, ts, width_s)})
    w = W.partitionBy(*by, "__b").orderBy(F.col(ts), *[F.col(c) for c in tie])
    rows = work.withColumn("__new", F.coalesce((F.col("__us") - F.lag("__us").over(w) > gap).cast("int"), F.lit(0)))
    blocks = rows.groupBy(*by, "__b").agg(F.min("__us").alias("first"), F.max("__us").alias("last"), F.sum("__new").alias("inner"))
    key = W.partitionBy(*by).orderBy("__b")
    opens = F.coalesce((F.col("first") - F.lag("last").over(key) > gap).cast("int"), F.lit(1))
    blocks = blocks.withColumn("opens", opens)
    before = F.sum(F.col("opens") + F.col("inner")).over(key.rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select(*by, "__b", (F.coalesce(before, F.lit(0)) + F.col("opens")).alias("__base"))
    out = rows.join(blocks, [*by, "__b"])
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    return out.select(*df.columns, (F.col("__base") + F.sum("__new").over(upto)).alias(name))


def gap_sessions(df: DataFrame, by: Sequence[str], ts: str, gap_ms: int = 5_000, tie: Sequence[str] = (),
                 width_s: int = DAY_S) -> DataFrame:
    """WIN-01: every row with its batch number, size, first and last time.

    Batches are numbered over all keys by first time (then key).  The numbers come from the
    session table: counts per start day are summed, so no task sees all sessions.
    """
    by = list(by)
    rows = session_numbers(df, by, ts, gap_ms, tie, width_s=width_s)
    sessions = rows.groupBy(*by, "session").agg(
        F.count(F.lit(1)).alias("batch_size"), F.min(ts).alias("batch_start"), F.max(ts).alias("batch_end"))
    numbered = global_rank(sessions, "batch_start", by, "batch")
    return rows.join(numbered, [*by, "session"]).drop("session")


def global_rank(df: DataFrame, ts: str, tie: Sequence[str], name: str, width_s: int = 3_600) -> DataFrame:
    """1-based position in the order of (ts, tie) over the whole frame, without one global sort task.

    Rows per block are counted, the block counts are summed over blocks, and rows are ranked
    inside their block.
    """
    block = F.coalesce(F.floor(epoch_us(df, ts) / F.lit(width_s * 1_000_000)), F.lit(-(1 << 60))).cast("bigint")
    work = df.withColumn("__b", block)
    counts = work.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    # One row per block of the time range: a small frame
    before = counts.select("__b", F.coalesce(F.sum("__n").over(
        W.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranked = work.withColumn(name, F.row_number().over(W.partitionBy("__b").orderBy(ts, *tie)))
    return (ranked.join(before, "__b").withColumn(name, F.col(name) + F.col("__before"))
            .drop("__b", "__before"))


def nth_in_session(df: DataFrame, by: Sequence[str], ts: str, gap_ms: int, n: int, tie: Sequence[str] = (),
                   width_s: int = DAY_S) -> DataFrame:
    """WIN-04: the n-th row (1-based) of every gap session."""
    rows = session_numbers(df, by, ts, gap_ms, tie, width_s=width_s)
    key = [*by, "session"]
    counted = scan(rows.withColumn("__one", F.lit(1)), key, ts, tie, total={"__n": "__one"}, width_s=width_s)
    return counted.filter(F.col("__n") == n).drop("session", "__n", "__one")


class _Cells:
    """Sorted distinct times of many cells at once; a cell is one key in one time block.

    ``row`` counts time from each cell's block on one axis, on which cells lie further apart than the limit, so one binary
    search finds each time's next anchor.
    """

    def __init__(self, us: np.ndarray, starts: np.ndarray, blk: np.ndarray, limit: int, width: int):
        self.us, self.starts, self.limit, self.stride = us, starts, limit, width + limit + 1
        self.ends = np.append(starts[1:], len(us))
        self.cell = np.repeat(np.arange(len(starts)), self.ends - starts)
        self.base = blk * width
        self.row = self.cell * self.stride + (us - self.base[self.cell])
        after = np.searchsorted(self.row, self.row + limit, side="right")
        self.next = np.where(after < self.ends[self.cell], after, np.arange(len(us)))

    def last_anchor(self) -> np.ndarray:
        """For every time the block's last anchor if an anchor falls on it."""
        last = self.next
        while (further := last[last]).tobytes() != last.tobytes():
            last = further
        return last

    def from_entry(self, entry: np.ndarray) -> np.ndarray:
        """First time of each cell that is more than the limit after ``entry``; the cell's end if none is."""
        offset = np.clip(entry + self.limit - self.base, -1, self.stride - 1)
        return np.searchsorted(self.row, np.arange(len(self.starts)) * self.stride + offset, side="right")

    def anchors(self, first: np.ndarray) -> np.ndarray:
        """Marks of the anchors that follow from the first ones, by doubling the step."""
        marked = np.zeros(len(self.us), bool)
        marked[first[first < self.ends]] = True
        step = self.next
        while True:
            marked[step[marked]] = True
            further = step[step]
            if (further == step).all():
                return marked
            step = further


def _cell_starts(rows: pa.Table, names: Sequence[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for name in names:
        code = rows.column(name).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _block_maps(df: DataFrame, by: Sequence[str], limit: int, width: int) -> DataFrame:
    """Per key and time block: its times, and the map from the last anchor before the block to the last one in it.

    The map is a list of steps (t, l) in time order: the first step with t > anchor + limit tells that l is the block's last
    anchor.  Only times less than the limit into the block, and the one after them, can take the first anchor; neighbours with one
    outcome are one step.  A block that ends within the limit may be ``open``: past its last step the anchor before stays.
    """
    cells = [*by, "__blk"]
    spread = df.select(*cells, "__us").repartition(*cells).sortWithinPartitions(*cells, "__us")

    def maps(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        us, blk = rows.column("__us").to_numpy(), rows.column("__blk").to_numpy()[starts]
        new = np.ones(len(us), bool)
        new[1:] = us[1:] != us[:-1]
        new[starts] = True
        c = _Cells(us[new], np.cumsum(new)[starts] - 1, blk, limit, width)
        last = c.last_anchor()
        sure = np.searchsorted(c.row, np.arange(len(starts)) * c.stride + limit, side="left")
        at = np.flatnonzero(np.arange(len(c.us)) <= sure[c.cell])
        step = np.ones(len(at), bool)
        step[:-1] = (c.cell[at[1:]] != c.cell[at[:-1]]) | (last[at[1:]] != last[at[:-1]])
        at = at[step]
        offsets = lambda of: pa.array(np.append(np.searchsorted(of, np.arange(len(starts))), len(of)).astype(np.int32))
        pairs = pa.StructArray.from_arrays([pa.array(c.us[at]), pa.array(c.us[last[at]])], ["t", "l"])
        keys = rows.take(pa.array(starts)).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [*(keys.column(k).chunk(0) for k in cells), pa.ListArray.from_arrays(offsets(c.cell), pa.array(c.us)),
             pa.ListArray.from_arrays(offsets(c.cell[at]), pairs), pa.array(sure == c.ends)], [*cells, "__times", "__steps", "__open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
            if rows.num_rows:
                starts = _cell_starts(rows, cells)
                held = rows.slice(starts[-1])
                if len(starts) > 1:
                    yield maps(rows.slice(0, starts[-1]), starts[:-1])
        if held is not None:
            yield maps(held, np.zeros(1, np.int64))

    step = T.StructType([T.StructField("t", T.LongType()), T.StructField("l", T.LongType())])
    kinds = T.StructType([*[df.schema[c] for c in by], T.StructField("__blk", T.LongType()), T.StructField("__times", T.ArrayType(T.LongType())),
                          T.StructField("__steps", T.ArrayType(step)), T.StructField("__open", T.BooleanType())])
    return spread.mapInArrow(run, kinds)


def _apply(steps: str, anchor: str, limit: int) -> str:
    """SQL: where a map leads from the last anchor before."""
    return f"coalesce(get(filter({steps}, s -> s.t > {anchor} + {limit}), 0).l, {anchor})"


def _carries(maps: DataFrame, by: Sequence[str], limit: int) -> DataFrame:
    """(by, ``__blk``, ``__carry``): the last anchor before each block, null for a key's first.

    A block whose map has one outcome, or that is a key's first, needs no history.  For the others maps are composed by pointer doubling: every round
    joins a block's map with that of the block it points to, which halves what is left of the longest chain.  No task sees a
    whole key's rows, only one row per block.
    """
    by = list(by)
    order = W.partitionBy(*by).orderBy("__blk")
    known = F.expr("case when __prev is null or (size(__steps) = 1 and not __open) then __steps[0].l end")
    cells = (maps.select(*by, "__blk", "__steps", "__open", F.lag("__blk").over(order).alias("__prev")).withColumn("__out", known)
             .withColumn("__base", F.lag("__out").over(order)))
    left = settle(cells.filter("__out is null").drop("__out"))
    while not left.filter("__base is null").isEmpty():
        earlier = left.select(*by, F.col("__blk").alias("__prev"), F.col("__steps").alias("__s"), F.col("__open").alias("__o"), F.col("__prev").alias("__p"), F.col("__base").alias("__b"))
        open_ = left.filter("__base is null").join(earlier, [*by, "__prev"])
        through = f"transform(__s, x -> named_struct('t', x.t, 'l', {_apply('__steps', 'x.l', limit)}))"
        joined = open_.withColumn("__c", F.expr(f"case when __b is null then concat({through}, if(__o, __steps, array())) else __steps end"))
        merged = joined.withColumn("__c", F.expr("filter(__c, (x, i) -> i = size(__c) - 1 or x.l <> __c[i + 1].l)"))
        sure = "__b is null and size(__c) = 1 and not (__o and __open)"
        moved = merged.select(*by, "__blk", F.col("__c").alias("__steps"), F.expr("__open and (__b is not null or __o)").alias("__open"), F.col("__p").alias("__prev"),
                              # a map of one outcome leads there from anywhere: any base will do
                              F.expr(f"case when __b is not null then {_apply('__s', '__b', limit)} when {sure} then __c[0].t - {limit} - 1 end").alias("__base"))
        left = settle(left.filter("__base is not null").select(moved.columns).unionByName(moved))
    outs = left.select(*by, "__blk", F.expr(_apply("__steps", "__base", limit)).alias("__late"))
    done = cells.select(*by, "__blk", "__out").join(outs, [*by, "__blk"], "left")
    return done.select(*by, "__blk", F.lag(F.coalesce("__out", "__late")).over(order).alias("__carry"))


def _fold(df: DataFrame, by: Sequence[str], ts: str, limit_ms: int, name: str, width_s: int, only_anchors: bool = False) -> DataFrame:
    """Start time (epoch us) of the anchor each row belongs to; rows without a time are left out.

    An anchor takes every row at most ``limit`` after it; the next row opens the next anchor.  That depends on where the anchors
    before it fell, so it is sequential - but what a block of time needs to know is one anchor.  Blocks are summed up as maps, maps are composed
    along the key, and all blocks are folded at once from the anchor before each.  Python sees distinct times only; rows are
    joined to them.
    """
    by = list(by)
    limit = limit_ms * 1000
    width = max(8 * limit, min(width_s, 600) * 1_000_000)
    rows = df.withColumn("__us", epoch_us(df, ts)).filter("__us is not null")
    maps = settle(_block_maps(rows.withColumn("__blk", F.floor(F.col("__us") / F.lit(width)).cast("bigint")), by, limit, width))
    cells = maps.select(*by, "__blk", "__times").join(_carries(maps, by, limit), [*by, "__blk"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            times, carry = batch.column("__times"), batch.column("__carry")
            starts = times.offsets.to_numpy()
            c = _Cells(times.flatten().to_numpy(), (starts - starts[0])[:-1].astype(np.int64), batch.column("__blk").to_numpy(), limit, width)
            fresh = carry.is_null().to_numpy(zero_copy_only=False)
            entry = carry.fill_null(0).to_numpy()
            marked = c.anchors(np.where(fresh, c.starts, c.from_entry(entry)))
            at = np.maximum.accumulate(np.where(marked, np.arange(len(marked)), -1))
            anchor = np.where(at >= c.starts[c.cell], c.us[at], entry[c.cell])
            keep = marked if only_anchors else np.ones(len(marked), bool)
            of = pa.array(c.cell[keep])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in by), pa.array(c.us[keep]), pa.array(anchor[keep])], [*by, "__us", name])

    kinds = T.StructType([*[df.schema[c] for c in by], T.StructField("__us", T.LongType()), T.StructField(name, T.LongType())])
    found = cells.select(*by, "__blk", "__times", "__carry").mapInArrow(fold, kinds)
    return rows.join(found, [*by, "__us"]).select(*df.columns, name)


def anchor_clusters(df: DataFrame, by: Sequence[str], ts: str, limit_ms: int = 5_000,
                    prio: Sequence[str] = (), width_s: int = DAY_S) -> DataFrame:
    """WIN-02: clusters no wider than ``limit`` from their first row, one representative each.

    The representative is the row with the lowest ``prio``, then the earliest; rows gain
    ``cluster_start`` (epoch us) and ``cluster_size``.  Rows without a time are left out.
    """
    folded = _fold(df, by, ts, limit_ms, "cluster_start", width_s)
    best = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*[F.col(c) for c in [*prio, ts]]))
    out = folded.groupBy(*by, "cluster_start").agg(best.alias("__r"), F.count(F.lit(1)).alias("cluster_size"))
    return out.select("__r.*", "cluster_start", "cluster_size")


def thin_events(df: DataFrame, by: Sequence[str], ts: str, limit_ms: int = 1_000, tie: Sequence[str] = (),
                width_s: int = DAY_S) -> DataFrame:
    """WIN-03: keep a row only when it is more than ``limit`` after the last kept one of its key.

    Put the outcome column into ``by`` to compare only rows of one outcome.  Of rows at one time the first by ``tie`` is
    kept; rows without a time are left out.
    """
    folded = _fold(df, by, ts, limit_ms, "__anchor", width_s, only_anchors=True)
    first = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(F.col(ts), *[F.col(c) for c in tie]))
    return folded.groupBy(*by, "__anchor").agg(first.alias("__r")).select("__r.*")


def silence_points(lines: DataFrame, by: Sequence[str], ts: str, gap_ms: int = 20_000, tie: Sequence[str] = (),
                   width_s: int = DAY_S) -> DataFrame:
    """WIN-05: rows before a silence above ``gap``, and the last row of every key."""
    work = lines.withColumn("__us", epoch_us(lines, ts))
    nxt = scan(work, by, ts, tie, lead={"__next": "__us"}, width_s=width_s)
    quiet = F.col("__next").isNull() | (F.col("__next") - F.col("__us") > gap_ms * 1000)
    return nxt.filter(quiet).drop("__us", "__next")


def latest_n(df: DataFrame, by: Sequence[str], ts: str, n: int, tie: Sequence[str] = ()) -> DataFrame:
    """WIN-39: the newest n rows per key with the key's row count.

    Each day's newest n are taken first, so a hot key is ranked in as many tasks as it has days.
    """
    order = [F.col(ts).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in tie]]
    work = df.withColumn("__b", F.coalesce(F.floor(epoch_us(df, ts) / F.lit(DAY_S * 1_000_000)), F.lit(0)))
    total = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    near = (work.withColumn("__r", F.row_number().over(W.partitionBy(*by, "__b").orderBy(*order)))
            .filter(F.col("__r") <= n))
    best = (near.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
            .filter(F.col("rank") <= n).drop("__b", "__r"))
    return best.join(total, list(by))


def first_since(hits: DataFrame, units: DataFrame, by: Sequence[str], ts: str = "ts", anchor: str = "anchor",
                limit_ms: int = 900_000, value_ts: str | None = None) -> DataFrame:
    """WIN-25: seconds from a unit's anchor to its first hit, kept when within 0 .. limit.

    ``hits`` already carry their unit (``by``); the value may be timed by another column.
    """
    at = value_ts or ts
    first = hits.groupBy(*by).agg(F.min_by(F.struct(F.col(ts).alias("ts"), F.col(at).alias("at")),
                                           F.struct(F.col(ts), F.col(at))).alias("f"))
    gap = F.col("f.at") - F.col(anchor)
    return (first.join(units.select(*by, anchor), list(by)).filter(gap.between(0, limit_ms))
            .select(*by, F.col("f.ts").alias("ts"), (gap / 1000).alias("value")))


def first_value_by_source(hits: DataFrame, by: Sequence[str], ts: str = "ts", source: str = "source_rank",
                          every: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """WIN-26: first (or every) row per unit of the best-ranked source the unit has."""
    best = hits.groupBy(*by).agg(F.min(source).alias("__best"))
    kept = hits.join(best, list(by)).filter(F.col(source) == F.col("__best")).drop("__best")
    if every:
        return kept
    first = F.min_by(F.struct(*[F.col(c) for c in hits.columns]), F.struct(F.col(ts), *[F.col(c) for c in tie]))
    return kept.groupBy(*by).agg(first.alias("__r")).select("__r.*")


def count_unique(hits: DataFrame, by: Sequence[str], unique: Sequence[str], ts: str = "ts",
                 per_second: bool = False) -> DataFrame:
    """WIN-27: one row per distinct tuple (earliest kept), optionally per second."""
    keys = [F.col(c) for c in [*by, *unique]]
    if per_second:
        keys.append(F.floor(F.col(ts) / 1000).alias("__sec"))
    return hits.groupBy(*keys).agg(F.min(ts).alias(ts)).drop("__sec")


def carry_key(hits: DataFrame, by: Sequence[str], ts: str, key: str, tie: Sequence[str] = (),
              width_s: int = DAY_S) -> DataFrame:
    """WIN-28: rows without a key get the last one seen on their thread."""
    return scan(hits, by, ts, tie, last={"__k": key}, width_s=width_s).withColumn(key, F.col("__k")).drop("__k")


def request_batches(hits: DataFrame, by: Sequence[str], ts: str, step: str, request: str, steps: Sequence[str],
                    width_s: int = DAY_S) -> DataFrame:
    """WIN-29: batches opened by a request row per thread, with the first time of every step in them."""
    rows = hits.withColumns({"__req": (F.col(step) == request).cast("int"),
                             "__o": F.when(F.col(step) == request, 0).otherwise(1)})
    numbered = scan(rows, by, ts, ["__o", step], total={"batch": "__req"}, width_s=width_s).filter(F.col("batch") > 0)
    return numbered.groupBy(*by, "batch").agg(
        F.min(F.when(F.col(step) == request, F.col(ts))).alias("request"),
        *[F.min(F.when(F.col(step) == s, F.col(ts))).alias(s) for s in steps])


def unanswered(calls: DataFrame, oks: DataFrame, by: Sequence[str], ts: str = "ts", tie: Sequence[str] = (),
               width_s: int = DAY_S) -> DataFrame:
    """WIN-30: calls with no success on their thread before the thread's next call."""
    both = calls.withColumn("__ok", F.lit(None).cast("int")).withColumn("__side", F.lit(0)).unionByName(
        oks.select(*by, ts).withColumns({"__ok": F.lit(1), "__side": F.lit(1)}), allowMissingColumns=True)
    both = both.withColumn("__kind", F.col("__side"))
    nxt = scan(both, by, ts, ["__side", *tie], lead={"__next": "__kind"}, width_s=width_s)
    # A success at exactly the next call's time answers that call, not this one
    missed = F.col("__next").isNull() | (F.col("__next") == 0)
    return nxt.filter((F.col("__side") == 0) & missed).drop("__ok", "__side", "__kind", "__next")


def prefer_source(primary: DataFrame, secondary: DataFrame, by: Sequence[str], ts: str = "ts", ms: int = 5_000,
                  width_s: int = DAY_S) -> DataFrame:
    """WIN-32: secondary rows with no primary row within ± ms."""
    from tripline.operators.asof import asof_join

    marks = primary.select(*by, F.col(ts).alias("__p")).distinct()
    near = asof_join(secondary, marks, by, ts, "__p", direction="nearest", tolerance_ms=ms, width_s=width_s)
    return near.filter(F.col("__p").isNull()).drop("__p")
