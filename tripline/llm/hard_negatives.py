"""Operator 13, hard-negative mining: exact integer scores by a residue number system, then windowed selection.

A component x counts as floor(scale * x).  The integer matrices are multiplied modulo several primes in float32: the primes are so
small that no sum of products of centred residues passes 2^24, so every product is exact.  Scores are put together again by Chinese remaindering in
mixed radix with centred digits, which gives signed values directly.  As many primes are taken as twice the greatest squared length of
a vector asks for, which bounds every score.

Anchors fall into tiles of at most ``TILE`` rows and all rows into parts of at most ``PART``; every tile meets every part in a group of its own.  A group keeps
the best few rows of each anchor, so what leaves it does not depend on how many rows score alike.  A first pass finds the positives, a second one
the negatives inside each positive's window of scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tripline.llm.near_dedup import grouped
from tripline.llm.text import partitions, table

TILE, PART, STEP = 1 << 16, 1 << 18, 2048
#: float32 holds every whole number up to here.
EXACT = 1 << 24
#: Components multiplied before residues are reduced.
CHUNK = 1024
_NONE = np.iinfo(np.int64).min


def primes_for(width: int, bound: int) -> list[int]:
    """The greatest primes that keep sums of ``width`` (at most ``CHUNK``) products of centred residues exact, as many as tell scores of -bound .. bound apart."""
    top, out, product = int(2 * (EXACT / max(1, min(width, CHUNK))) ** 0.5), [], 1
    for p in range(min(top, 1 << 12), 2, -1):
        if all(p % k for k in range(2, int(p**0.5) + 1)):
            out.append(p)
            product *= p
            if product > 2 * bound + 1 and len(out) > 1:
                return out
    raise ValueError("no primes for so great a bound")


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues modulo the odd ``p`` in -(p - 1) / 2 .. (p - 1) / 2."""
    r = np.mod(x, p)
    return np.where(r > p // 2, r - p, r)


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    return [centred(x, p).astype(np.float32) for p in primes]


def exact_scores(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Inner products of the rows of two integer matrices given by their residues, as int64."""
    digits: list[np.ndarray] = []
    total = np.zeros((len(left[0]), len(right[0])), np.int64)
    place = 1
    for k, p in enumerate(primes):
        rest = np.zeros(total.shape, np.int64)
        for at in range(0, max(1, left[k].shape[1]), CHUNK):
            rest += (left[k][:, at : at + CHUNK] @ right[k][:, at : at + CHUNK].T).astype(np.int64)
        # mixed radix: what the digits before leave, divided by their primes' product modulo p
        known, weight = np.zeros(total.shape, np.int64), 1
        for q, digit in zip(primes, digits, strict=False):
            known += digit * (weight % p)
            weight = weight * q
        digit = centred(np.mod(rest - known, p) * pow(weight, -1, p), p)
        digits.append(digit)
        total += digit * np.int64((place + (1 << 63)) % (1 << 64) - (1 << 63))
        place *= p
    return total


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` greatest allowed scores of each row, greatest first, ties to the smaller column."""
    s = np.where(allowed, scores, _NONE)
    keep = allowed if s.shape[1] <= k else allowed & (s >= np.partition(s, -k, axis=1)[:, -k][:, None])
    i, j = np.nonzero(keep)
    order = np.lexsort((j, -s[i, j], i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as one matrix; shorter lists end in zeros."""
    n = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _mine(grouped_rows: DataFrame, windows: bool, k: int, width: int, primes: list[int], low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """Per group, the best ``k`` rows of each anchor (same label) or of each anchor and positive (other labels, inside the window)."""
    def limits(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # ceil(low * score) and floor(high * score) without products beyond 64 bits
        (a, b), (c, d) = low, high
        return -((-positive // b) * a + (-positive % b) * a // b), positive // d * c + positive % d * c // d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 2):
            group = group.combine_chunks()
            side = group.column("side").to_numpy()
            n = int((side == 0).sum())
            if n in (0, len(side)):
                continue
            ids, label, key = (group.column(c).to_numpy() for c in ("id", "label", "key"))
            q = _matrix(group.column("q").chunk(0), width)
            slots = [list(zip(p, s, strict=True)) for p, s in zip(group.column("pos").slice(0, n).to_pylist(), group.column("pos_score").slice(0, n).to_pylist(), strict=True)] if windows else [[(0, 0)]] * n
            found: list[tuple[np.ndarray, ...]] = []
            for a in range(0, n, STEP):
                left = residues(q[a : min(a + STEP, n)], primes)
                size = len(left[0])
                most = max(len(x) for x in slots[a : a + size])
                held = [(np.zeros(0, np.int64),) * 3 for _ in range(most)]
                edge = []
                for slot in range(most):
                    has = np.array([slot < len(x) for x in slots[a : a + size]])
                    lo, hi = limits(np.array([x[slot][1] if slot < len(x) else 0 for x in slots[a : a + size]], np.int64))
                    edge.append((has[:, None], lo[:, None], hi[:, None]))
                for b in range(n, len(side), STEP):
                    end = min(b + STEP, len(side))
                    score = exact_scores(left, residues(q[b:end], primes), primes)
                    same = label[a : a + size, None] == label[None, b:end]
                    for slot, (has, lo, hi) in enumerate(edge):
                        allowed = has & ~same & (score >= lo) & (score <= hi) if windows else same & (ids[a : a + size, None] != ids[None, b:end])
                        i, j = best(score, allowed, k)
                        i, j, s = (np.concatenate(x) for x in zip(held[slot], (i, b + j, score[i, j]), strict=True))
                        order = np.lexsort((ids[j], -s, i))
                        i, j, s = i[order], j[order], s[order]
                        top = np.arange(len(i)) - np.searchsorted(i, i) < k
                        held[slot] = (i[top], j[top], s[top])
                for slot, (i, j, s) in enumerate(held):
                    found.append((key[a + i], ids[a + i], np.full(len(i), slot), np.array([slots[a + x][slot][0] for x in i], np.int64), np.array([slots[a + x][slot][1] for x in i], np.int64), ids[j], s))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)], ["key", "anchor_id", "slot", "positive_id", "positive_score", "id", "score"])

    return grouped_rows.mapInArrow(run, "key long, anchor_id long, slot long, positive_id long, positive_score long, id long, score long")


def hard_negatives(rows: DataFrame, anchors: str, positives: int = 5, negatives: int = 10, low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100),
                   scale: int = 256, tile: int = TILE, part: int = PART) -> DataFrame:
    """Per anchor and positive, the first ``negatives`` rows of other labels with low * positive_score <= score <= high * positive_score:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has id, vector and label; ``anchors`` is a condition on them.  An anchor's positives are its ``positives`` best rows of its label with another
    id.  Better is a greater score, then a smaller id.  Rows with a null id, label, vector or component, or a component that is not finite, take no part; nor do
    vectors whose squared length passes 2^61, whose scores a long may not hold.  A shorter vector counts as ended by zeros.  Rows equal in all three are one row; rows that share an id
    are rows of their own, also as anchors.  Other columns are ignored; an empty table gives no rows.
    """
    spark = rows.sparkSession
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = (rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector").where("id is not null and label is not null and vector is not null").where(finite)
             .withColumn("size2", F.aggregate("vector", F.lit(0.0), lambda t, x: t + F.pow(F.floor(x.cast("double") * scale).cast("double"), 2))).where(F.col("size2") < 2.0**61)
             .select("id", "label", F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"), "size2", F.expr(f"{anchors}").alias("anchor")))
    seen = whole.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("anchor").cast("long")).alias("anchors"), F.max("size2").alias("size2"), F.max(F.size("q")).alias("width"),
                     F.max(F.greatest(F.array_max("q"), -F.array_min("q"))).alias("most")).head()
    n, n_anchors, width = seen["n"], seen["anchors"] or 0, max(1, seen["width"] or 1)
    # room for what doubles lose in the sum
    primes = primes_for(width, int((seen["size2"] or 0) * (1 + width * 2.0**-50)) + 1)
    kind = "smallint" if (seen["most"] or 0) < 1 << 15 else "int" if seen["most"] < 1 << 31 else "bigint"
    kept = table(whole.select("id", "label", F.col("q").cast(f"array<{kind}>").alias("q"), "anchor").distinct().withColumn("key", F.xxhash64("id", "label", F.col("q"))))
    tiles, parts = max(1, -(-n_anchors // tile)), max(1, -(-n // part), min(partitions(spark), -(-n // 1024)))
    none = {"pos": F.lit(None).cast("array<bigint>"), "pos_score": F.lit(None).cast("array<bigint>")}

    def groups(left: DataFrame) -> DataFrame:
        a = left.select(F.pmod("key", F.lit(tiles)).alias("tile"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"), F.lit(0).alias("side"), "id", "label", "key", "q", "pos", "pos_score")
        b = kept.withColumns(none).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tiles - 1).cast("bigint"))).alias("tile"), F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"), F.lit(1).alias("side"), "id", "label", "key", "q", "pos", "pos_score")
        return a.unionByName(b).repartition(max(partitions(spark), tiles * parts), "tile", "part").sortWithinPartitions("tile", "part", "side", "id", "key")

    def first(df: DataFrame, k: int) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(W.partitionBy("key", "slot").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)

    own = kept.where("anchor")
    near = first(_mine(groups(own.withColumns(none)), False, positives, width, primes, low, high), positives)
    lists = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    with_positives = own.join(lists, "key").select("id", "label", "key", "q", F.col("p.id").alias("pos"), F.col("p.score").alias("pos_score"))
    return (first(_mine(groups(with_positives), True, negatives, width, primes, low, high), negatives)
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
