"""Operator 10, best-fit packing after Martello-Toth dominance reduction.

Only lengths matter for packing, and there are at most ``size`` of them, so the whole corpus is packed as one
histogram: the reduction fixes sets that dominate every other choice for their largest piece (with all their
repetitions at once), and best-fit decreasing packs what remains.  The result is a short list of patterns with repetitions,
bounded by ``size`` whatever the input.  Pieces of one length are numbered across the cluster by counts per (length, bucket),
and a piece's length and number give its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripline.llm.text import BLOCK_BYTES, partitions, table, tidy
from tripline.llm.tokens import END_ID, crc, encoder

SIZE = 1024
Pattern = tuple[tuple[int, ...], int]


def piece_rows(docs: DataFrame, size: int = SIZE, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) of every piece of every document, ids as unsigned 16-bit numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder(vocabulary).encode(batch.column(1).to_pylist(), BLOCK_BYTES // 2), strict=True):
                ids = np.append(ids, np.uint16(END_ID)).astype("<u2")
                cut = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
                rows += [(doc, k, a, b - a, crc(ids[a:b]), ids[a:b].tobytes()) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"))


def reduce(count: np.ndarray, size: int = SIZE) -> list[Pattern]:
    """Fix dominating sets, taking their pieces out of ``count`` (pieces per length), until none is left."""
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        for w in range(size, 0, -1):
            while count[w]:
                count[w] -= 1
                room = size - w
                left = np.flatnonzero(count)
                fit = left[left <= room]
                few = left[:3] if len(left) else left
                cheap = np.repeat(few, np.minimum(count[few], 3))[:3]  # the three shortest others
                count[w] += 1
                if not len(fit):
                    fixed.append(((w,), int(count[w])))
                    count[w] = 0
                    changed = True
                    break
                best = int(fit[-1])
                others = 1 if cheap[:2].sum() > room or len(cheap) < 2 else 2 if len(cheap) < 3 or cheap.sum() > room else 3
                good = w + best == size or others == 1
                if not good and others == 2:
                    # no pair of others may fill more than the best single piece
                    mate = np.searchsorted(fit, room - fit, side="right") - 1
                    pair = [(int(a), int(fit[m])) for a, m in zip(fit, mate, strict=True) if m >= 0]
                    good = best >= max((a + b for a, b in pair), default=0)
                if not good:
                    break
                n = int(count[w] // 2 if best == w else min(count[w], count[best]))
                if not n:  # one piece of this length is left, and it is its own best mate
                    break
                fixed.append(((w, best), n))
                count[w] -= n
                count[best] -= n
                changed = True
    return fixed


def best_fit(count: np.ndarray, size: int = SIZE) -> list[Pattern]:
    """Best-fit decreasing of a histogram: pieces of one length go to the fullest open sequences that hold them."""
    rooms: dict[int, dict[tuple[int, ...], int]] = {}

    def add(room: int, pattern: tuple[int, ...], n: int) -> None:
        group = rooms.setdefault(room, {})
        group[pattern] = group.get(pattern, 0) + n

    for w in range(size, 0, -1):
        n = int(count[w])
        while n:
            room = min((r for r in rooms if r >= w), default=None)
            if room is None:
                # new sequences of as many as fit, and one of the rest
                each = size // w
                if n >= each:
                    add(size - each * w, (w,) * each, n // each)
                if n % each:
                    add(size - n % each * w, (w,) * (n % each), 1)
                n = 0
                break
            pattern, have = next(iter(rooms[room].items()))
            times = min(room // w, n)  # equal pieces keep going to the same sequence: it stays the fullest
            m = min(have, n // times)
            rooms[room][pattern] -= m
            if not rooms[room][pattern]:
                del rooms[room][pattern]
            if not rooms[room]:
                del rooms[room]
            add(room - times * w, (*pattern, *(w,) * times), m)
            n -= m * times
    return [(p, n) for group in rooms.values() for p, n in group.items()]


def pack_histogram(counts: dict[int, int], size: int = SIZE) -> list[Pattern]:
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    fixed = reduce(left, size)
    return fixed + best_fit(left, size)


def slots(patterns: list[Pattern]) -> tuple[np.ndarray, ...]:
    """Sorted by length and first number: length, first number, first sequence, offset.  Numbers run from 0 per length."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for w in pattern:
            rows.append((w, used.get(w, 0), sequence, offset))
            used[w] = used.get(w, 0) + n
            offset += w
        sequence += n
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def place(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset to rows (doc_id, piece, length, ...) of a settled table."""
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    length, first, sequence, offset = slots(pack_histogram(counts, size))
    key = (length << 44) + first
    rows = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(4 * partitions(spark))))
    before = (rows.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
              .select("length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before")))
    inside = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = rows.withColumn("_inside", inside).join(before, ["length", "_bucket"]).withColumn("number", F.col("_before") + F.col("_inside") - 1)
    names = [c for c in pieces.columns]
    at = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(len(names)).to_numpy()
            slot = np.searchsorted(key, (batch.column(at).to_numpy().astype(np.int64) << 44) + number, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence[slot] + number - first[slot]), pa.array(offset[slot])], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{n} {t}" for n, t in pieces.dtypes)
    return numbered.select(*names, "number").mapInArrow(tidy(run), f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str = "byte_bpe_50k.json") -> tuple[DataFrame, DataFrame]:
    """The pieces with their ids (settled), and the placement of every piece, in sequences of at most ``size`` ids.

    Null and empty texts are one piece holding the end id.  Repeated rows are packed as often as they come; a null doc_id stays null;
    other columns are ignored; an empty table gives no piece.
    """
    pieces = table(piece_rows(docs, size, vocabulary))
    return pieces, place(pieces.drop("ids"), size)
