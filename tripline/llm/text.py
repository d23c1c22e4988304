"""Whole texts of Arrow batches as numpy arrays: bytes, words, lines, and 64-bit hashes of any span.

A block holds the UTF-8 bytes of many documents, each followed by one newline, so lines and words
never cross documents.  Hashes are polynomials over random values of the bytes modulo 2^64; a span's hash
comes from two prefix sums, whatever its length.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text worked on at once inside a task; a longer document makes a block of its own.
BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
#: Folders of the tables written inside each ``finished`` that is under way.
_SCOPES: list[list[str]] = []

#: Space and \t \n \v \f \r end a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the bytes of an Arrow batch, so that long texts come in batches of few rows."""
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
                       "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}.items():
        spark.conf.set(key, value)
    return spark


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the folder of ``spark.checkpoint.dir``; only a local test session gets its own."""
    from tripline.session import settle

    return settle(df)


def table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to a new folder beside the checkpoints and read it back, so that later plans read only
    the columns they need.  Files are committed per task, so a lost executor costs a repeated task at most."""
    from tripline.session import scratch

    folder = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    if _SCOPES:
        _SCOPES[-1].append(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``table`` that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, [df._folder])


def _delete(spark: SparkSession, folders: list[str]) -> None:
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for folder in folders:
        path = hadoop.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def finished(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, as a table; the tables it wrote on the way are deleted once this one is there."""
    _SCOPES.append([])
    try:
        made = make()
    finally:
        used = _SCOPES.pop()
    out = table(made)
    _delete(out.sparkSession, used)
    return out


def give_back() -> None:
    """Give the memory this process has freed back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which gives the memory it has freed back when a task ends: workers live on and the next stage's need theirs."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a function of one group; what it returns stays."""
    def tidied(group: pa.Table) -> pa.Table:
        out = run(group)
        give_back()
        return out

    return tidied


def tidy_cogroup(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a function of two groups."""
    def tidied(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        give_back()
        return out

    return tidied


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def splitmix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value for each of ``x``."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = splitmix(np.arange(256, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 .. n and their inverses modulo 2^64."""
    have = _POWERS.get("up")
    if have is None or len(have) <= n:
        size = max(n + n // 8 + 1, BLOCK_BYTES + BLOCK_BYTES // 8)  # both stay with the worker
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums (one more than ``values``) from which ``span_hash`` makes hashes."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end)."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


@dataclass
class Block:
    """Documents ``lo`` .. ``hi`` of a batch.  ``buf[start[i] : end[i]]`` is a text; ``buf[end[i]]`` its newline."""

    lo: int
    hi: int
    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    _cache: dict = field(default_factory=dict)

    @property
    def size(self) -> int:
        return self.hi - self.lo

    def prefix(self) -> np.ndarray:
        if "prefix" not in self._cache:
            self._cache["prefix"] = prefix_hash(BYTE_VALUES[self.buf])
        return self._cache["prefix"]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and the first word of each document (one more than documents)."""
        if "words" not in self._cache:
            space = SPACE[self.buf]
            edge = np.flatnonzero(space[1:] != space[:-1]) + 1
            if len(space) and not space[0]:
                edge = np.concatenate(([0], edge))
            start, end = edge[0::2], edge[1::2]
            self._cache["words"] = (start, end, np.append(np.searchsorted(start, self.start), len(start)))
        return self._cache["words"]

    def word_hashes(self) -> np.ndarray:
        if "hashes" not in self._cache:
            start, end, _ = self.words()
            self._cache["hashes"] = splitmix(span_hash(self.prefix(), start, end) + (end - start).astype(np.uint64))
        return self._cache["hashes"]

    def shingles(self, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of ``width`` words: first word, document, hash.  A text of fewer words has none."""
        hashes, first = self.word_hashes(), self.words()[2]
        count = np.maximum(np.diff(first) - width + 1, 0)
        doc = np.repeat(np.arange(self.size), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
        total = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
        for k in range(width):
            total = total * np.uint64(_BASE) + hashes[k : k + len(total)]
        return at, doc, splitmix(total)[at] if len(at) else np.zeros(0, np.uint64)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each line split at \\n, and the first line of each document (one more than documents)."""
        end = np.flatnonzero(self.buf == 10)
        start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
        return start, end, np.append(np.searchsorted(start, self.start), len(start))


def raw(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_large_string(column.type) else b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return memoryview(buffers[2] if buffers[2] is not None else b""), offsets


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a column of texts into blocks of whole documents of about ``most`` bytes."""
    data, at = raw(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        joined = b"\n".join([*(data[at[i] : at[i + 1]] for i in range(lo, hi)), b""])
        start = at[lo:hi] - at[lo] + np.arange(hi - lo)
        yield Block(lo, hi, np.frombuffer(joined, np.uint8), start, start + np.diff(at[lo : hi + 1]))
        lo = hi


def duplicated(doc: np.ndarray, hashes: np.ndarray, keep: str | bool) -> np.ndarray:
    """Which entries repeat another of the same document (``keep`` as in pandas)."""
    return pd.Series(splitmix(hashes + splitmix(doc))).duplicated(keep=keep).to_numpy()


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between successive entries of ``first``."""
    total = np.concatenate((np.zeros(1, np.float64 if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return total[first[1:]] - total[first[:-1]]


def fixed_sample(labelled: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """At most ``rows`` rows, the same at every run: those of smallest hash of the key."""
    from pyspark.sql import functions as F

    return labelled.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(rows)
