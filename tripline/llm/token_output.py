"""Operator 5, token-id files: canonical length-limited Huffman codes from global counts, decoded by table in independent blocks.

Ids are encoded once into a table of the shared folder; their counts are added up per task, so that one row per task and id is shuffled and
at most one row per vocabulary entry reaches the driver, which makes code lengths of at most ``MAX_BITS`` bits (package-merge).
Documents are dealt to files by ranges of doc_id; a file holds its documents in ascending order.

A file is one row (part, n_tokens, content) of a Spark table, so it lands in any store Spark writes to, and a lost task
leaves nothing behind.  ``content``, little-endian:

    magic "HUF1", uint32 documents, uint64 ids, uint32 ids per block
    int64 doc_id, uint8 known (0: the id is null) and uint32 ids of each document
    uint64 bit offset of each block
    the codes, most significant bit first, and four zero bytes

Code lengths go to a table of their own (id, bits); canonical codes follow from the lengths.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripline.llm.text import partitions, table
from tripline.llm.tokens import END_ID, crc, encoder

MAX_BITS, BLOCK_IDS, FILE_IDS = 16, 1024, 4 << 20
_HEAD = struct.Struct("<4sIQI")


def token_rows(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """(doc_id, n, ids): the ids of each whole text with the end id, as unsigned 16-bit numbers.  Null text is empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.append(x, np.uint16(END_ID)).astype("<u2") for x in encoder(vocabulary).encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, ids binary")


def id_counts(tokens: DataFrame) -> dict[int, int]:
    """How often each id occurs, over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_py(), "<u2"), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    return {r.id: r.n for r in tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}


def code_lengths(counts: dict[int, int], most: int = MAX_BITS) -> dict[int, int]:
    """Optimal lengths of at most ``most`` bits, by package-merge."""
    if not counts:
        return {}
    ids = sorted(counts, key=lambda i: (counts[i], i))
    if len(ids) == 1:
        return {ids[0]: 1}
    if len(ids) > 1 << most:
        raise ValueError("more ids than codes")
    weight = np.array([counts[i] for i in ids], np.float64)
    levels: list[np.ndarray] = []  # at each level: is the n-th cheapest item a leaf?
    packages = np.zeros(0)
    for _ in range(most):
        items = np.concatenate((weight, packages))
        order = np.argsort(items, kind="stable")
        levels.append(order < len(weight))
        items = items[order]
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
    bits = np.zeros(len(ids), np.int64)
    take = 2 * len(ids) - 2
    for leaf in reversed(levels):
        n = int(leaf[:take].sum())
        bits[:n] += 1
        take = 2 * (take - n)
    return dict(zip(ids, bits.tolist(), strict=True))


@dataclass
class Codes:
    """Canonical codes: by (length, id)."""

    bits: np.ndarray
    code: np.ndarray
    symbol: np.ndarray  # of each MAX_BITS-bit prefix
    used: np.ndarray


def canonical(lengths: dict[int, int], most: int = MAX_BITS) -> Codes:
    size = 1 << 16
    bits, code = np.zeros(size, np.int64), np.zeros(size, np.int64)
    symbol, used = np.zeros(1 << most, np.uint16), np.zeros(1 << most, np.uint8)
    at = 0  # next code, aligned to ``most`` bits
    for i in sorted(lengths, key=lambda i: (lengths[i], i)):
        n = lengths[i]
        bits[i], code[i] = n, at >> (most - n)
        symbol[at : at + (1 << (most - n))] = i
        used[at : at + (1 << (most - n))] = n
        at += 1 << (most - n)
    return Codes(bits, code, symbol, used)


def write_file(docs: list[tuple[int | None, np.ndarray]], codes: Codes, block_ids: int = BLOCK_IDS) -> bytes:
    ids = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, np.uint16)
    checkpoints, parts, at = [], [], 0
    carry = np.zeros(0, np.uint8)
    step = block_ids * 1024
    for lo in range(0, len(ids), step):
        x = ids[lo : lo + step]
        n = codes.bits[x]
        end = at + np.cumsum(n)
        pos = end - n
        checkpoints.append(pos[::block_ids])
        byte0 = at >> 3
        where = (pos >> 3) - byte0
        value = codes.code[x] << (24 - n - (pos & 7))
        size = int((end[-1] >> 3) - byte0) + 3
        out = np.zeros(size, np.int64)
        for k, shift in enumerate((16, 8, 0)):
            out += np.bincount(where + k, (value >> shift) & 255, minlength=size)[:size].astype(np.int64)
        out[: len(carry)] += carry
        whole = int(end[-1] >> 3) - byte0
        parts.append(out[:whole].astype(np.uint8).tobytes())
        carry = out[whole : whole + 1].astype(np.uint8)  # the unfinished byte
        at = int(end[-1])
    parts.append(carry.tobytes())
    return b"".join([_HEAD.pack(b"HUF1", len(docs), len(ids), block_ids), np.array([d if d is not None else 0 for d, _ in docs], "<i8").tobytes(),
                     np.array([d is not None for d, _ in docs], np.uint8).tobytes(), np.array([len(x) for _, x in docs], "<u4").tobytes(),
                     np.concatenate(checkpoints).astype("<u8").tobytes() if checkpoints else b"", *parts, bytes(4)])


def read_file(content: bytes, codes: Codes, blocks: range | None = None) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids of each document, and the decoded ids (of ``blocks`` only, if given); blocks decode side by side."""
    magic, n_docs, n_ids, block_ids = _HEAD.unpack_from(content)
    if magic != b"HUF1":
        raise ValueError("not a token file")
    at = _HEAD.size
    doc = np.frombuffer(content, "<i8", n_docs, at)
    known = np.frombuffer(content, np.uint8, n_docs, at + 8 * n_docs)
    n = np.frombuffer(content, "<u4", n_docs, at + 9 * n_docs)
    at += 13 * n_docs
    n_blocks = -(-n_ids // block_ids)
    bit = np.frombuffer(content, "<u8", n_blocks, at).astype(np.int64)
    data = np.frombuffer(content, np.uint8, offset=at + 8 * n_blocks)
    blocks = range(n_blocks) if blocks is None else blocks
    out = []
    for lo in range(blocks.start, blocks.stop, 1024):
        hi = min(lo + 1024, blocks.stop)
        pos = bit[lo:hi].copy()
        got = np.zeros((block_ids, hi - lo), np.uint16)
        last = n_ids - (n_blocks - 1) * block_ids if hi == n_blocks else block_ids
        for k in range(block_ids):
            if k == last:  # the final block is shorter
                pos, got_k = pos[:-1], got[:, : hi - lo - 1]
            elif k < last:
                got_k = got
            if not len(pos):
                break
            b = pos >> 3
            peek = ((data[b].astype(np.int64) << 16 | data[b + 1].astype(np.int64) << 8 | data[b + 2]) >> (8 - (pos & 7))) & 0xFFFF
            got_k[k] = codes.symbol[peek]
            pos = pos + codes.used[peek]
        flat = got.T.reshape(-1)
        out.append(flat[: n_ids - lo * block_ids] if hi == n_blocks else flat)
    return [int(d) if k else None for d, k in zip(doc, known, strict=True)], n, np.concatenate(out) if out else np.zeros(0, np.uint16)


@dataclass
class TokenFiles:
    """``files`` (part, n_tokens, content) and ``lengths`` (id, bits), both written tables: what a later program needs to read the ids back."""

    files: DataFrame
    lengths: DataFrame


def write_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", file_ids: int = FILE_IDS) -> TokenFiles:
    """Write the ids of all ``docs`` in ascending doc_id order (null ids first), about ``file_ids`` to a file.

    Empty and null texts hold the end id alone; repeated rows are written as often as they come, in an order set by their ids; other columns are
    ignored; an empty table gives no file.
    """
    spark = docs.sparkSession
    tokens = table(token_rows(docs, vocabulary))
    counts = id_counts(tokens)
    lengths = code_lengths(counts)
    codes = canonical(lengths)
    n_files = max(partitions(spark), -(-sum(counts.values()) // file_ids))
    bounds = tokens.select(F.percentile_approx("doc_id", [k / n_files for k in range(1, n_files)] or [0.5], 100 * n_files).alias("p")).head()
    bounds = sorted(set(bounds.p or []))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(-(1 << 63)).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, ids, side="left").astype(np.int64)), *batch.columns], ["part", *batch.schema.names])

    def encode(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("doc_id").to_pylist(), t.column("ids").to_pylist(), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        pairs = [(d, np.frombuffer(x, "<u2")) for d, x in rows]
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int64()), "n_tokens": pa.array([sum(len(x) for _, x in pairs)], pa.int64()), "content": pa.array([write_file(pairs, codes)], pa.binary())})

    dealt = tokens.mapInArrow(number, "part long, doc_id long, n long, ids binary").select("part", "doc_id", "ids")
    return TokenFiles(table(dealt.groupBy("part").applyInArrow(encode, "part long, n_tokens long, content binary")),
                      table(spark.createDataFrame(sorted(lengths.items()) or [], "id int, bits int")))


def read_tokens(written: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, decoded from the files; ``ids`` are unsigned 16-bit numbers."""
    return with_starts(decoded(written), written)


def decoded(written: TokenFiles) -> DataFrame:
    """(part, doc_id, inside, n_tokens, ids): documents of each file with the ids before them in it.  The codes are made from the stored lengths, one row per id of the vocabulary."""
    codes = canonical({r.id: r.bits for r in written.lengths.collect()})

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc, n, ids = read_file(content.as_buffer(), codes)
                end = np.cumsum(n, dtype=np.int64)
                for lo in range(0, len(doc), 1000):
                    hi = min(lo + 1000, len(doc))
                    yield pa.RecordBatch.from_arrays([pa.array([part] * (hi - lo), pa.int64()), pa.array(doc[lo:hi], pa.int64()), pa.array(end[lo:hi] - n[lo:hi]), pa.array(n[lo:hi].astype(np.int64)),
                                                      pa.array([ids[e - k : e].tobytes() for e, k in zip(end[lo:hi], n[lo:hi], strict=True)], pa.binary())], ["part", "doc_id", "inside", "n_tokens", "ids"])

    return written.files.select("part", "content").mapInArrow(decode, "part long, doc_id long, inside long, n_tokens long, ids binary")


def with_starts(rows: DataFrame, written: TokenFiles) -> DataFrame:
    """``rows`` of ``decoded`` with ``start``, the ids of all documents before, instead of part and place.  Drop what is long first: the rows are joined with the files' sums."""
    before = written.files.select("part", (F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).alias("before"))
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), *[c for c in rows.columns if c not in ("part", "doc_id", "inside")])


def checksum(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Add the unsigned CRC-32 of the bytes of ``column``."""
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([zlib.crc32(x.as_buffer()) for x in batch.column(at)], pa.int64())], [*batch.schema.names, name])

    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + f", {name} long")


def ids_crc32(rows: DataFrame) -> DataFrame:
    """Replace the column ``ids`` by its checksum."""
    at = rows.columns.index("ids")
    names = [c if c != "ids" else "ids_crc32" for c in rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.array([crc(np.frombuffer(x.as_buffer(), "<u2")) for x in batch.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([c if i != at else sums for i, c in enumerate(batch.columns)], names)

    return rows.mapInArrow(run, ", ".join(f"{n} {'long' if n == 'ids_crc32' else t}" for n, (_, t) in zip(names, rows.dtypes, strict=True)))
