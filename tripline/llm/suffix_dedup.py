"""Operator 2, suffix-array dedup: remove the bytes covered by a 50-byte string that also starts in a document with a smaller id.

1.  Documents are packed into chunks, a settled table (compressed), and never pass through a shuffle as single rows.
2.  Every window of ``length`` bytes has an anchor, the leftmost 16-byte gram of smallest hash inside it; equal windows have equal
    anchors.  Neighbouring windows with one anchor form a piece.  Each chunk sends its anchors' hashes, once each, to
    shards, which send back those that more than one document holds.
3.  Pieces with such an anchor go to the anchor's shard, each text once per chunk with its smallest and largest document.  An anchor
    with more than ``HOT`` different pieces is cut into single windows keyed by their own hash, so that no key
    gathers many rows in one shard.
4.  A shard builds suffix arrays of its pieces by induced sorting and the permuted common prefixes.  Neighbours that agree on
    ``length`` bytes are one string; the smallest document of each string goes back to the chunks.  A window holds half of the bytes beside its
    anchor on one side of it, so a piece that shares neither side with a different piece shares no window and stays out; the others
    are sorted in lots of about ``LOT_BYTES``, all pieces of an anchor in one, so that the arrays stay small.
5.  Each chunk marks the bytes of its windows whose string has a smaller document, and cuts them out.

Anchors only decide which suffix array a window meets; every removal comes from the common prefixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.llm.suffixes import common_prefixes, suffix_array
from tripline.llm.text import BYTE_VALUES, finished, free_name, partitions, prefix_hash, raw, span_hash, splitmix, table, tidy, tidy_cogroup, tidy_group

LENGTH, GRAM, HOT, CHUNK_BYTES, LOT_BYTES = 50, 16, 2000, 4 << 20, 1 << 20
_SEGMENT, _PART = 1 << 16, 1 << 18
NULL_ID = (1 << 63) - 1


@dataclass
class Chunk:
    """Documents in rising order of id; ``buf[start[i] : end[i]]`` is a text, followed by a zero byte."""

    doc: np.ndarray
    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray


@dataclass
class Pieces:
    """Runs of windows with one anchor: first window, windows, anchor hash, document index, bytes from the first window to the anchor."""

    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    doc: np.ndarray
    at: np.ndarray


def pack_chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, doc, sizes, bytes, packed): whole texts of many documents per row.  A null doc_id counts as the largest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, k = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal k, size
            held.sort(key=lambda r: r[0])
            data = b"".join(t for _, t in held)
            out = pa.RecordBatch.from_arrays([pa.array([base + k], pa.int64()), pa.array([np.array([d for d, _ in held], "<i8").tobytes()], pa.binary()), pa.array([np.array([len(t) for _, t in held], "<i8").tobytes()], pa.binary()),
                                              pa.array([len(data)], pa.int64()), pa.array([pa.compress(data, "zstd", asbytes=True)], pa.binary())], ["chunk", "doc", "sizes", "bytes", "packed"])
            held.clear()
            size, k = 0, k + 1
            return out

        for batch in batches:
            data, at = raw(batch.column(1))
            for i, d in enumerate(batch.column(0).to_pylist()):
                held.append((NULL_ID if d is None else d, bytes(data[at[i] : at[i + 1]])))
                size += len(held[-1][1]) + 64
                if size >= chunk_bytes:
                    yield flush()
        if held:
            yield flush()

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(tidy(run), "chunk long, doc binary, sizes binary, bytes long, packed binary"))


def unpack(doc: bytes, sizes: bytes, n: int, packed: bytes) -> Chunk:
    doc, size = np.frombuffer(doc, "<i8"), np.frombuffer(sizes, "<i8")
    data = memoryview(pa.decompress(packed, n, "zstd"))
    at = np.concatenate(([0], np.cumsum(size)))
    buf = np.frombuffer(b"\0".join([*(data[a:b] for a, b in zip(at, at[1:], strict=False)), bytes(LENGTH)]), np.uint8)
    start = at[:-1] + np.arange(len(doc))
    return Chunk(doc, buf, start, start + size)


def cut(chunk: Chunk, length: int = LENGTH) -> Pieces:
    """All pieces of a chunk, in order."""
    n = len(chunk.buf)
    stop_at = np.maximum(chunk.start, chunk.end - length + 1)  # windows of a document start before
    span = length - GRAM + 1  # grams in a window
    starts, counts, anchors, offsets = [], [], [], []
    for lo in range(0, n, _SEGMENT - span):
        hi = min(lo + _SEGMENT - span, n)
        a, b = max(int(np.searchsorted(chunk.start, lo, side="right")) - 1, 0), int(np.searchsorted(chunk.start, hi))
        edge = np.clip(np.append(chunk.start[a:b], hi), lo, hi)
        ok = np.arange(lo, lo + edge[-1] - edge[0]) < np.repeat(stop_at[a:b], np.diff(edge))
        if not ok.any():
            continue
        part = chunk.buf[lo : lo + _SEGMENT + GRAM - 1]
        if len(part) < length:
            break
        grams = len(part) - GRAM + 1
        eight = np.empty(len(part) - 7, np.uint64)
        for r in range(8):
            view = part[r : r + (len(part) - r) // 8 * 8].view("<u8")
            eight[r::8] = view[: len(eight[r::8])]
        h = eight[:grams] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h += eight[8 : 8 + grams]
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x165667B19E3779F9)
        h &= ~np.uint64(0xFFFF)
        h |= np.arange(grams, dtype=np.uint64)
        least, width = h, 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        m = min(len(ok), len(least))
        ok, least = ok[:m], least[:m]
        first = ok.copy()
        first[1:] &= (least[1:] != least[:-1]) | ~ok[:-1]
        stop = ok.copy()
        stop[:-1] &= (least[1:] != least[:-1]) | ~ok[1:]
        at, to = np.flatnonzero(first), np.flatnonzero(stop)
        starts.append(at + lo)
        counts.append(to - at + 1)
        anchors.append(least[at] >> np.uint64(16))
        offsets.append((least[at] & np.uint64(0xFFFF)).astype(np.int64) - at)
    if not starts:
        empty = np.zeros(0, np.int64)
        return Pieces(empty, empty, empty.astype(np.uint64), empty, empty)
    start = np.concatenate(starts)
    return Pieces(start, np.concatenate(counts), np.concatenate(anchors), np.searchsorted(chunk.start, start, side="right") - 1, np.concatenate(offsets))


def _chunk_prefixes(buf: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Prefix hashes of overlapping parts of a buffer, so that memory stays small; spans of up to 256 bytes lie in one part."""
    for lo in range(0, len(buf), _PART):
        yield lo, prefix_hash(BYTE_VALUES[buf[lo : lo + _PART + 256]])


def text_hash(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; ``start`` rises."""
    out = np.zeros(len(start), np.uint64)
    for lo, prefix in _chunk_prefixes(buf):
        a, b = np.searchsorted(start, (lo, lo + _PART))
        out[a:b] = span_hash(prefix, start[a:b] - lo, start[a:b] - lo + size[a:b])
    return splitmix(out + size.astype(np.uint64))


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order by keys, and where each group of equal keys begins in it."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(new)


def anchors_of(chunk: Chunk, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors of a chunk; for each: how many different pieces, plus 2^15 if two documents hold it."""
    p = cut(chunk, length)
    text = text_hash(chunk.buf, p.start, p.windows + length - 1)
    order, at = _groups(p.anchor, text)
    anchor = p.anchor[order][at]
    doc = chunk.doc[p.doc[order]]
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    to = np.flatnonzero(new)
    begin = at[to]
    if not len(to):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    many = np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)
    different = np.minimum(np.diff(np.append(to, len(anchor))), (1 << 15) - 1)
    return anchor[to], (different + (many.astype(np.int64) << 15)).astype(np.uint64)


def windows_of(p: Pieces, pick: np.ndarray) -> Pieces:
    """The picked pieces as single windows; their anchor is yet to be set."""
    n = p.windows[pick]
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return Pieces(np.repeat(p.start[pick], n) + inside, np.ones(len(inside), np.int64), np.zeros(len(inside), np.uint64), np.repeat(p.doc[pick], n), np.repeat(p.at[pick], n) - inside)


def selected(chunk: Chunk, shared: np.ndarray, hot: np.ndarray, length: int) -> tuple[Pieces, np.ndarray]:
    """Pieces whose anchor is shared, hot ones as windows; and the hash of each text.  ``shared`` and ``hot`` are sorted."""
    p = cut(chunk, length)
    has = lambda keys: keys[np.minimum(np.searchsorted(keys, p.anchor), len(keys) - 1)] == p.anchor if len(keys) else np.zeros(len(p.anchor), bool)
    is_hot = has(hot)
    plain = np.flatnonzero(has(shared) & ~is_hot)
    one = Pieces(p.start[plain], p.windows[plain], p.anchor[plain], p.doc[plain], p.at[plain])
    h1 = text_hash(chunk.buf, one.start, one.windows + length - 1)
    w = windows_of(p, np.flatnonzero(is_hot))
    h2 = text_hash(chunk.buf, w.start, w.windows + length - 1)
    w.anchor = h2 >> np.uint64(16)
    both = Pieces(*(np.concatenate((getattr(one, f), getattr(w, f))) for f in ("start", "windows", "anchor", "doc", "at")))
    return both, np.concatenate((h1, h2))


def solve(texts: np.ndarray, start: np.ndarray, size: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each piece the smallest document that holds its string: values, and the first of each piece.

    ``texts[start : start + size]`` are different pieces, ``least`` their smallest documents.
    """
    n = int(size.sum())
    new = np.cumsum(size + 1) - size - 1
    s = np.ones(n + len(size) + 1, np.int32)  # 1 ends a piece, 0 ends all
    inside = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    s[np.repeat(new, size) + inside] = texts[np.repeat(start, size) + inside].astype(np.int32) + 2
    s[-1] = 0
    sa = suffix_array(s)
    shared = common_prefixes(s, sa, new, size, length)
    windows = size - length + 1
    first = np.concatenate(([0], np.cumsum(windows)))
    at = np.full(len(s), -1, np.int64)
    inside = np.arange(first[-1]) - np.repeat(first[:-1], windows)
    where = np.repeat(new, windows) + inside
    at[where] = np.arange(first[-1])
    owner = np.repeat(least, windows)
    sorted_window = at[sa]
    is_window = sorted_window >= 0
    rank = np.cumsum(shared[sa] < length)  # a string's suffixes stand together
    window, group = sorted_window[is_window], rank[is_window]
    out = np.zeros(first[-1], np.int64)
    if len(window):
        begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        low = np.minimum.reduceat(owner[window], begin)
        out[window] = np.repeat(low, np.diff(np.append(begin, len(window))))
    return out, first


def candidates(texts: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the different pieces may share a window with another, and the hash of each piece's anchor.  ``start`` rises.

    A window with ``half`` bytes or more before its anchor holds the last ``half`` of them and the anchor, any other the anchor and the
    ``length - GRAM - half + 1`` bytes behind it.
    """
    half = (length - GRAM) // 2
    before, after = at >= half, at - (size - length) < half
    some = np.zeros(len(start), bool)
    for has, back, n in ((before, half, GRAM + half), (after, 0, length - half + 1)):
        who = np.flatnonzero(has)
        order, first = _groups(text_hash(texts, start[who] + at[who] - back, np.full(len(who), n)))
        count = np.diff(np.append(first, len(who)))
        some[who[order[np.repeat(count > 1, count)]]] = True
    return some, text_hash(texts, start + at, np.full(len(start), GRAM))


def covered(texts: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows whose strings have one smallest document, in order of the pieces: piece, first and last window, document."""
    by = np.argsort(start)
    some, anchor = candidates(texts, start[by], size[by], at[by], length)
    alone, some, anchor = by[~some], by[some], anchor[some]
    found = [(alone, np.zeros(len(alone), np.int64), size[alone] - length, least[alone])]
    lots = -(-int(size[some].sum()) // LOT_BYTES)
    lot = splitmix(anchor) % np.uint64(max(lots, 1))
    order, first = _groups(lot)
    for a, b in zip(first, np.append(first[1:], len(order)), strict=False):
        mine = some[order[a:b]]
        low, begin_of = solve(texts, start[mine], size[mine], least[mine], length)
        owner = np.repeat(np.arange(len(mine)), np.diff(begin_of))
        edge = np.ones(len(low), bool)
        edge[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(edge)
        stop = np.append(begin[1:], len(low)) - 1
        found.append((mine[owner[begin]], begin - begin_of[owner[begin]], stop - begin_of[owner[begin]], low[begin]))
    piece, head, last, low = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((head, piece))
    return piece[order], head[order], last[order], low[order]


def mark(chunk: Chunk, p: Pieces, text: np.ndarray, runs: tuple[np.ndarray, ...], length: int) -> np.ndarray:
    """Which bytes of the buffer go.  ``runs``: text hash, first and last window, smallest document."""
    key, first, last, least = runs
    order = np.lexsort((first, key))
    key, first, last, least = key[order], first[order], last[order], least[order]
    lo, hi = np.searchsorted(key, text, side="left"), np.searchsorted(key, text, side="right")
    n = hi - lo
    of = np.repeat(np.arange(len(text)), n)
    run = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    goes = least[run] < chunk.doc[p.doc[of]]
    of, run = of[goes], run[goes]
    step = np.zeros(len(chunk.buf) + 1, np.int32)
    np.add.at(step, p.start[of] + first[run], 1)
    np.add.at(step, p.start[of] + last[run] + length, -1)
    return np.cumsum(step, out=step)[:-1] > 0


def _blob(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values).astype(kind).tobytes()


def _bytes_of(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    """The spans of ``buf``, one after the other."""
    return buf[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())].tobytes()


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column if x.is_valid), kind)


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, digest, n_bytes, kept, span_start, span_end): md5 of the text, the remaining bytes and the removed runs of every row of ``docs``.

    Null text is empty.  Rows with one doc_id do not remove each other's bytes; rows with a null doc_id count as the largest id.  Texts below ``length`` bytes stay
    whole.  Other columns are ignored, an empty table gives no rows.
    """
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")
    spark = docs.sparkSession
    chunks = table(pack_chunks(docs))
    total = chunks.agg(F.sum("bytes")).head()[0] or 0
    shards = max(2 * partitions(spark), -(-total // (2 * CHUNK_BYTES)))
    parts = max(partitions(spark), -(-total // (4 * CHUNK_BYTES)))

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                anchor, seen = anchors_of(unpack(row["doc"], row["sizes"], row["bytes"], row["packed"]), length)
                to = (splitmix(anchor) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                at = np.searchsorted(to[order], np.arange(shards + 1))
                value = ((anchor << np.uint64(16)) | seen)[order]
                full = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), pa.array([row["chunk"]] * len(full), pa.int64()), pa.array([_blob(value[at[k] : at[k + 1]], "<u8") for k in full], pa.binary())],
                                                 ["shard", "chunk", "anchors"])

    def find_shared(t: pa.Table) -> pa.Table:
        value = _joined(t.column("anchors"), "<u8")
        chunk = np.repeat(t.column("chunk").to_numpy(), [len(x.as_buffer()) // 8 for x in t.column("anchors")])
        order = np.argsort(value >> np.uint64(16), kind="stable")
        anchor, seen, chunk = (value >> np.uint64(16))[order], (value & np.uint64(0xFFFF)).astype(np.int64)[order], chunk[order]
        begin = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(anchor) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(anchor)))
        several = (size > 1) | (np.maximum.reduceat(seen, begin) >> 15 > 0) if len(begin) else np.zeros(0, bool)
        hot = np.add.reduceat(seen & 0x7FFF, begin) > HOT if len(begin) else np.zeros(0, bool)
        pick = np.repeat(several, size)
        anchor, chunk, hot = anchor[pick], chunk[pick], np.repeat(hot, size)[pick]
        order = np.lexsort((anchor, chunk))
        anchor, chunk, hot = anchor[order], chunk[order], hot[order]
        ids, at = np.unique(chunk, return_index=True)
        cuts = list(zip(at, np.append(at, len(chunk))[1:], strict=True))
        return pa.table({"chunk": pa.array(ids, pa.int64()), "shared": pa.array([_blob(anchor[a:b] << np.uint64(1) | hot[a:b].astype(np.uint64), "<u8") for a, b in cuts], pa.binary())})

    shared = table(chunks.select("chunk", "doc", "sizes", "bytes", "packed").mapInArrow(tidy(send_anchors), "shard long, chunk long, anchors binary")
                   .repartition(parts, "shard").groupBy("shard").applyInArrow(tidy_group(find_shared), "chunk long, shared binary"))

    def keys(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        value = np.unique(_joined(t.column("shared"), "<u8"))
        anchor, hot = value >> np.uint64(1), (value & np.uint64(1)) > 0
        return anchor, anchor[hot]

    def send_pieces(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in ("shard", "chunk", "hashes", "sizes", "at", "least", "most", "texts")}
        for row in left.to_pylist():
            chunk = unpack(row["doc"], row["sizes"], row["bytes"], row["packed"])
            p, text = selected(chunk, *keys(right), length)
            to = splitmix(p.anchor) % np.uint64(shards)
            order, at = _groups(to, text)
            if not len(order):
                continue
            doc = chunk.doc[p.doc[order]]
            low, high = np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)
            pick = order[at]
            size = p.windows[pick] + length - 1
            shard = to[pick]
            edge = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
            for a, b in zip(edge, edge[1:], strict=False):
                for name, value in zip(out, (int(shard[a]), row["chunk"], _blob(text[pick[a:b]], "<u8"), _blob(size[a:b], "<u2"), _blob(p.at[pick[a:b]], "<u1"), _blob(low[a:b], "<i8"), _blob(high[a:b], "<i8"),
                                             pa.compress(_bytes_of(chunk.buf, p.start[pick[a:b]], size[a:b]), "zstd", asbytes=True)), strict=True):
                    out[name].append(value)
        kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 6)
        return pa.table({n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds, strict=True)})

    def search(t: pa.Table) -> pa.Table:
        text, size = _joined(t.column("hashes"), "<u8"), _joined(t.column("sizes"), "<u2").astype(np.int64)
        offset, least, most = _joined(t.column("at"), "<u1").astype(np.int64), _joined(t.column("least"), "<i8"), _joined(t.column("most"), "<i8")
        count = np.array([len(x.as_buffer()) // 8 for x in t.column("hashes")])
        row = np.repeat(np.arange(len(count)), count)
        n_bytes = np.add.reduceat(size, np.cumsum(count) - count)
        data = np.frombuffer(b"".join(pa.decompress(x.as_buffer(), int(n), "zstd", asbytes=True) for x, n in zip(t.column("texts"), n_bytes, strict=True)), np.uint8)
        start = np.cumsum(size) - size
        order, at = _groups(text)
        group = np.empty(len(text), np.int64)
        group[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(text))))
        pick = order[at]
        run_owner, run_first, run_last, run_low = covered(data, start[pick], size[pick], offset[pick], np.minimum.reduceat(least[order], at), length)
        run_at = np.searchsorted(run_owner, np.arange(len(pick) + 1))
        # to each chunk, for its own pieces, what can cover one of its documents
        n = (run_at[1:] - run_at[:-1])[group]
        of = np.repeat(np.arange(len(text)), n)
        run = np.repeat(run_at[group], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        use = run_low[run] < most[of]
        of, run = of[use], run[use]
        edges = np.searchsorted(row[of], np.arange(len(count) + 1))
        rows = [k for k in range(len(count)) if edges[k] < edges[k + 1]]
        cut_at = lambda v, kind: pa.array([_blob(v[edges[k] : edges[k + 1]], kind) for k in rows], pa.binary())
        return pa.table({"chunk": pa.array([t.column("chunk")[k].as_py() for k in rows], pa.int64()), "hashes": cut_at(text[of], "<u8"), "first": cut_at(run_first[run], "<u2"),
                         "last": cut_at(run_last[run], "<u2"), "least": cut_at(run_low[run], "<i8")})

    def remove(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        for row in left.to_pylist():
            chunk = unpack(row["doc"], row["sizes"], row["bytes"], row["packed"])
            p, text = selected(chunk, *keys(right), length)
            runs = tuple(_joined(right.column(n), k) for n, k in (("hashes", "<u8"), ("first", "<u2"), ("last", "<u2"), ("least", "<i8")))
            gone = mark(chunk, p, text, (runs[0], runs[1].astype(np.int64), runs[2].astype(np.int64), runs[3]), length)
            edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
            on, off = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
            at = np.searchsorted(on, np.append(chunk.start, len(chunk.buf)))
            for lo in range(0, len(chunk.doc), 1000):
                some = range(lo, min(lo + 1000, len(chunk.doc)))
                yield pa.RecordBatch.from_arrays([
                    pa.array([None if chunk.doc[i] == NULL_ID else int(chunk.doc[i]) for i in some], pa.int64()),
                    pa.array([hashlib.md5(chunk.buf[chunk.start[i] : chunk.end[i]]).hexdigest() for i in some], pa.string()), pa.array([int(chunk.end[i] - chunk.start[i]) for i in some], pa.int64()),
                    pa.array([chunk.buf[chunk.start[i] : chunk.end[i]][~gone[chunk.start[i] : chunk.end[i]]].tobytes() for i in some], pa.binary()),
                    *(pa.array([(v[at[i] : at[i + 1]] - chunk.start[i]).tolist() for i in some], pa.list_(pa.int64())) for v in (on, off))],
                    ["doc_id", "digest", "n_bytes", "kept", "span_start", "span_end"])

    chunk_rows = chunks.repartition(parts, "chunk").groupBy("chunk")
    pieces = chunk_rows.cogroup(shared.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(tidy_cogroup(send_pieces), "shard long, chunk long, hashes binary, sizes binary, at binary, least binary, most binary, texts binary")
    runs = pieces.repartition(parts, "shard").groupBy("shard").applyInArrow(tidy_group(search), "chunk long, hashes binary, first binary, last binary, least binary")
    back = runs.withColumn("shared", F.lit(None).cast("binary")).unionByName(shared, allowMissingColumns=True)
    return chunk_rows.cogroup(back.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(
        tidy_cogroup(lambda a, b: pa.Table.from_batches(list(remove(a, b)), pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("span_start", pa.list_(pa.int64())), ("span_end", pa.list_(pa.int64()))]))),
        "doc_id long, digest string, n_bytes long, kept binary, span_start array<long>, span_end array<long>")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with texts cut by ``suffix_dedup``.

    Bytes of a character cut in two go with the passage; a document of nothing but such passages stays, with an empty text; a text without such passages, null
    included, stays as it is.  Rows of one doc_id and text are cut alike, as little as the least cut of them.  A column ``n_chars`` is counted anew.
    Columns of any other name are kept as they are.
    """
    key, left, at = free_name(docs, "_digest"), free_name(docs, "_kept"), docs.columns.index("text")
    kept = finished(lambda: suffix_dedup(docs).where("size(span_start) > 0").groupBy(F.col("doc_id").alias("doc_id"), F.col("digest").alias(key)).agg(F.min("kept").alias(left)))
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    joined = docs.withColumn(key, digest).join(kept, ["doc_id", key], "left").select(*docs.columns, left)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, rest = batch.column(at).to_pylist(), batch.column(len(batch.columns) - 1).to_pylist()
            text = pa.array([t if k is None else k.decode("utf-8", "ignore") for t, k in zip(whole, rest, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(batch.columns[:-1])], batch.schema.names[:-1])

    out = joined.mapInArrow(tidy(cut), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else out
