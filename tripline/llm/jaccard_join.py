"""Operator 11, n-gram Jaccard join: exact links between sets of word shingles, by signature trees inside exact buckets.

Buckets.  Two linked sets differ in few members: at most (1 - t) / t of the smaller one's size.  The range of hashes is cut into more segments than
that, so at least one segment holds the same members in both.  A set therefore sends a key per segment (the segment's members, hashed) and linked sets
share a key.  The number of segments follows the size in bands; a set whose partner may be of the band below sends that band's keys too.  A set that fills
so few segments that the shared ones could be empty sends keys of its empty segments as well.  So no link is lost, whatever the texts.

Trees.  All sets that share a bucket with a bucket's smallest member meet in that member's group.  A group is a tree: leaves hold bitmaps of shingles, inner
nodes the OR of their children's and the range of their sizes.  Two trees, or a tree and itself, are walked together; a pair of nodes is left
when its sizes are too far apart, when the bits both have are fewer than the least overlap that could still link, or when all its sets are
connected already.  What reaches the leaves is compared exactly.  A group above ``BLOCK`` sets is cut into cells by size class and
hash, each a task of its own; then cells meet in pairs, unless sizes, bitmaps or connections rule the pair out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.llm.components import components
from tripline.llm.near_dedup import grouped
from tripline.llm.text import Block, blocks, partitions, splitmix, table

WIDTH, SHARE, BLOCK, SHINGLES = 3, (90, 100), 4096, 1 << 21
FANOUT, PAIRS, CELL_WORDS = 8, 1 << 15, 64
_EXTRA = 3


def lowered(block: Block) -> Block:
    """The same documents with A-Z in lower case."""
    upper = (block.buf >= 65) & (block.buf <= 90)
    return Block(block.lo, block.hi, block.buf + upper.astype(np.uint8) * np.uint8(32), block.start, block.end)


def shingle_sets(block: Block, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each distinct shingle, sorted; fewer words than ``width`` are one shingle, no words none."""
    _, doc, h = block.shingles(width)
    first = block.words()[2]
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        words = block.word_hashes()
        whole = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = n[short] > k
            whole[has] = splitmix(whole[has] + words[first[short[has]] + k])
        doc, h = np.concatenate((doc, short)), np.concatenate((h, splitmix(whole + n[short].astype(np.uint64))))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def size_bands(share: tuple[int, int], top: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """Smallest size of each band and its number of segments.  Smaller sets link only when equal."""
    num, den = share
    lows, segments, lo = [], [], -(-num // (den - num))
    while lo < top:
        hi = max(lo, lo * 3 // 2, lo * den // num)
        lows.append(lo)
        segments.append(hi * (den - num) // num + _EXTRA)
        lo = hi + 1
    return np.array(lows, np.int64), np.array(segments, np.int64)


def bucket_keys(doc: np.ndarray, h: np.ndarray, size: np.ndarray, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(document, key), sorted by document: linked sets of different members share a key."""
    num, den = share
    lows, segments = size_bands(share)
    own = np.searchsorted(lows, size, side="right") - 1
    below = np.searchsorted(lows, -(-size * num // den), side="right") - 1
    mixed = splitmix(h)
    docs, keys = [], []
    for band, take in ((own, own >= 0), (np.maximum(below, 0), (own > 0) & (np.maximum(below, 0) < own))):
        pick = take[doc]
        d, x, of = doc[pick], mixed[pick], band[doc[pick]]
        if not len(d):
            continue
        segment = ((h[pick] >> np.uint64(32)) * segments[of].astype(np.uint64)) >> np.uint64(32)
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (segment[1:] != segment[:-1])
        at = np.flatnonzero(new)
        place = splitmix((of[at].astype(np.uint64) << np.uint64(40)) + segment[at])
        docs.append(d[at])
        keys.append(splitmix(np.add.reduceat(x, at) + place))
        filled = np.bincount(d[at], minlength=len(size))
        for i in np.flatnonzero(take & (filled <= size * (den - num) // num)):
            empty = np.setdiff1d(np.arange(segments[band[i]], dtype=np.uint64), segment[at][d[at] == i])
            docs.append(np.full(len(empty), i))
            keys.append(splitmix(splitmix((np.uint64(band[i]) << np.uint64(40)) + empty)))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    docs, keys = np.concatenate(docs), np.concatenate(keys)
    order = np.argsort(docs, kind="stable")
    return docs[order], keys[order]


def sketches(docs: DataFrame, share: tuple[int, int] = SHARE, width: int = WIDTH) -> DataFrame:
    """(doc_id, n, digest, keys) per row of ``docs``: size of the set, 128 bits of its members' hashes, bucket keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, lists = [], [], []
            for plain in blocks(batch.column(1), 4 << 20):
                block = lowered(plain)
                doc, h = shingle_sets(block, width)
                size = np.bincount(doc, minlength=block.size)
                edge = np.concatenate(([0], np.cumsum(size)))
                sums = []
                for x in (splitmix(h), splitmix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))):
                    upto = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(x, out=upto[1:])
                    sums.append(upto[edge[1:]] - upto[edge[:-1]])
                at, key = bucket_keys(doc, h, size, share)
                starts = np.searchsorted(at, np.arange(block.size + 1)).astype(np.int32)
                sizes.append(size)
                digests += [a.tobytes() + b.tobytes() for a, b in zip(*sums, strict=True)]
                lists.append(pa.ListArray.from_arrays(pa.array(starts), pa.array(key.view(np.int64))))
            keys = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes) if sizes else [], pa.int64()), pa.array(digests, pa.binary()), keys], ["doc_id", "n", "digest", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n long, digest binary, keys array<long>")


@dataclass
class Level:
    """One level of a signature tree: OR of the bitmaps, smallest and greatest size, most shingles that share a bit with another."""

    bits: np.ndarray
    low: np.ndarray
    high: np.ndarray
    hidden: np.ndarray


def bitmaps(doc: np.ndarray, h: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A bitmap per set, as 64-bit words; ``bits`` is a power of two."""
    place = (h >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    step = max(1, (1 << 24) // bits)
    out = []
    for lo in range(0, n, step):
        hi = min(lo + step, n)
        flags = np.zeros((hi - lo, bits), bool)
        a, b = np.searchsorted(doc, (lo, hi))
        flags[doc[a:b] - lo, place[a:b]] = True
        out.append(np.packbits(flags, axis=1).view(np.uint64))
    return np.concatenate(out)


def signature_tree(bits: np.ndarray, size: np.ndarray) -> list[Level]:
    """Levels from the sets up to one node; a node's children are ``FANOUT`` neighbours."""
    levels = [Level(bits, size, size, size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64))]
    while len(levels[-1].bits) > 1:
        last = levels[-1]
        at = np.arange(0, len(last.bits), FANOUT)
        levels.append(Level(np.bitwise_or.reduceat(last.bits, at, axis=0), np.minimum.reduceat(last.low, at), np.maximum.reduceat(last.high, at), np.maximum.reduceat(last.hidden, at)))
    return levels


def may_link(a: Level, i: np.ndarray, b: Level, j: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Whether a set below node i and one below node j could link, by sizes and by the greatest overlap the bitmaps allow."""
    num, den = share
    low, high = a.low[i], b.low[j]
    ok = (den * a.high[i] >= num * high) & (den * b.high[j] >= num * low)
    at = np.flatnonzero(ok)
    if len(at):
        i, j = i[at], j[at]
        overlap = np.bitwise_count(a.bits[i] & b.bits[j]).sum(axis=1, dtype=np.int64) + np.minimum(a.hidden[i], b.hidden[j])
        # an overlap of o links sizes x and y only if (num + den) * o >= num * (x + y)
        ok[at] = (num + den) * overlap >= num * (low[at] + high[at])
    return ok


class Group:
    """Sets of one task with what connects them so far."""

    def __init__(self, texts: pa.Array, connected: np.ndarray, share: tuple[int, int], width: int):
        docs, hashes, n = [], [], 0
        for plain in blocks(texts, 4 << 20):
            doc, h = shingle_sets(lowered(plain), width)
            docs.append(doc + n)
            hashes.append(h)
            n += plain.size
        self.share, self.n = share, n
        self.doc, self.h = np.concatenate(docs), np.concatenate(hashes)
        self.size = np.bincount(self.doc, minlength=n)
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        self.code, unique = pd.factorize(self.h)
        self.mark = np.zeros(len(unique), bool)
        # label of each set's connected part: the first set in it
        self.part = np.unique(connected, return_inverse=True)[1].astype(np.int64)
        self.links: list[tuple[int, int]] = []

    def overlaps(self, i: int, others: np.ndarray) -> np.ndarray:
        self.mark[self.code[self.at[i] : self.at[i + 1]]] = True
        n = self.size[others]
        where = np.repeat(self.at[others], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        count = np.bincount(np.repeat(np.arange(len(others)), n), self.mark[self.code[where]], minlength=len(others)).astype(np.int64)
        self.mark[self.code[self.at[i] : self.at[i + 1]]] = False
        return count

    def compare(self, i: int, others: np.ndarray) -> None:
        """Exact comparison of set i with ``others``; what is connected already is left out."""
        num, den = self.share
        for lo in range(0, len(others), 256):
            near = others[lo : lo + 256]
            near = near[self.part[near] != self.part[i]]
            if not len(near):
                continue
            common = self.overlaps(i, near)
            for j in near[den * common >= num * (self.size[i] + self.size[near] - common)].tolist():
                if self.part[j] != self.part[i]:
                    self.part[self.part == self.part[j]] = self.part[i]
                    self.links.append((i, j))

    def tree(self, members: np.ndarray) -> tuple[np.ndarray, list[Level]]:
        """Members in an order that puts like sets side by side, and the tree over them."""
        bits = min(1 << 15, max(512, 1 << int(8 * self.size.max(initial=1) - 1).bit_length()))
        least = [np.full(self.n, np.iinfo(np.uint64).max) for _ in range(2)]
        some = np.flatnonzero(self.size)
        for k, x in enumerate(least):
            x[some] = np.minimum.reduceat(splitmix(self.h + np.uint64(k)), self.at[some]) if len(some) else x[some]
        order = members[np.lexsort((self.size[members], least[1][members], least[0][members]))]
        return order, signature_tree(bitmaps(self.doc, self.h, self.n, bits)[order], self.size[order])

    def connected(self, order: np.ndarray, depth: int) -> list[np.ndarray]:
        """Per level, the part all sets of a node belong to, or -1."""
        out = [self.part[order]]
        for _ in range(depth - 1):
            at = np.arange(0, len(out[-1]), FANOUT)
            low, high = np.minimum.reduceat(out[-1], at), np.maximum.reduceat(out[-1], at)
            out.append(np.where(low == high, low, -1))
        return out

    def walk(self, left: np.ndarray, right: np.ndarray | None = None) -> None:
        """Dual traversal of the tree of ``left`` with itself, or with the tree of ``right``."""
        own = right is None
        order_a, a = self.tree(left)
        order_b, b = (order_a, a) if own else self.tree(right)
        part_a = self.connected(order_a, len(a))
        part_b = part_a if own else self.connected(order_b, len(b))
        stack = [(len(a) - 1, len(b) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            x, y, i, j = stack.pop()
            live = (part_a[x][i] != part_b[y][j]) | (part_a[x][i] < 0)
            i, j = i[live], j[live]
            if own and x == y == 0:
                i, j = i[i < j], j[i < j]
            keep = may_link(a[x], i, b[y], j, self.share)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            if x == y == 0:
                before = len(self.links)
                for one in np.unique(i).tolist():
                    self.compare(int(order_a[one]), order_b[j[i == one]])
                if len(self.links) > before:
                    part_a = self.connected(order_a, len(a))
                    part_b = part_a if own else self.connected(order_b, len(b))
                continue
            # children of the higher side; of both where the trees are level
            down_a, down_b = x >= y, y >= x
            if down_a:
                step = np.arange(FANOUT)
                i, j = (i[:, None] * FANOUT + step).ravel(), np.repeat(j, FANOUT)
                x, has = x - 1, i < len(a[x - 1].bits)
                i, j = i[has], j[has]
            if down_b:
                step = np.arange(FANOUT)
                i, j = np.repeat(i, FANOUT), (j[:, None] * FANOUT + step).ravel()
                y, has = y - 1, j < len(b[y - 1].bits)
                i, j = i[has], j[has]
            if own:
                i, j = i[i <= j], j[i <= j]
            for lo in range(0, len(i), PAIRS):
                stack.append((x, y, i[lo : lo + PAIRS], j[lo : lo + PAIRS]))

    def summary(self) -> tuple[bytes, int, int, int]:
        """OR of the bitmaps of ``CELL_WORDS`` words, smallest and greatest size, most hidden shingles."""
        top = bitmaps(self.doc, self.h, self.n, 64 * CELL_WORDS)
        level = signature_tree(top, self.size)[-1]
        return level.bits[0].tobytes(), int(level.low[0]), int(level.high[0]), int(level.hidden[0])


def tree_links(rows: DataFrame, share: tuple[int, int], width: int, cross: bool) -> DataFrame:
    """Per group (g1 .. g4) of rows (side, part, node, text): links (a, b), and with ``cross`` off a row with the cell's summary.

    With ``cross``, sets of side 0 meet sets of side 1 only.  ``part`` names what is connected already.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, 4):
            node, side = rows.column("node").to_numpy(), rows.column("side").to_numpy()
            group = Group(rows.column("text").combine_chunks(), rows.column("part").to_numpy(), share, width)
            if cross:
                group.walk(np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            else:
                group.compare(0, np.arange(1, group.n))
                group.walk(np.arange(group.n))
            cell = [rows.column(f"g{k}")[0].as_py() for k in range(1, 5)]
            out = [(*cell, int(node[i]), int(node[j]), None, None, None, None) for i, j in group.links if node[i] != node[j]]
            if not cross and cell[1]:
                out.append((*cell, None, None, *group.summary()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = ["g1", "g2", "g3", "g4", "a", "b", "bits", "low", "high", "hidden"]
    kinds = [pa.binary() if n == "bits" else pa.int64() for n in names]
    return rows.mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'bits' else 'long'}" for n in names))


def linked_sets(pairs: DataFrame, docs: DataFrame, share: tuple[int, int], width: int, block: int, shingles: int) -> DataFrame:
    """(a, b): enough links to connect all linked sets of ``pairs`` (lead, node, n), each lead's group compared whole."""
    spark = docs.sparkSession
    num, den = share
    text = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).where(F.col("node").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    # sets of classes further apart than neighbours cannot link; classes are a little wider than the share asks for, for the sake of rounding
    classed = pairs.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.001 * den / num))).cast("long") + 1)
    sizes = classed.groupBy("lead", "class").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("total"))
    large = sizes.groupBy("lead").agg(F.sum("sets").alias("sets"), F.sum("total").alias("total")).where((F.col("sets") > block) | (F.col("total") > shingles)).select("lead")
    cells = sizes.join(large, "lead").select("lead", "class", F.greatest(F.ceil(F.col("sets") / block), F.ceil(F.col("total") / shingles)).cast("long").alias("salts"))
    placed = table(classed.join(cells, ["lead", "class"], "left").select(
        F.col("lead").alias("g1"), F.when(F.col("salts").isNotNull(), F.col("class")).otherwise(0).cast("long").alias("g2"),
        F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("node"), F.col("salts"))).otherwise(0).cast("long").alias("g3"), "node"))

    def meet(rows: DataFrame) -> DataFrame:
        # one way of joining at every size: which sets are candidates is never broadcast
        whole = rows.hint("merge").join(text, "node").select("g1", "g2", "g3", "g4", "side", "part", "node", "text")
        return whole.repartition(partitions(spark), "g1", "g2", "g3", "g4").sortWithinPartitions("g1", "g2", "g3", "g4", "side", "node", "text")

    inside = table(tree_links(meet(placed.withColumns({"g4": F.lit(0).cast("long"), "side": F.lit(0), "part": F.col("node")})), share, width, False))
    links = inside.where("a is not null").select("a", "b")
    cell = inside.where("a is null").select("g1", "g2", "g3", "bits", "low", "high", "hidden")
    if not cell.head(1):
        return links
    known = table(components(links))
    in_cells = table(placed.where("g2 > 0").join(known, "node", "left").select("g1", "g2", "g3", "node", F.coalesce("component", "node").alias("part")))
    state = cell.join(in_cells.groupBy("g1", "g2", "g3").agg(F.min("part").alias("p0"), F.max("part").alias("p1")), ["g1", "g2", "g3"])
    # a cell meets cells of its own and of the next class
    one = state.select("g1", F.explode(F.array("g2", F.col("g2") + 1)).alias("other"), *[F.col(c).alias(f"l_{c}") for c in ("g2", "g3", "bits", "low", "high", "hidden", "p0", "p1")])
    two = state.withColumnRenamed("g2", "other")
    open_pairs = one.join(two, ["g1", "other"]).where("(l_g2 < other or l_g3 < g3) and not (l_p0 = l_p1 and p0 = p1 and l_p0 = p0)")

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = [[batch.column(f"{s}{c}") for c in ("bits", "low", "high", "hidden")] for s in ("l_", "")]
            level = [Level(np.array([np.frombuffer(x, np.uint64) for x in b.to_pylist()], np.uint64).reshape(-1, CELL_WORDS), *(c.to_numpy() for c in rest)) for b, *rest in side]
            at = np.arange(batch.num_rows)
            keep = pa.array(may_link(level[0], at, level[1], at, share))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("g1", "l_g2", "l_g3", "other", "g3")], ["g1", "a2", "a3", "b2", "b3"]).filter(keep)

    met = table(open_pairs.select("g1", "l_g2", "l_g3", "other", "g3", *[f"{s}{c}" for s in ("l_", "") for c in ("bits", "low", "high", "hidden")])
                .mapInArrow(possible, "g1 long, a2 long, a3 long, b2 long, b3 long").withColumn("meeting", F.xxhash64("a2", "a3", "b2", "b3")))
    sides = [met.select("g1", F.col(f"{s}2").alias("g2"), F.col(f"{s}3").alias("g3"), "meeting", F.lit(k).alias("side")) for k, s in enumerate("ab")]
    rows = in_cells.join(sides[0].unionByName(sides[1]), ["g1", "g2", "g3"]).select("g1", F.col("meeting").alias("g2"), F.lit(0).cast("long").alias("g3"), F.lit(0).cast("long").alias("g4"), "side", "part", "node")
    return links.unionByName(tree_links(meet(rows), share, width, True).select("a", "b"))


def jaccard_components(docs: DataFrame, share: tuple[int, int] = SHARE, width: int = WIDTH, block: int = BLOCK, shingles: int = SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``: size of the text's set of ``width``-word shingles, and the smallest doc_id reachable
    over links, where den * |A and B| >= num * |A or B| for ``share`` = (num, den).

    A-Z count as lower case, words end at the six blanks of ASCII.  A text of fewer words is one shingle; null, empty and blank texts have an empty set and link with nothing.
    Rows that share a doc_id are in one component, whatever their texts; a null doc_id has a null component and links with nothing.  Other columns are ignored;
    an empty table gives no rows.  Shingles are told apart by 64-bit hashes, sets by 128 bits.
    """
    sketched = table(sketches(docs, share, width))
    known = sketched.where("doc_id is not null and n > 0")
    sets = table(known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys")))
    member = table(known.select("doc_id", "digest").distinct().join(sets.select("digest", "node"), "digest").select("doc_id", "node"))
    keyed = sets.select("node", "n", F.explode("keys").alias("key"))
    lead = keyed.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("top")).where("lead <> top").select("key", "lead")
    pairs = keyed.join(lead, "key").groupBy("lead", "node").agg(F.max("n").alias("n"))
    links = linked_sets(table(pairs), docs, share, width, block, shingles)
    # a doc_id with several texts joins their sets
    several = member.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    bridges = member.join(several, "doc_id", "left_semi").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    joined = components(links.unionByName(bridges))
    classes = member.join(joined, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("component"))
    return sketched.select("doc_id", F.col("n").alias("n_shingles")).join(classes, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
