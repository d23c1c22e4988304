"""Operator 8, MinHash near-dedup: ProbMinHash of weighted five-word shingles, banding, verification.

A shingle's weight is how often it occurs in the text; similarity is the probability Jaccard index of the weights, which is
the plain Jaccard index where no shingle repeats.  Each shingle is a Poisson process whose arrivals come at a rate of its weight and
hit random registers; a register keeps its first arrival, and a shingle stops once its next arrival is later than every
register's first.  Two texts agree in a register with a probability of their similarity.

Equal texts are one node from the start.  Nodes that agree in a band of registers are joined to the smallest node of the band, so a
bucket of any size gives one link per member.  The components of these links hold all candidates of a node; their texts are read
once more, and inside a component pairs are compared by registers, then exactly.  A component of more than ``BLOCK`` nodes is
split into blocks, every two of which meet in a task of their own.  Only links that join two groups leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.llm.components import components
from tripline.llm.text import Block, blocks, finished, partitions, splitmix, table, tidy

WIDTH, SIMILARITY, BANDS, ROWS, BLOCK = 5, 0.8, 32, 6, 4096
#: Registers' agreement may fall this far below the similarity before a pair is dropped unverified: at a
#: similarity of 0.8 and 192 registers a pair is lost here with a probability of 4e-7, by the bands with 6e-5.
SLACK = 0.15


def weighted(block: Block, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a block: document, hash, weight, sorted by document and hash.  A text of fewer words is one shingle."""
    _, doc, h = block.shingles(width)
    first = block.words()[2]
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        words = block.word_hashes()
        one = np.array([splitmix(np.array([np.bitwise_xor.reduce(splitmix(words[first[i] : first[i + 1]] + np.arange(n[i], dtype=np.uint64)))], np.uint64))[0] for i in short], np.uint64)
        doc, h = np.concatenate((doc, short)), np.concatenate((h, one))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def prob_minhash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """The shingle that arrives first at each register, per document; 0 where a document has no shingle."""
    arrival = np.full(n_docs * registers, np.inf)
    winner = np.zeros(n_docs * registers, np.uint64)
    doc, seed = doc.astype(np.int64), h.copy()
    rate = 1.0 / weight
    at = np.zeros(len(h))
    while len(h):
        seed = splitmix(seed)
        at = at - np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * rate
        last = arrival.reshape(n_docs, registers).max(axis=1)
        live = at < last[doc]  # early termination
        doc, h, seed, rate, at = doc[live], h[live], seed[live], rate[live], at[live]
        to = doc * registers + ((splitmix(seed ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(arrival, to, at)
        first = arrival[to] == at
        winner[to[first]] = h[first]
    return winner.reshape(n_docs, registers)


def band_keys(winner: np.ndarray, bands: int, rows: int) -> np.ndarray:
    total = np.zeros((len(winner), bands), np.uint64)
    by = winner.reshape(len(winner), bands, rows)
    for k in range(rows):
        total = splitmix(total * np.uint64(31) + by[:, :, k])
    return splitmix(total + np.arange(bands, dtype=np.uint64))


def band_rows(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """(doc_id, digest, bands): the text's digest and a key per band; texts without words have no band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list = []
            for block in blocks(batch.column(2)):
                doc, h, weight = weighted(block, width)
                key = band_keys(prob_minhash(doc, h, weight, block.size, bands * rows), bands, rows).view(np.int64)
                has = np.bincount(doc, minlength=block.size) > 0
                keys += [k.tolist() if y else [] for k, y in zip(key, has, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "digest", "bands"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("digest"), text.alias("text")).mapInArrow(tidy(run), "doc_id long, digest string, bands array<long>")


def exact_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets (sorted hashes, weights): the chance that one exponential race has one winner in both."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = a[1][ia].astype(float), b[1][ib].astype(float)
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    ratio = y / x
    # sum over d' of max(x_d'/x_d, y_d'/y_d): x counts where the ratio is at most d's, y where it is greater
    upto = np.searchsorted(ratio, ratio, side="right")
    cx, cy = np.concatenate(([0], np.cumsum(x))), np.concatenate(([0], np.cumsum(y)))
    return float((1 / ((only_a + cx[upto]) / x + (only_b + cy[-1] - cy[upto]) / y)).sum())


class _Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i


def links_in(texts: list[bytes | str], similarity: float, bands: int, rows: int, width: int, split: int | None = None) -> list[tuple[int, int]]:
    """Links that join groups of similar texts.  With ``split``, only pairs of one before and one from there on are compared."""
    registers = bands * rows
    ids, weights, sketches, offset = [], [], [], 0
    sizes: list[np.ndarray] = []
    for block in blocks(pa.array(texts, pa.large_string())):
        doc, h, weight = weighted(block, width)
        sketches.append((prob_minhash(doc, h, weight, block.size, registers) & np.uint64(0xFF)).astype(np.uint8))
        ids.append(h)
        weights.append(weight)
        sizes.append(np.bincount(doc, minlength=block.size))
        offset += block.size
    sketch, size, weight = np.concatenate(sketches), np.concatenate(sizes), np.concatenate(weights)
    h = np.concatenate(ids)
    at = np.concatenate(([0], np.cumsum(size)))
    code, unique = pd.factorize(h)
    plain = np.array([(weight[a:b] == 1).all() for a, b in zip(at, at[1:], strict=False)])
    forest = _Forest(len(texts))
    root = np.arange(len(texts))
    mark = np.zeros(len(unique), bool)
    out = []
    least = registers * (similarity - SLACK)
    for i in range(1, len(texts)):
        if split is not None and i < split:
            continue
        others = np.arange(i if split is None else split)
        agree = np.concatenate([(sketch[lo : min(lo + 2048, len(others))] == sketch[i]).sum(axis=1) for lo in range(0, len(others), 2048)])
        near = others[(agree >= least) & (size[others] > 0) & (size[i] > 0)]
        if not len(near):
            continue
        near = near[root[near] != root[i]]
        if len(near) and plain[i]:
            easy = near[plain[near]]
            mark[code[at[i] : at[i + 1]]] = True
            n = size[easy]
            where = np.repeat(at[easy], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            common = np.bincount(np.repeat(np.arange(len(easy)), n), mark[code[where]], minlength=len(easy))
            mark[code[at[i] : at[i + 1]]] = False
            good = easy[common >= similarity * (n + size[i] - common) - 1e-9]
            hard = near[~plain[near]]
        else:
            good, hard = near[:0], near
        for j in [*good.tolist(), *hard.tolist()]:
            a, b = forest.root(j), forest.root(i)
            if a == b:
                continue
            if j in hard and exact_similarity((h[at[i] : at[i + 1]], weight[at[i] : at[i + 1]]), (h[at[j] : at[j + 1]], weight[at[j] : at[j + 1]])) < similarity - 1e-9:
                continue
            forest.parent[max(a, b)] = min(a, b)
            root[root == max(a, b)] = min(a, b)
            out.append((j, i))
    return out


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first ``n_keys`` columns, from batches sorted by them; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = list(zip(*(batch.column(k).to_pylist() for k in range(n_keys)), strict=True))
        at = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
        for a, b in zip(at, at[1:], strict=False):
            if last is not None and key[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key[a]
    if held:
        yield pa.Table.from_batches(held)


def verified_links(candidates: DataFrame, docs: DataFrame, similarity: float, bands: int, rows: int, width: int, block: int) -> DataFrame:
    """(a, b): links inside the components ``candidates`` (node, component)."""
    spark = docs.sparkSession
    size = candidates.groupBy("component").agg(F.count(F.lit(1)).alias("n")).select("component", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    split = candidates.join(size, "component").withColumn("own", own)
    # a row goes to every pair of blocks it belongs to
    pairs = (split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node"))
    text = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("node"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # one way of joining at every size: which documents are candidates is never broadcast
    rows_in = pairs.hint("merge").join(text, "node").select("component", "i", "j", "own", "node", "text").repartition(partitions(spark), "component", "i", "j").sortWithinPartitions("component", "i", "j", "own", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 3):
            first, second = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            own = group.column("own").to_numpy()
            nodes = group.column("node").to_numpy()
            cut = int((own == first).sum()) if first != second else None
            found = links_in(group.column("text").to_pylist(), similarity, bands, rows, width, cut)
            yield pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in found], pa.int64()), pa.array([nodes[y] for _, y in found], pa.int64())], ["a", "b"])

    return rows_in.mapInArrow(tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id), one row per row of ``docs``: the smallest doc_id that equal texts and links connect with the row's.

    Null text counts as empty; texts without words are alike only if they are equal.  Texts of fewer than ``width`` words are one shingle.
    Rows that share a doc_id are in one class; a null doc_id has a null class.  Other columns are ignored; an empty table gives no rows.
    """
    sketched = table(band_rows(docs, bands, rows, width))
    known = sketched.where("doc_id is not null")
    reps = known.groupBy("digest").agg(F.min("doc_id").alias("node"))
    member = table(known.select("doc_id", "digest").distinct().join(reps, "digest").select("doc_id", "node"))
    band = known.join(reps.select("digest", F.col("node").alias("doc_id")), ["digest", "doc_id"]).select(F.col("doc_id").alias("node"), F.explode("bands").alias("key"))
    lead = band.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("top")).where("lead <> top").select("key", "lead")
    stars = band.join(lead, "key").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    candidates = table(components(stars))
    links = table(verified_links(candidates, docs, similarity, bands, rows, width, block))
    # a doc_id with several texts joins their nodes
    joined = components(links.unionByName(member.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).join(member.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("a")), "a", "left_semi")))
    classes = member.join(joined, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("class_id"))
    return sketched.select("doc_id").join(classes, "doc_id", "left")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its class, all columns.

    Of rows that repeat that id all stay; a row without id is in no class and stays.  An empty table gives no rows.
    """
    gone = finished(lambda: near_duplicates(docs, similarity).where("doc_id <> class_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
