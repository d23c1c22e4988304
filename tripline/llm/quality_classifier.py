"""Operator 3, quality classifier: supervised subword embeddings.

Features are hashed words and hashed character n-grams (3 and 4 code points) of the whole text with a boundary newline at both ends.  A document is the average of its features'
vectors; a softmax layer over two classes sits on top; both are learned by plain stochastic gradient descent in numpy.
Because the layer is linear, the two-class logit is an average of one number per feature, so scoring gathers
one float per feature from a table of 2^``BITS`` numbers.

Training reads at most ``SAMPLE_DOCS`` labelled rows (those of smallest hash of the id), in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripline.llm.text import Block, blocks, fixed_sample

BITS, DIM, EPOCHS, RATE, SAMPLE_DOCS = 17, 8, 6, 0.5, 2000
THRESHOLD = 0.7
RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


@dataclass
class Model:
    """Logit of label 1 against label 0 per feature, and without any feature."""

    table: np.ndarray
    bias: float


def characters(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number per character of UTF-8 bytes, made of its bytes, and where it begins."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    size = np.diff(np.append(at, len(buf)))
    code = buf[at].astype(np.uint64)
    for k in (1, 2, 3):
        long = np.flatnonzero(size > k)
        code[long] |= buf[at[long] + k].astype(np.uint64) << np.uint64(8 * k)
    return code, at


def features(block: Block, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of feature ids and, per document, the first of them (one more than documents)."""
    code, at = characters(np.concatenate((np.array([10], np.uint8), block.buf)))  # a newline before the first text
    out = []
    start, end = np.searchsorted(at, block.start), np.searchsorted(at, block.end + 2)  # characters, with both newlines
    for n in (3, 4):
        if len(code) < n:
            out.append((np.zeros(0, np.uint32), np.zeros(block.size + 1, np.int64)))
            continue
        x = np.full(len(code) - n + 1, n, np.uint64)
        for k in range(n):
            x = (x ^ code[k : len(code) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
        ids = (x >> np.uint64(64 - bits)).astype(np.uint32)
        # windows that reach into the next text are left out
        inside = np.ones(len(ids), bool)
        for k in range(1, n - 1):
            at = end - 1 - k
            at = at[(at >= start) & (at < len(ids))]
            inside[at] = False
        count = np.concatenate(([0], np.cumsum(inside)))
        out.append((ids[inside], count[np.minimum(np.append(start, len(ids)), len(ids))]))
    h = block.word_hashes()
    out.append(((h >> np.uint64(64 - bits)).astype(np.uint32), block.words()[2]))
    return out


def score_block(block: Block, model: Model, bits: int = BITS) -> np.ndarray:
    total, n = np.zeros(block.size), np.zeros(block.size)
    for ids, first in features(block, bits):
        sums = np.concatenate(([0.0], np.cumsum(model.table[ids], dtype=np.float64)))
        total += sums[first[1:]] - sums[first[:-1]]
        n += np.diff(first)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + model.bias, -500, 500)))


def sgd(ids: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Stochastic gradient descent, one document per step; both classes weigh the same; deterministic."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(1 << bits, np.float32), 2.0 if len(labels) and labels[0] else -2.0)
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    weight = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean())
    steps, done = epochs * len(ids), 0
    for _ in range(epochs):
        for i in rng.permutation(len(ids)):
            lr = rate * (1 - done / steps)
            done += 1
            share = (counts[i] / counts[i].sum()).astype(np.float32)
            mean = share @ vectors[ids[i]]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= lr * weight[i]
            back = out @ p
            out -= np.outer(mean, p)
            bias -= p
            # the step of a feature follows its share of the text; scaled so that long and short texts learn alike
            vectors[ids[i]] -= np.outer(share * len(share) ** 0.5, back)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, learn: str = "true", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from at most ``sample_docs`` labelled rows that satisfy the SQL condition ``learn`` on doc_id."""
    sample = fixed_sample(labels.where("doc_id is not null and quality is not null").where(learn).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y")), sample_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = [], []
            for block in blocks(batch.column(1)):
                parts = features(block)
                for i in range(block.size):
                    u, c = np.unique(np.concatenate([p[0][p[1][i] : p[1][i + 1]] for p in parts]), return_counts=True)
                    ids.append(u.astype(np.uint32).tobytes())
                    counts.append(c.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "y", "ids", "counts"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: (r[0], r[2]))
        rows = [r for r in rows if len(r[2])]
        model = sgd([np.frombuffer(r[2], np.uint32) for r in rows], [np.frombuffer(r[3], np.uint32) for r in rows], np.array([r[1] for r in rows], int))
        yield pa.RecordBatch.from_arrays([pa.array([model.table.tobytes()], pa.binary()), pa.array([model.bias])], ["table", "bias"])

    got = rows.mapInArrow(gather, "doc_id long, y int, ids binary, counts binary").repartition(1).mapInArrow(fit, "table binary, bias double").collect()
    return Model(np.frombuffer(got[0].table, np.float32), got[0].bias) if got else sgd([], [], np.zeros(0, int))


def quality_scores(docs: DataFrame, model: Model, held_out: str = "false", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: the probability of label 1.

    Null and empty text have the features of two newlines' boundary (none of length 3), so they get the model's prior.  Repeated
    rows are scored one by one; other columns are ignored; no rows give no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [score_block(b, model) for b in blocks(batch.column(2))]
            if parts:
                s = np.concatenate(parts)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], RESULT.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)
