"""Operator 9, quality rules: a linear-chain CRF marks each line content or boilerplate; the content share decides.

Lines are the \\n-split lines that hold a word.  Each has a few 0/1 features (symbols, bars, capitals, word
lengths, repeats).  The model's weights are trained by maximum likelihood (forward-backward, Adam) on the lines of at most
``sample_docs`` labelled documents, whose label stands for all their lines.  Viterbi decoding runs over
all documents of a block at once, one line number per step.  Everything happens in one scan: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripline.llm.text import SPACE, Block, blocks, duplicated, fixed_sample, per_doc, span_hash, splitmix, tidy

SYMBOLS = b"[#*$%&|<>]"[1:-1]
#: Labelled documents the CRF is trained on, lines of one training sequence (longer texts give several), and sequences of one document.
SAMPLE_DOCS, SEQUENCE, SAMPLE_PARTS = 2000, 64, 4
#: A document is kept when at least this share of its words stands in lines marked content.
CONTENT_SHARE = 0.5

RESULT = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                       T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("content_share", T.DoubleType())])

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(SYMBOLS)] = 1
_KINDS = {"bar": b"|", "bang": b"!", "digit": b"0123456789", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "stop": b".,;:?", "odd": b"@/\\_=+{}~^"}
N_FEATURES = 26


@dataclass
class Measures:
    """Per document: counts.  Per line with a word: features, words, and the first line of each document."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    features: np.ndarray
    line_words: np.ndarray
    first: np.ndarray


def measure(block: Block) -> Measures:
    buf = block.buf
    ends = np.append(block.start, len(buf))
    w_start, w_end, w_first = block.words()
    space = SPACE[buf]
    symbols = _SYMBOL[buf]
    code_points = ((buf & 0xC0) != 0x80) & ~space
    # lines that hold a word
    l_start, l_end, l_first = block.lines()
    w_of_line = np.append(np.searchsorted(w_start, l_start), len(w_start))
    words = np.diff(w_of_line)
    has = words > 0
    doc_of_line = np.repeat(np.arange(block.size), np.diff(l_first))[has]
    l_start, l_end, n = l_start[has], l_end[has], words[has]
    first = np.searchsorted(doc_of_line, np.arange(block.size + 1))
    again = duplicated(doc_of_line, span_hash(block.prefix(), l_start, l_end) + (l_end - l_start).astype(np.uint64), "first")
    # words inside repeated five-word windows
    at, doc, hashes = block.shingles()
    twice = at[duplicated(doc, hashes, False)]
    step = np.zeros(len(w_start) + 6, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + 5, -1)
    repeat = (np.cumsum(step)[: len(w_start)] > 0).astype(np.int64)
    w_hash = block.word_hashes()
    same = np.zeros(len(w_start), np.int64)
    same[1:] = w_hash[1:] == w_hash[:-1]
    in_line = lambda v: per_doc(v, np.append(w_of_line[:-1][has], len(w_start))) if has.any() else np.zeros(0)
    edges = np.append(l_start, len(buf))

    def share(kind: str, of: np.ndarray) -> np.ndarray:
        is_kind = np.zeros(256, np.uint8)
        is_kind[list(_KINDS[kind])] = 1
        return per_doc(is_kind[buf], edges) / np.maximum(of, 1)

    chars = per_doc(code_points, edges)
    sym = per_doc(symbols, edges) / np.maximum(chars, 1)
    upper, lower = share("upper", chars), share("lower", chars)
    mean = chars / np.maximum(n, 1)
    rep, eq = in_line(repeat) / np.maximum(n, 1), in_line(same) / np.maximum(n, 1)
    bar, bang, digit, odd, stop = share("bar", n), share("bang", n), share("digit", chars), share("odd", chars), share("stop", n)
    f = np.stack([np.ones(len(n)), sym > 0, sym > 0.03, sym > 0.1, sym > 0.25, bar > 0.05, bar > 0.3, bang > 0.1, bang > 0.5, upper > 0.3, upper > 0.7, lower < 0.3,
                  n < 3, n < 8, n > 60, mean < 3, mean > 9, mean > 14, again, rep > 0.1, rep > 0.4, eq > 0.1, eq > 0.4, digit > 0.15, odd > 0.05, stop < 0.01], axis=1).astype(np.float32)
    return Measures(np.diff(w_first), per_doc(code_points, ends), per_doc(symbols, ends), np.bincount(doc_of_line[again], minlength=block.size),
                    per_doc(repeat, w_first), f, n, first)


@dataclass
class Crf:
    """Scores: ``emit`` per feature and label (0 boilerplate, 1 content), ``step`` from label to label."""

    emit: np.ndarray
    step: np.ndarray


def viterbi(model: Crf, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best label of each line; sequences are lines first[i] .. first[i + 1]."""
    score = features @ model.emit
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    base, length = first[:-1][order], length[order]
    label = np.zeros(len(features), np.int8)
    most = int(length[0]) if len(length) else 0
    back = np.zeros((len(features), 2), np.int8)
    best = np.zeros((len(order), 2))
    active = np.searchsorted(-length, -np.arange(1, most + 1), side="right")
    for t in range(most):
        k = active[t]
        at = base[:k] + t
        if t:
            via = best[:k, :, None] + model.step[None]
            back[at] = via.argmax(axis=1)
            best[:k] = via.max(axis=1) + score[at]
        else:
            best[:k] = score[at]
    here = best.argmax(axis=1).astype(np.int8)
    for t in range(most - 1, -1, -1):
        k = active[t]
        at = base[:k] + t
        label[at] = here[:k]
        if t:
            here[:k] = back[at, here[:k]]
    return label


def train_crf(features: list[np.ndarray], labels: list[int], rounds: int = 60) -> Crf:
    """Maximum likelihood by forward-backward and Adam; deterministic.  Without both labels everything is content."""
    emit, step = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    if len(set(labels)) < 2:
        emit[0, 1] = 1.0
        return Crf(emit, step)
    order = sorted(range(len(features)), key=lambda i: (-len(features[i]), i))
    x = np.concatenate([features[i] for i in order]).astype(np.float64)
    length = np.array([len(features[i]) for i in order])
    y = np.array([labels[i] for i in order])
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    base = np.cumsum(length) - length
    most = int(length[0])
    active = np.searchsorted(-length, -np.arange(1, most + 1), side="right")
    seq = np.repeat(np.arange(len(order)), length)
    theta, m, v = np.zeros(emit.size + 4), 0.0, 0.0
    norm = lambda a: a.max(axis=1) + np.log(np.exp(a - a.max(axis=1, keepdims=True)).sum(axis=1))
    for r in range(1, rounds + 1):
        emit, step = theta[:-4].reshape(emit.shape), theta[-4:].reshape(2, 2)
        score = x @ emit
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        for t in range(most):
            at = base[: active[t]] + t
            alpha[at] = score[at] if not t else score[at] + np.stack([norm(alpha[at - 1] + step[:, b]) for b in (0, 1)], axis=1)
        pair, seen = np.zeros((2, 2)), np.zeros((2, 2))
        z = norm(alpha[base + length - 1])
        for t in range(most - 1, 0, -1):
            k = active[t]
            at = base[:k] + t
            onward = score[at] + beta[at]
            beta[at - 1] = np.stack([norm(onward + step[a]) for a in (0, 1)], axis=1)
            p = np.exp(alpha[at - 1][:, :, None] + step[None] + onward[:, None, :] - z[:k, None, None])
            pair += (p * weight[:k, None, None]).sum(axis=0)
            for a in (0, 1):
                seen[a, a] += (weight[:k] * (y[:k] == a)).sum()
        p = np.exp(alpha + beta - z[seq][:, None])
        gold = np.zeros_like(p)
        gold[np.arange(len(p)), y[seq]] = 1
        g = np.concatenate(((x.T @ ((gold - p) * weight[seq][:, None])).ravel(), (seen - pair).ravel())) / len(x) - 1e-3 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.2 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Crf(theta[:-4].reshape(emit.shape), theta[-4:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_parts: int = SAMPLE_PARTS) -> Crf:
    """Train on at most ``sample_docs`` documents with a quality label; the sample is bounded, so it is broadcast.

    Of a sampled document at most ``sample_parts`` sequences of ``SEQUENCE`` lines are learnt, those of smallest hash, so every
    document keeps its share however long others are.  Of texts that share a doc_id the smallest counts; null texts, ids and labels do not.
    """
    sample = fixed_sample(labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y")), sample_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            ids, ys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for block in blocks(batch.column(1)):
                m = measure(block)
                for i in range(block.size):
                    starts = list(range(int(m.first[i]), int(m.first[i + 1]), SEQUENCE))
                    drawn = np.sort(np.argsort(splitmix(np.arange(len(starts), dtype=np.uint64)), kind="stable")[:sample_parts])
                    for part, at in ((int(k), starts[k]) for k in drawn):
                        out[0].append(ids[block.lo + i])
                        out[1].append(part)
                        out[2].append(ys[block.lo + i])
                        out[3].append(m.features[at : min(at + SEQUENCE, int(m.first[i + 1]))].astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], ["doc_id", "part", "y", "f"])

    got = rows.mapInArrow(tidy(sequences), "doc_id long, part int, y int, f binary").collect()
    got = sorted(got, key=lambda r: (r.doc_id, r.part, r.f))
    return train_crf([np.frombuffer(r.f, np.uint8).reshape(-1, N_FEATURES) for r in got], [r.y for r in got])


def judge(block: Block, model: Crf, share: float = CONTENT_SHARE) -> dict[str, np.ndarray]:
    """All result columns of a block's documents but the id."""
    m = measure(block)
    content = viterbi(model, m.features, m.first)
    got = per_doc(content * m.line_words, m.first) / np.maximum(m.n_words, 1)
    failed = (m.n_words < 10) | (100 * m.n_repeat_words > 20 * m.n_words)
    return {"n_words": m.n_words, "word_chars": m.word_chars, "n_symbols": m.n_symbols, "n_dup_lines": m.n_dup_lines, "n_repeat_words": m.n_repeat_words,
            "base_failed": failed, "kept": ~failed & (got >= share), "content_share": got}


def quality_rules(docs: DataFrame, model: Crf, share: float = CONTENT_SHARE) -> DataFrame:
    """One row per row of ``docs``: counts, the base rule and the CRF's verdict.

    Null text counts as empty: no words, so the base rule fails.  A null doc_id stays null; repeated rows are judged one by
    one; other columns are ignored, whatever their names; no rows give no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [judge(b, model, share) for b in blocks(batch.column(1))]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate([p[n] for p in parts])) for n in RESULT.names[1:])], RESULT.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), RESULT)


def keep_good(docs: DataFrame, model: Crf, share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, all columns, in the same scan."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [judge(b, model, share)["kept"] for b in blocks(batch.column(at))]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts)))

    return docs.mapInArrow(tidy(run), docs.schema)
