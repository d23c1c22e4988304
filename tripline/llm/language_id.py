"""Operator 7, language ID: word-first backoff.

Words are runs of letters of the lower-cased text.  A word that training has seen scores by its smoothed log frequency in each
language.  An unseen word (marked by a leading and a trailing boundary) scores by the mean over its longest character n-grams that
training has seen, falling back from ``longest`` letters to one.  A document's score per language is the sum over its words,
tempered by ``temper``; the softmax of the sums gives the score.

Counts of all words and all n-grams of the training part are Spark tables.  Tasks hold frequent words only to keep them out of
shuffles, in training's order and in that of the scored documents; every other distinct word of the scored documents is joined with the tables, once,
and its score goes back to the documents by a second join.  Frequent words never meet in one task of these joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripline.llm.text import blocks, drop, finished, free_name, per_doc, prefix_hash, span_hash, splitmix, table, tidy

#: Frequent words a task holds itself, of training and again of the scored documents: a matter of speed, not of results.
KNOWN_WORDS, LONGEST, TEMPER = 100_000, 4, 0.2
HELD = 500_000  # distinct words a task gathers before it passes them on; the rest is added up after the shuffle
EDGE = " "  # a word's boundary in its n-grams
RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
_TABLES: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if "letter" not in _TABLES:
        _TABLES["letter"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        _TABLES["value"] = splitmix(np.arange(0x110000, dtype=np.uint64))
    return _TABLES["letter"]


@dataclass
class Words:
    """Distinct words of some documents: hash, span in ``text``; ``which`` lists them in text order, ``first`` per document."""

    text: str
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    which: np.ndarray
    first: np.ndarray


def words_of(texts: list[str]) -> Words:
    letter = _letters()
    joined = "\n".join([t.lower() for t in texts]) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter[code]
    edge = np.flatnonzero(is_letter[1:] != is_letter[:-1]) + 1
    if is_letter[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    lengths = np.fromiter((len(t.lower()) for t in texts), np.int64, len(texts)) + 1
    first = np.searchsorted(start, np.concatenate(([0], np.cumsum(lengths))))
    hashes = splitmix(span_hash(prefix_hash(_TABLES["value"][code]), start, end) + (end - start).astype(np.uint64))
    which, unique = pd.factorize(hashes)
    at = np.zeros(len(unique), np.int64)
    at[which[::-1]] = np.arange(len(which))[::-1]
    return Words(joined, start[at], end[at], unique.astype(np.uint64), which, first)


def _string_blocks(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    for b in blocks(column):
        yield b.lo, b.hi, [t or "" for t in column.slice(b.lo, b.size).to_pylist()]


@dataclass
class Model:
    """``words`` (key, s) and ``grams`` (gram, g): all words and n-grams of training with their log frequency per language, as Spark
    tables; ``hashes`` (sorted) and ``word_log``: those of the words that tasks hold themselves."""

    langs: list[str]
    hashes: np.ndarray
    word_log: np.ndarray
    words: DataFrame | None = None
    grams: DataFrame | None = None
    longest: int = LONGEST


def _tally(labelled: bool, skip: np.ndarray):
    """Distinct words (hash not in ``skip``, sorted) of the texts of a task with how often they occur, per language if ``labelled``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            which, unique = pd.factorize(np.concatenate([p[0] for p in parts]))
            at = np.zeros(len(unique), np.int64)
            at[which] = np.arange(len(which))
            return unique.astype(np.uint64), np.concatenate([p[1] for p in parts])[at], np.bincount(which, np.concatenate([p[2] for p in parts])).astype(np.int64)

        def rows(lang: str, keys: np.ndarray, word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(word, pa.string()), pa.array(n)], ["lang", "key", "word", "n"])

        for batch in batches:
            langs = np.array(batch.column(1).to_pylist() if labelled else [""] * batch.num_rows, dtype=object)
            for lo, hi, texts in _string_blocks(batch.column(0)):
                for lang in sorted(set(langs[lo:hi])):
                    w = words_of([t for t, x in zip(texts, langs[lo:hi], strict=True) if x == lang])
                    pick = np.flatnonzero(_place(skip, w.hashes) < 0)
                    word = np.empty(len(pick), object)
                    word[:] = [w.text[a:b] for a, b in zip(w.start[pick].tolist(), w.end[pick].tolist(), strict=True)]
                    held.setdefault(lang, []).append((w.hashes[pick], word, np.bincount(w.which, minlength=len(w.hashes))[pick]))
                    if len(held[lang]) >= 16:
                        held[lang] = [merged(held[lang])]
                        if len(held[lang][0][0]) > HELD:
                            yield rows(lang, *held.pop(lang)[0])
        for lang, parts in held.items():
            yield rows(lang, *merged(parts))

    return run


def _place(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each of ``wanted`` is in the sorted ``hashes`` (-1: nowhere)."""
    if not len(hashes):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    return np.where(hashes[at] == wanted, at, -1)


def grams_of(word: Column, n: int) -> Column:
    """The ``n``-grams of a word between its boundaries, repeated ones as often as they occur."""
    marked = F.concat(F.lit(EDGE), word, F.lit(EDGE))
    last = F.char_length(word) + 3 - n
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(marked, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _frequent(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and ``s`` of the words (key, s, n) of largest ``n``, at most ``most``, whole classes of like ``n`` only."""
    sizes = {r.b: r.w for r in words.groupBy(F.floor(F.log2("n") * 4).alias("b")).agg(F.count(F.lit(1)).alias("w")).collect()}
    least, taken = None, 0
    for b in sorted(sizes, reverse=True):
        taken += sizes[b]
        if taken > most:
            break
        least = b
    got = words.where(F.floor(F.log2("n") * 4) >= least).select("key", "s").toPandas() if least is not None else pd.DataFrame({"key": []})
    if not len(got):
        return np.zeros(0, np.uint64), np.zeros((0, 0), np.float32)
    key = got["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], np.stack(got["s"].to_list()).astype(np.float32)[order]


def _sums(n: int, column: str) -> Column:
    return F.array(*(F.sum(F.col(column)[i]).alias(f"s{i}") for i in range(n)))


def _logs(counts: str, sums: list[int], distinct: int) -> Column:
    return F.array(*(F.log((F.col(counts)[i] + F.lit(0.5)) / F.lit(x + 0.5 * distinct)).cast("float") for i, x in enumerate(sums)))


def train(docs: DataFrame, known_words: int = KNOWN_WORDS, longest: int = LONGEST) -> Model:
    """``docs`` (text, lang): count words and n-grams per language over every row with a language.

    ``known_words`` is how many frequent words tasks hold themselves; it changes no result.
    """
    counts = table(docs.where("lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
                   .mapInArrow(tidy(_tally(True, np.zeros(0, np.uint64))), "lang string, key long, word string, n long").groupBy("key", "lang").agg(F.min("word").alias("word"), F.sum("n").alias("n")))
    size = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(size)
    if not langs:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), longest=longest)
    each = F.array(*(F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)) for x in langs))
    words = table(counts.groupBy("key").agg(F.min("word").alias("word"), each.alias("c"), F.sum("n").alias("n")))
    drop(counts)  # languages and words are summed up in ``size`` and ``words``
    words_scored = words.select("key", _logs("c", [size[x] for x in langs], words.count()).alias("s"), "n")
    # n-grams are cut from distinct words, so even the most common one has few rows a word
    cut = words.select("c", F.explode(F.concat(*(grams_of(F.col("word"), n) for n in range(1, longest + 1)))).alias("gram"))
    gram_counts = table(cut.groupBy("gram").agg(_sums(len(langs), "c").alias("c")))
    totals = {r.n: (r.c, r.d) for r in gram_counts.groupBy(F.char_length("gram").alias("n")).agg(_sums(len(langs), "c").alias("c"), F.count(F.lit(1)).alias("d")).collect()}
    by_order = F.lit(None).cast("array<float>")
    for n, (c, d) in totals.items():
        by_order = F.when(F.char_length("gram") == n, _logs("c", c, d)).otherwise(by_order)
    return Model(langs, *_frequent(words_scored, known_words), words_scored.select("key", "s"), gram_counts.select("gram", by_order.alias("g")), longest)


def word_scores(words: Words, model: Model) -> np.ndarray:
    """Log frequencies of each distinct word per language; NaN for words that tasks do not hold."""
    out = np.full((len(words.hashes), len(model.langs)), np.nan, np.float32)
    at = _place(model.hashes, words.hashes)
    out[at >= 0] = model.word_log[at[at >= 0]]
    return out


def score_words(words: DataFrame, model: Model) -> DataFrame:
    """(key, n, s) of distinct ``words`` (key, word, n): the log frequencies of the word, or of its longest n-grams, per language."""
    joined = words.join(model.words, "key", "left")
    cut = joined.where("s is null").select("key", "n", F.explode(F.concat(*(grams_of(F.col("word"), k) for k in range(1, model.longest + 1)))).alias("gram"))
    means = F.array(*(F.avg(F.col("g")[i]).cast("float") for i in range(len(model.langs))))
    unseen = (cut.join(model.grams, "gram").groupBy("key", "n", F.char_length("gram").alias("longest")).agg(means.alias("s"))
              .groupBy("key", "n").agg(F.max_by("s", "longest").alias("s")))
    return joined.where("s is not null").select("key", "n", "s").unionByName(unseen)


def _predicted(docs: DataFrame, model: Model, temper: float) -> DataFrame:
    """Per row of ``docs`` (text and others): the others, predicted language and probability."""
    others = [c for c in docs.columns if c != "text"]
    if not model.langs:
        return docs.select(*others, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    k = len(model.langs)
    found = (docs.select("text").mapInArrow(tidy(_tally(False, model.hashes)), "lang string, key long, word string, n long")
             .groupBy("key").agg(F.min("word").alias("word"), F.sum("n").alias("n")))
    scored = table(score_words(found, model))
    hashes, log = _frequent(scored, KNOWN_WORDS)
    if len(hashes):
        every, at = np.concatenate((model.hashes, hashes)), np.argsort(np.concatenate((model.hashes, hashes)))
        hashes, log = every[at], np.concatenate((model.word_log.reshape(-1, k), log))[at]
    else:
        hashes, log = model.hashes, model.word_log.reshape(-1, k)
    # tables of Spark stay out of the tasks
    held = replace(model, hashes=hashes, word_log=log, words=None, grams=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in _string_blocks(batch.column(batch.num_columns - 1)):
                w = words_of(texts)
                each = word_scores(w, held)
                away = np.isnan(each[:, 0]) if k else np.zeros(len(each), bool)
                each[away] = 0
                sums = np.stack([per_doc(each[:, i][w.which], w.first) for i in range(k)], axis=1)
                # words to be joined: (document, word) pairs and how often they occur
                at = np.flatnonzero(away[w.which])
                doc = np.searchsorted(w.first, at, side="right") - 1
                pair, times = np.unique(np.stack((doc, w.which[at]), axis=1), axis=0, return_counts=True) if len(at) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
                cut = pa.array(np.searchsorted(pair[:, 0], np.arange(hi - lo + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)), pa.array(np.diff(w.first).astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * k), pa.array(sums.ravel())),
                     pa.ListArray.from_arrays(cut, pa.array(w.hashes[pair[:, 1]].view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(times.astype(np.int32)))],
                    [*batch.schema.names[:-1], "_n", "_sums", "_keys", "_times"])

    shape = T.StructType([*docs.select(*others).schema.fields, T.StructField("_row", T.LongType()), T.StructField("_n", T.LongType()), T.StructField("_sums", T.ArrayType(T.DoubleType())),
                          T.StructField("_keys", T.ArrayType(T.LongType())), T.StructField("_times", T.ArrayType(T.IntegerType()))])
    base = table(docs.select(*others, F.monotonically_increasing_id().alias("_row"), "text").mapInArrow(tidy(run), shape))  # written, so that row numbers stay
    more = (base.select("_row", F.explode(F.arrays_zip("_keys", "_times")).alias("w")).select("_row", F.col("w._keys").alias("key"), F.col("w._times").alias("t"))
            .join(scored.select("key", "s"), "key").groupBy("_row").agg(*(F.sum(F.col("s")[i].cast("double") * F.col("t")).alias(f"_m{i}") for i in range(k))))
    total = F.array(*(F.col("_sums")[i] + F.coalesce(F.col(f"_m{i}"), F.lit(0.0)) for i in range(k)))
    best = F.array_max("_total")
    name = F.element_at(F.array(*map(F.lit, model.langs)), F.array_position("_total", best).cast("int"))
    mass = F.aggregate("_total", F.lit(0.0), lambda s, x: s + F.exp((x - best) * temper))
    return (base.join(more, "_row", "left").withColumn("_total", total)
            .select(*others, F.when(F.col("_n") > 0, name).otherwise("und").alias("lang_pred"), F.when(F.col("_n") > 0, 1 / mass).otherwise(0.0).alias("score")))


def language_id(docs: DataFrame, model: Model, held_out: str = "false", temper: float = TEMPER) -> DataFrame:
    """One row per row of ``docs``: predicted language and score; ``held_out`` is an SQL condition carried along.

    Null text, text without a letter and an empty model give ``und`` with score 0; equal scores go to the language first in
    alphabet; repeated rows are predicted one by one; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return _predicted(rows, model, temper).select(*RESULT.names)


def keep_known(docs: DataFrame, trained: Callable[[], Model], least: float = 0.5, temper: float = TEMPER) -> DataFrame:
    """The rows of ``docs`` with a predicted language of at least probability ``least``, all columns; the model's tables go with the decision.

    Equal texts are kept or dropped alike; null, empty and letterless texts are dropped.  Columns of any name are kept as they are.
    """
    digest, key = F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))), free_name(docs, "_digest")
    rows = docs.select(digest.alias(key), F.col("text").cast("string").alias("text"))
    gone = finished(lambda: _predicted(rows, trained(), temper).where((F.col("lang_pred") == "und") | (F.col("score") < least)).select(key).distinct())
    return docs.withColumn(key, digest).join(gone, key, "left_anti").select(docs.columns)
