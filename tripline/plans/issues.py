"""Issues of a version assigned to the sections of its report (JOI-22)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripline.operators.matching import greedy_matching
from tripline.session import settle

#: Least score of a match, and of a shared heading prefix with what the tokens add to it.  Fixed values.
THRESHOLD = 0.35
#: Scores down to which pairs are taken before the next worse ones are looked at.
BANDS = (1.0, 0.8, 0.6)
PREFIX_SCORE, HEADING_WEIGHT, SECTION_WEIGHT = 0.45, 0.35, 0.20

_LINE = "\r\n|[\n\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def plain(col: Column | str) -> Column:
    """Lower-case letters and digits with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))), "[^a-z0-9]+", " "))


def section_heading(col: Column | str) -> Column:
    """Text of the first line that begins with ``## ``."""
    lines = F.transform(F.split(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")), _LINE), lambda x: F.btrim(x, F.lit(" \t")))
    return F.coalesce(F.btrim(F.substr(F.get(F.filter(lines, lambda x: F.startswith(x, F.lit("## "))), F.lit(0)), F.lit(4)), F.lit(" \t")), F.lit("(untitled)"))


def _tokens(text: str) -> set[str]:
    return {t for t in text.split() if len(t) > 2}


def _letters(texts: Sequence[str]) -> np.ndarray:
    """How often each byte occurs in each text."""
    return np.array([np.bincount(np.frombuffer(t.encode("ascii"), np.uint8), minlength=128) for t in texts], np.int32).reshape(len(texts), 128)


class _Index:
    """For token sets of one side: how many tokens of another set each of them holds."""

    def __init__(self, sets: Sequence[set[str]]):
        self.n, found = len(sets), defaultdict(list)
        for i, tokens in enumerate(sets):
            for t in tokens:
                found[t].append(i)
        self.at = {t: np.array(i) for t, i in found.items()}

    def share(self, tokens: set[str]) -> np.ndarray:
        count = np.zeros(self.n)
        for t in tokens:
            if t in self.at:
                count[self.at[t]] += 1
        return count / len(tokens) if tokens else count


def score_tile(sections: pd.DataFrame, issues: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Pairs of a tile that reach the threshold, with exact scores.

    Token overlaps come from an inverted index.  The sequence ratio of two texts is at most twice the letters they share over
    their lengths; it is computed only where that bound reaches the threshold and passes the score known so far.
    """
    summaries, texts = issues["a"].tolist(), issues["b"].tolist()
    index = _Index([_tokens(s) or _tokens(t) for s, t in zip(summaries, texts, strict=True)])
    letters, lengths = _letters(texts), np.array([len(t) for t in texts])
    out, todo = [], []
    for n, (heading, text, prefix) in enumerate(zip(sections["a"], sections["b"], sections["c"], strict=True)):
        of_heading, of_section = index.share(_tokens(heading)), index.share(_tokens(text))
        score = np.maximum(of_heading, of_section)
        if prefix:
            has = np.array([prefix in s for s in summaries])
            score = np.where(has, np.maximum(score, PREFIX_SCORE + HEADING_WEIGHT * of_heading + SECTION_WEIGHT * of_section), score)
        out.append(score)
        for part in {heading, text}:
            bound = 2.0 * np.minimum(letters, _letters([part])).sum(axis=1) / (lengths + len(part))
            todo += [(int(i), n, part) for i in np.flatnonzero((bound >= threshold) & (bound > score))]
    scores = np.array(out)
    matcher = SequenceMatcher(None)
    last = -1
    for i, n, part in sorted(todo):
        if i != last:
            matcher.set_seq2(texts[i])  # what it learns of the second text serves all sections
            last = i
        matcher.set_seq1(part)
        scores[n, i] = max(scores[n, i], matcher.ratio())
    n, i = np.nonzero(scores >= threshold)
    keys = pd.Series([issues["key"].iloc[k] for k in i], dtype="object")
    return pd.DataFrame({"section_no": sections["no"].to_numpy()[n], "issue_no": issues["no"].to_numpy()[i], "issue_key": keys, "score": scores[n, i]})


def score_pairs(sections: DataFrame, issues: DataFrame, by: Sequence[str] = ("version",), threshold: float = THRESHOLD, tile: int = 256) -> DataFrame:
    """JOI-22: (by, section_no, issue_no, issue_key, score) of the pairs of one group whose score reaches the threshold.

    ``sections``: by, section_no, text; ``issues``: by, issue_no, issue_key, summary, description.  The score is the greatest of the
    sequence ratios of heading and section with the issue's text and of the shares of their tokens in the issue's summary; where the
    summary holds the heading's ``[prefix]``, the prefix score counts too.  A group is cut into tiles, so a version with very many sections and
    issues is spread over tasks of ``tile`` x ``tile`` texts.  Empty texts and issues without a key match nothing.
    """
    by = list(by)
    heading = section_heading("text")
    left = sections.select(*by, F.col("section_no").cast("long").alias("no"), F.lit(None).cast("string").alias("key"), plain(heading).alias("a"), plain("text").alias("b"),
                           plain(F.regexp_extract(heading, r"^\[([^\]]+)\]", 1)).alias("c")).filter("a != '' and b != ''")
    text = plain(F.concat(F.coalesce("summary", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))))
    right = issues.select(*by, F.col("issue_no").cast("long").alias("no"), F.col("issue_key").cast("string").alias("key"), plain("summary").alias("a"), text.alias("b"),
                          F.lit("").alias("c")).filter("key != '' and b != ''")
    sizes = [df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias(n)) for df, n in ((left, "__i"), (right, "__j"))]
    tiles = sizes[0].join(sizes[1], by)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("no", "b"), F.col(n)).cast("int")
    cells = (left.join(tiles, by).withColumns({"__side": F.lit(0), "__ti": own("__i")}).withColumn("__tj", every("__j"))
             .unionByName(right.join(tiles, by).withColumns({"__side": F.lit(1), "__tj": own("__j")}).withColumn("__ti", every("__i"))))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["__side"].to_numpy()
        if not (side == 0).any() or not (side == 1).any():
            return pd.DataFrame([], columns=[*by, "section_no", "issue_no", "issue_key", "score"], dtype="object")
        found = score_tile(pdf[side == 0], pdf[side == 1], threshold)
        for c in reversed(by):
            found.insert(0, c, pdf[c].iloc[0])
        return found

    kinds = T.StructType([*[sections.schema[c] for c in by], T.StructField("section_no", T.LongType()), T.StructField("issue_no", T.LongType()), T.StructField("issue_key", T.StringType()),
                          T.StructField("score", T.DoubleType())])
    return cells.groupBy(*by, "__ti", "__tj").applyInPandas(score, kinds)


def assign_issues(sections: DataFrame, issues: DataFrame, by: Sequence[str] = ("version",), threshold: float = THRESHOLD, tile: int = 256) -> DataFrame:
    """JOI-22: every section with the issue assigned to it (null: none) and the score.

    Pairs are taken from the best score down, ties by section and issue number; sections and issue keys are used once per group.  Pairs of
    a band of scores come before all worse ones, so bands are worked from the top: each sees only the sections and issues that are left, and the bound of
    a ratio is held against the band's end.
    """
    by = list(by)
    left, right = settle(sections.select(*by, "section_no", "text")), settle(issues.select(*by, "issue_no", "issue_key", "summary", "description"))
    taken = None
    for least in [*[b for b in BANDS if b > threshold], threshold]:
        now = settle(greedy_matching(score_pairs(left, right, by, least, tile), [*by, "section_no"], [*by, "issue_key"], tie=["section_no", "issue_no"])
                     .select(*by, "section_no", "issue_key", "score"))
        taken = now if taken is None else taken.unionByName(now)
        if least > threshold:
            used = now.select(*by, "section_no"), now.select(*by, "issue_key")
            left, right = settle(left.join(used[0], [*by, "section_no"], "left_anti")), settle(right.join(used[1], [*by, "issue_key"], "left_anti"))
            if left.isEmpty() or right.isEmpty():
                break
    return sections.select(*by, F.col("section_no").cast("long").alias("section_no")).join(taken.select(*by, "section_no", "issue_key", "score"), [*by, "section_no"], "left")
