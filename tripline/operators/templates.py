"""Many texts against many templates: a trie over the templates' literal pieces, walked once per text."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = "<N>"
_LINE_ENDS = "\n\r\x85\u2028\u2029"


class TemplateTrie:
    """Templates as paths of literal pieces, with a wildcard of at least one character between two of them.

    Nodes are shared by templates that begin alike.  Taking the earliest place for each piece leaves the most room for the rest, so
    one walk per node decides whether a text goes on there.  First and last pieces are looked up by length, not tried one by one.
    """

    def __init__(self, templates: Iterable[tuple[str, int, str]]):
        """``templates``: (pattern, rank, type)."""
        self.exact: dict[str, tuple[int, str]] = {}
        self.root: dict = {"next": {}}
        for pattern, rank, kind in templates:
            pieces = pattern.split(MASK)
            if len(pieces) == 1:
                self._keep(self.exact, pattern, (rank, kind))
                continue
            node = self.root
            for piece in pieces[:-1]:
                node = node["next"].setdefault(piece, {"next": {}, "last": {}})
            self._keep(node["last"], pieces[-1], (rank, kind))
        self.heads = sorted({len(p) for p in self.root["next"]})
        self._measure(self.root)

    @staticmethod
    def _keep(table: dict, key: str, found: tuple[int, str]) -> None:
        table[key] = min(found, table.get(key, found))

    def _measure(self, root: dict) -> None:
        nodes = [root]
        while nodes:
            node = nodes.pop()
            node["tails"] = sorted({len(p) for p in node.get("last", ())})
            nodes += node["next"].values()

    def first(self, text: str) -> tuple[int, str] | None:
        """(rank, type) of the first template that matches the whole text; one line end after it does not count."""
        best = self._first(text)
        cut = text[:-2] if text.endswith("\r\n") else text[:-1] if text and text[-1] in _LINE_ENDS else None
        if cut is not None:
            best = min((x for x in (best, self._first(cut)) if x), default=None)
        return best

    def _first(self, text: str) -> tuple[int, str] | None:
        best = self.exact.get(text)
        stack = []
        for n in self.heads:
            if n > len(text):
                break
            node = self.root["next"].get(text[:n])
            if node:
                stack.append((node, n))
        while stack:
            node, at = stack.pop()
            for n in node["tails"]:
                if n > len(text) - at - 1:
                    break
                found = node["last"].get(text[len(text) - n :])
                if found and (best is None or found < best):
                    best = found
            for piece, below in node["next"].items():
                place = text.find(piece, at + 1)
                if place >= 0:
                    stack.append((below, place + len(piece)))
        return best


def _keys(c: str) -> dict[str, Column]:
    """Literal words a template shares with every text it matches: the whole, the first two words, the first, the last."""
    word = r"[^\s<>]+"
    take = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return {"two": take(rf"^({word}\s{word})\s"), "head": take(rf"^({word})\s"), "tail": take(rf"\s({word})$")}


def match_templates(texts: DataFrame, templates: DataFrame, text: str, most_templates: int = 2_000, most_texts: int = 50_000) -> DataFrame:
    """(text, rank, type) of the first template, by ``rank``, each distinct text matches.

    ``templates``: rank, type, description_pattern; equal ranks go to the smaller type.  A template meets texts that share its key: its first word, or its first
    two where more than ``most_templates`` begin with that word, or else its last word, or no word.  The templates and the texts of one key are cut
    further, so a group of a task has at most about ``most_templates`` templates, in one trie, and ``most_texts`` texts.
    """
    keys = _keys("description_pattern")
    rows = templates.select(F.col("rank").cast("bigint").alias("rank"), "type", "description_pattern").filter("rank is not null and type is not null and description_pattern is not null")
    rows = rows.groupBy("description_pattern").agg(F.min(F.struct("rank", "type")).alias("r")).select("description_pattern", "r.*")
    label = lambda mark, c: F.concat(F.lit(mark), c)
    exact = ~F.contains("description_pattern", F.lit(MASK))
    first = F.coalesce(F.when(exact, label("e", F.col("description_pattern"))), label("h", keys["head"]), label("t", keys["tail"]), F.lit("-"))
    rows = rows.withColumns({"k1": first, "k2": label("2", keys["two"])})
    hot = rows.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > most_templates) & F.col("k1").startswith("h")).select("k1", F.lit(True).alias("hot"))
    rows = rows.join(hot, "k1", "left").withColumn("key", F.when(F.col("hot") & F.col("k2").isNotNull(), F.col("k2")).otherwise(F.col("k1"))).drop("k1", "k2", "hot")
    parts = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / most_templates).cast("int").alias("parts"))

    once = texts.select(F.col(text).alias("text")).filter(F.col("text").isNotNull()).distinct()
    # a text's own words: whatever stands where a template has its literal ones
    take = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    bare = F.regexp_replace("text", "(?:\r\n|[\n\r\\x85\\u2028\\u2029])\\z", "")
    own = F.array_distinct(F.array_compact(F.array(label("e", F.col("text")), label("e", bare), label("2", take(r"^(\S+\s\S+)\s")), label("h", take(r"^(\S+)\s")), label("t", take(r"\s(\S+)$")),
                                                   label("t", F.nullif(F.regexp_extract(bare, r"\s(\S+)$", 1), F.lit(""))), F.lit("-"))))
    keyed = once.select("text", F.explode(own).alias("key")).join(parts, "key")
    salts = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / most_texts).cast("int").alias("salts"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (rows.join(parts, "key").join(salts, "key").withColumn("part", F.pmod(F.xxhash64("description_pattern"), F.col("parts")).cast("int")).withColumn("salt", every("salts"))
            .select("key", "part", "salt", "description_pattern", "rank", "type"))
    right = keyed.join(salts, "key").withColumn("salt", F.pmod(F.xxhash64("text"), F.col("salts")).cast("int")).withColumn("part", every("parts")).select("key", "part", "salt", "text")

    def walk(patterns: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        trie = TemplateTrie(patterns[["description_pattern", "rank", "type"]].itertuples(index=False, name=None))
        got = [(t, *m) for t in found["text"] if (m := trie.first(t))]
        return pd.DataFrame(got, columns=["text", "rank", "type"])

    by = ["key", "part", "salt"]
    hits = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(walk, "text string, rank bigint, type string")
    return hits.groupBy("text").agg(F.min(F.struct("rank", "type")).alias("r")).select("text", "r.*")
