"""Templates against texts, compared with regular expressions tried in order."""

import random
import re

import pytest

from tripline.operators.templates import TemplateTrie
from tripline.plans.classify import match_patterns


def first_by_regex(templates, text):
    best = None
    for pattern, rank, kind in templates:
        rx = "(?s)" + re.escape(pattern).replace(re.escape("<N>"), ".+?") + r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"
        if text is not None and re.match(rx, text):
            best = min((rank, kind), best or (rank, kind))
    return best


def make(r, n, words):
    out = []
    for i in range(n):
        parts = [r.choice([*words, "<N>", "<N>", "a<N>b", "x.(y", "<N><N>"]) for _ in range(r.randrange(1, 6))]
        out.append((r.choice((" ", " ", "")).join(parts), r.randrange(40), f"T{r.randrange(5)}"))
    return [*out, ("<N>", 90, "ANY"), ("", 3, "EMPTY"), ("ERROR: <N>", 50, "HEAD"), ("ERROR: disk <N>", 45, "DISK"), ("only this", 1, "EXACT")]


def texts_of(r, templates, n, words):
    out = [None, "", "\n", "x", "only this", "only this\n", "ERROR: ", "ERROR: 1", "ERROR: disk \n", "\u00e9 \U0001f600 z"]
    for _ in range(n):
        pattern = r.choice(templates)[0]
        while "<N>" in pattern:
            pattern = pattern.replace("<N>", r.choice(["1", "7 8", "", "a", r.choice(words), "\n"]), 1)
        out.append(pattern + r.choice(["", "", "\n", " ", "\r\n", "q"]))
    return out


WORDS = ["ERROR:", "disk", "full", "on", "net", "up"]


@pytest.mark.parametrize("seed", range(6))
def test_trie_against_regular_expressions(seed):
    r = random.Random(seed)
    templates = make(r, 60, WORDS)
    trie = TemplateTrie(templates)
    for text in texts_of(r, templates, 300, WORDS):
        if text is not None:
            assert trie.first(text) == first_by_regex(templates, text), text


@pytest.mark.parametrize("most", [2_000, 3])
def test_match_patterns_splits_hot_words(spark, most):
    r = random.Random(most)
    templates = make(r, 80, WORDS)
    templates = sorted({p: (p, k, t) for p, k, t in templates}.values())
    texts = texts_of(r, templates, 400, WORDS)
    pats = spark.createDataFrame([(k, t, p) for p, k, t in templates] + [(None, "X", "<N>"), (1, None, "<N>")], "rank int, type string, description_pattern string")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, description string").repartition(4)
    got = {x["id"]: x["matched_type"] for x in match_patterns(df, pats, most_patterns=most, most_texts=most * 4).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = first_by_regex(templates, t)
        assert got[i] == (want and want[1]), t
    assert match_patterns(df, pats.limit(0)).filter("matched_type is not null").count() == 0
