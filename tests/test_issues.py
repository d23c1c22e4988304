"""Greedy one-to-one matching and the assignment of issues, against the plain walk over sorted pairs."""

import random
import re
from difflib import SequenceMatcher

import pytest

from tripline.operators.matching import greedy_matching
from tripline.plans.issues import assign_issues, score_pairs


def walk(pairs):
    """(group, left, right, score) in the order given by score, left, right."""
    left, right, out = set(), set(), []
    for g, a, b, s in sorted(pairs, key=lambda p: (-p[3], p[1], p[2])):
        if (g, a) not in left and (g, b) not in right:
            left.add((g, a))
            right.add((g, b))
            out.append((g, a, b, s))
    return sorted(out)


@pytest.mark.parametrize("levels", [3, 1000])
def test_greedy_matching_equals_the_walk(spark, levels):
    r = random.Random(levels)
    pairs = [("hot" if r.random() < 0.5 else f"g{r.randrange(6)}", r.randrange(25), r.randrange(20), float(r.randrange(levels))) for _ in range(700)]
    pairs += [("chain", i, i + j, float(100 - 2 * i - j)) for i in range(7) for j in (0, 1)]  # every pair waits for the one before
    df = spark.createDataFrame([*pairs, ("hot", 1, None, 5.0), ("hot", 2, 3, None)], "g string, a int, b int, score double")
    assert sorted(tuple(x) for x in greedy_matching(df, ["g", "a"], ["g", "b"], tie=["a", "b"]).collect()) == walk(pairs)
    assert greedy_matching(df.limit(0), ["g", "a"], ["g", "b"]).collect() == []


def plain(text):
    return re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).strip()


def tokens(text):
    return {t for t in plain(text).split() if len(t) > 2}


def plain_score(section, summary, description):
    heading = next((x.strip()[3:].strip() for x in (section or "").splitlines() if x.strip().startswith("## ")), "(untitled)")
    issue = plain(f"{summary or ''} {description or ''}")
    if not plain(heading) or not plain(section) or not issue:
        return 0.0
    mine = tokens(summary) or tokens(issue)
    share = [len(t & mine) / len(t) if t else 0.0 for t in (tokens(heading), tokens(section))]
    score = max(SequenceMatcher(None, plain(heading), issue).ratio(), SequenceMatcher(None, plain(section), issue).ratio(), *share)
    prefix = re.match(r"\[([^\]]+)\]", heading)
    if prefix and plain(prefix[1]) and plain(prefix[1]) in plain(summary):
        score = max(score, 0.45 + 0.35 * share[0] + 0.20 * share[1])
    return score


@pytest.mark.parametrize("tile", [256, 5])
def test_assignment_equals_the_plain_rule(spark, tile):
    r = random.Random(22)
    words = "camera reset upload failed modem lost gps fix power boot crash audio codec timeout retry sensor drift".split()
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    sections, issues = [], []
    for v, n, m in (("hot", 40, 60), ("1.2", 6, 4), ("only sections", 3, 0), ("only issues", 0, 3)):
        for i in range(n):
            head = r.choice((f"## [{r.choice(words)}] {text(3)}", f"  ## {text(4)}  ", "no heading", "## [!] ??"))
            sections.append((v, i, r.choice((f"intro\n{head}\r\n{text(r.randrange(40))}", head, "", None))))
        for i in range(m):
            issues.append((v, i, r.choice((f"K-{i}", f"K-{i // 2}", "")), r.choice((text(3), "", None)), r.choice((None, f'{{"body": "{text(r.randrange(60))}"}}'))))
    s = spark.createDataFrame([(*x, 1) for x in sections], "version string, section_no int, text string, score int")
    i = spark.createDataFrame(issues, "version string, issue_no int, issue_key string, summary string, description string")
    pairs = [(v, n, (k, j), plain_score(t, a, b)) for v, n, t in sections for w, k, j, a, b in issues if v == w and j]
    good = [p for p in pairs if p[3] >= 0.35]
    got = score_pairs(s, i, tile=tile).collect()
    assert sorted((x["version"], x["section_no"], x["issue_no"], x["score"]) for x in got) == sorted((v, n, k, z) for v, n, (k, _), z in good)
    left, right, want = set(), set(), {(v, n): None for v, n, _ in sections}
    for v, n, (k, j), z in sorted(good, key=lambda p: (-p[3], p[1], p[2][0])):
        if (v, n) not in left and (v, j) not in right:
            left.add((v, n))
            right.add((v, j))
            want[v, n] = j
    assert {(x["version"], x["section_no"]): x["issue_key"] for x in assign_issues(s, i, tile=tile).collect()} == want
