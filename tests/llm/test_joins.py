"""Brute force and odd rows for the Jaccard join, the prefix trie and hard negatives."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tripline.llm import hard_negatives, jaccard_join, prefix_trie
from tripline.llm.queries import QUERIES
from tripline.llm.text import blocks, prepare

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# operator 11


def shingles(text, width=3):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if d is not None and e is not None and a and b and 100 * len(a & b) >= 90 * len(a | b):
                x, y = sorted((root(d), root(e)))
                parent[y] = x
    return sorted(((d, len(s), None if d is None else root(d)) for d, s in sets), key=str)


def edited(r, base, n):
    out = list(base)
    for _ in range(n):
        out[r.randrange(len(out))] = f"z{r.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def family(spark):
    """Families of edited copies around the threshold, of very different sizes, in one group and many."""
    r = random.Random(11)
    rows, n = [], 0
    for size in (4, 11, 12, 25, 60, 160, 400, 1500):
        for _ in range(3):
            base = [f"w{r.randrange(4000)}" for _ in range(size)]
            for _ in range(14):
                rows.append((n, edited(r, base, r.choice((0, 1, 1, 2, size // 60, size // 40))) + r.choice(("", "", " tail", " ONE two THREE"))))
                n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One"), (n + 4, "one"), (n + 5, "ONE two"), (n + 6, "two one"), (None, rows[0][1]), (5, rows[5][1]), (5, "another text for the same id, not alike at all"),
             (n + 7, "another text for the same id, not alike at all"), (6, ""), (n + 8, "É é É é ünï " * 9), (n + 9, "a" * 30_000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [4096, 6])
def test_jaccard_components_against_all_pairs(spark, family, block):
    docs = prepare(spark).createDataFrame([(d, t, "x", 1) for d, t in family], "doc_id long, text string, node string, component long").repartition(5)
    got = jaccard_join.jaccard_components(docs, block=block)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute_components(family)


def test_jaccard_of_an_empty_table(spark):
    assert jaccard_join.jaccard_components(prepare(spark).createDataFrame([], "doc_id long, text string")).collect() == []


def test_linked_sets_share_a_bucket():
    r = np.random.default_rng(5)
    for _ in range(400):
        n = int(r.choice([9, 10, 11, 13, 14, 20, 33, 34, 60, 118, 119, 300, 900]))
        a = r.integers(0, 1 << 63, n, dtype=np.uint64)
        b = a
        while True:
            c = np.delete(b, r.integers(0, len(b))) if r.random() < 0.5 else np.append(b, r.integers(0, 1 << 63, 1, dtype=np.uint64))
            if 100 * len(np.intersect1d(a, c)) < 90 * len(np.union1d(a, c)):
                break
            b = c
        keys = []
        for x in (np.sort(a), np.sort(b)):
            keys.append(set(jaccard_join.bucket_keys(np.zeros(len(x), np.int64), x, np.array([len(x)]), (90, 100))[1].tolist()))
        assert keys[0] & keys[1] or np.array_equal(np.sort(a), np.sort(b))


def test_few_filled_segments_share_a_bucket():
    # all members in one segment: the shared segments are empty ones
    a = np.arange(20, dtype=np.uint64)
    keys = [set(jaccard_join.bucket_keys(np.zeros(n, np.int64), a[:n], np.array([n]), (90, 100))[1].tolist()) for n in (20, 19, 18)]
    assert keys[0] & keys[1] and keys[0] & keys[2]


def test_dual_traversal_links_like_all_pairs():
    r = random.Random(2)
    base = [f"w{r.randrange(300)}" for _ in range(200)]
    texts = [edited(r, base, r.randrange(5)) for _ in range(150)] + [edited(r, base[:90], r.randrange(3)) for _ in range(60)]
    group = jaccard_join.Group(pa.array(texts, pa.large_string()), np.arange(len(texts)), (90, 100), 3)
    group.walk(np.arange(group.n))
    want = {}
    for d, _, c in brute_components(list(enumerate(texts))):
        want[d] = c
    assert [min(np.flatnonzero(group.part == p)) for p in group.part] == [want[i] for i in range(len(texts))]


# operator 12


def brute_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(x[2], x[3]) for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(donor, [])[:h] + v[h:]
    nodes = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids = defaultdict(int)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(members) - 1) * (len(WORD.findall(p[-1][1])) if p else 0)
    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def talks():
    r = random.Random(12)
    rows = []
    for c in [*range(45), 60, 61, 8000, 8001, -3, -25, 10**15]:
        for t in range(r.choice((1, 1, 2, 3, 5, 9))):
            rows.append((c, t, r.choice(("user", "assistant", None)), r.choice(("", None, "hi", "hello there", "a b\tc\nd", "ünï code"))))
    rows += [(70, i, "user", f"turn {i % 3}") for i in range(90)] + [(79, i, "user", f"turn {i % 3}") for i in range(70)]
    rows += [(100, None, "user", "first"), (100, 3, "b", "x"), (100, 3, "a", "x"), (100, 3, "a", "x"), (100, None, None, None), (None, 1, "user", "lost"), (119, 2500, "u", "far"), (119, -2500, "u", "near")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("height", [2, 16])
def test_trie_against_brute_force(spark, talks, height):
    df = prepare(spark).createDataFrame([(*x, 1, "y") for x in talks], "conv_id long, turn long, role string, text string, depth int, node string").repartition(5)
    got = prefix_trie.rebuilt_trie(df, height)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute_trie(talks)


def test_trie_query_and_empty_table(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{D}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(x) for x in QUERIES["op12_prefix_trie"](spark, D).collect()), key=str) == brute_trie(rows)
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_digest_of_many_members_over_chunks(spark):
    ids = [*range(-40, 60, 3), 10**12]
    got = prefix_trie.digests(spark.createDataFrame([(7, 0, c) for c in ids], "node long, depth long, conv long"), chunk_bits=3).collect()
    assert [tuple(x) for x in got] == [(7, 0, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]


# operator 13


def brute_negatives(rows, modulus):
    import math

    width = max((len(v) for _, _, v in rows if v), default=0)
    kept = set()
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * x) for x in v)
        if sum(x * x for x in q) < 2**61:
            kept.add((i, label, q))
    out = []
    for a, label, q in sorted(kept):
        if a % modulus:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(q, p)), i, m) for i, m, p in kept))
        for s, i, _ in [x for x in scored if x[2] == label and x[1] != a][:5]:
            fit = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(fit)]
    assert width >= 0
    return sorted(out)


SCHEMA = "id long, label long, vector array<double>, key string, score int"


@pytest.mark.parametrize(("tile", "part"), [(1 << 16, 1 << 18), (3, 17)])
def test_hard_negatives_against_brute_force(spark, tile, part):
    r = random.Random(13)
    rows = [(i, r.randrange(3), [r.uniform(-1, 1) + (0.8 if k == 0 else 0) for k in range(6)]) for i in range(160)]
    rows += [(200 + i, i % 3, [0.5] * 6) for i in range(30)] + [(300, 1, [0.5] * 6), (300, 1, [0.5] * 6), (300, 1, [0.9] * 6), (310, 1, [0.2]), (320, 2, []), (330, 0, [0.0] * 6), (340, None, [0.1] * 6), (None, 1, [0.1] * 6),
             (350, 1, None), (360, 1, [0.1, None]), (370, 1, [float("nan")]), (380, 1, [float("inf")]), (390, 1, [1e300] * 6), (400, 0, [70_000.0, -3e6]), (410, 1, [65_000.0, -2.5e6]), (420, 1, [30_000.0, -1.7e6]), (430, 0, [60_000.0, -2.9e6])]
    df = prepare(spark).createDataFrame([(*x, "k", 1) for x in rows], SCHEMA).repartition(4)
    got = hard_negatives.hard_negatives(df, "id % 10 = 0", tile=tile, part=part)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(x) for x in got.collect()) == brute_negatives(rows, 10)


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.hard_negatives(prepare(spark).createDataFrame([], SCHEMA), "id % 10 = 0").collect() == []


def test_residues_give_exact_products():
    r = np.random.default_rng(1)
    for width, most in ((1, 1), (64, 256), (64, 1 << 28), (3000, 1 << 24), (2, 1 << 30)):
        a, b = r.integers(-most, most, (7, width)), r.integers(-most, most, (9, width))
        a[0], b[0] = most - 1, -most
        bound = max(int((x.astype(object) ** 2).sum(axis=1).max()) for x in (a, b))
        primes = hard_negatives.primes_for(width, bound)
        assert hard_negatives.EXACT >= min(width, hard_negatives.CHUNK) * (max(primes) // 2) ** 2
        got = hard_negatives.exact_scores(hard_negatives.residues(a, primes), hard_negatives.residues(b, primes), primes)
        assert (got == (a.astype(object) @ b.astype(object).T)).all()


def test_best_keeps_ties_by_column():
    s = np.array([[5, 7, 7, 7, 1], [2, 2, 2, 2, 2], [9, 8, 7, 6, 5]])
    ok = np.array([[True] * 5, [False, True, True, True, True], [False] * 5])
    i, j = hard_negatives.best(s, ok, 2)
    assert list(zip(i.tolist(), j.tolist())) == [(0, 1), (0, 2), (1, 1), (1, 2)]
