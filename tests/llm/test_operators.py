"""Brute force, round trips, held-out accuracy and odd rows for the operators of tripline.llm."""

import base64
import hashlib
import math
import random
import re
import struct
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tripline.llm import ann, language_id, near_dedup, packing, quality_classifier, quality_rules, sampling, suffix_dedup, suffixes, text, token_output, warc
from tripline.llm.text import blocks, prepare
from tripline.llm.tokens import encoder

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, kept string, node long"
WORDS = "the cat sat on a mat and the dog ran over this old red barn by some river near our town".split()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, long, repeated and clashing columns."""
    r = random.Random(3)
    passage = " ".join(r.choice(WORDS) for _ in range(40))
    long = " ".join(r.choice(WORDS) + str(r.randrange(1000)) for _ in range(30_000))
    texts = [(1, passage), (2, "x " + passage), (3, None), (4, ""), (5, " \n\t "), (6, long), (7, passage), (7, passage), (8, "ünï 日本 \U0001f600"), (9, "a" * 5000), (10, "### $$$ ||| !!\n" * 30), (None, passage), (11, "y\n" + passage[:49])]
    return prepare(spark).createDataFrame([(d, t, "en", None, None, "x", "y", 0) for d, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return prepare(spark).createDataFrame([], SCHEMA)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda x: tuple((v is None, v) for v in x))


def test_suffix_array_and_prefixes_against_sorting():
    r = np.random.default_rng(0)
    for _ in range(150):
        t = np.append(r.integers(1, r.integers(2, 6), r.integers(1, 80)), 0)
        plain = t.tolist()
        sa = suffixes.suffix_array(t)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: plain[i:])
        shared = suffixes.common_prefixes(t, sa, np.array([0]), np.array([len(t)]), 50)
        for i in range(1, len(t)):
            a, b = plain[sa[i] :], plain[sa[i - 1] :]
            assert shared[sa[i]] == min(50, next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))


def brute_dedup(docs, length=50):
    seen, out = {}, {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            key = b[i : i + length]
            seen[key] = min(seen.get(key, d), d)
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        out[d] = (len(b), bytes(c for c, g in zip(b, gone) if not g), len(re.findall(b"\1+", bytes(gone))))
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_suffix_dedup_against_brute_force(spark, odd, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    docs = [((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.text) for r in odd.collect()]
    want = brute_dedup(docs)
    got = suffix_dedup.suffix_dedup(odd).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_bytes, bytes(r.kept), len(r.span_start)) == want[(1 << 63) - 1 if r.doc_id is None else r.doc_id]


@pytest.mark.parametrize("length", [17, 18, 50, 51])
def test_pieces_that_share_no_side_of_an_anchor_are_not_sorted_and_lots_stay_small(monkeypatch, length):
    r = random.Random(length)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    phrases = [" ".join(word() for _ in range(r.randint(3, 25))) for _ in range(60)]
    texts = [" ".join(r.choice(phrases) if r.random() < 0.3 else word() for _ in range(r.randint(1, 120))).encode() for _ in range(200)]
    data = b"".join(texts)
    chunk = suffix_dedup.unpack(np.arange(200, dtype="<i8").tobytes(), np.array([len(t) for t in texts], "<i8").tobytes(), len(data), pa.compress(data, "zstd", asbytes=True))
    p = suffix_dedup.cut(chunk, length)
    size = p.windows + length - 1
    order, at = suffix_dedup._groups(suffix_dedup.text_hash(chunk.buf, p.start, size))
    pick = order[at]
    least = np.minimum.reduceat(chunk.doc[p.doc[order]], at)
    for i in pick:  # the anchor lies in all windows of its piece
        assert p.windows[i] - 1 <= p.at[i] <= length - suffix_dedup.GRAM
    want, _ = suffix_dedup.solve(chunk.buf, p.start[pick], size[pick], least, length)
    sorted_ = []
    solve = suffix_dedup.solve
    monkeypatch.setattr(suffix_dedup, "solve", lambda texts, start, size, *rest: sorted_.append(int(size.sum())) or solve(texts, start, size, *rest))
    monkeypatch.setattr(suffix_dedup, "LOT_BYTES", 4000)
    piece, first, last, low = suffix_dedup.covered(chunk.buf, p.start[pick], size[pick], p.at[pick], least, length)
    assert np.array_equal(np.repeat(low, last - first + 1), want)
    assert np.array_equal(np.bincount(piece, last - first + 1), p.windows[pick])
    one = suffix_dedup.covered(chunk.buf, p.start[:1], size[:1], p.at[:1], np.array([7]), length)
    assert [x.tolist() for x in one] == [[0], [0], [p.windows[0] - 1], [7]]
    assert 10 * max(sorted_) < sum(sorted_) < 0.9 * size[pick].sum()


def peak_of(work):
    """MB allocated at most while ``work`` runs."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_tasks_of_the_pipeline_hold_little_beside_their_texts(monkeypatch):
    r = random.Random(5)
    texts = [" ".join(r.choice(WORDS) + str(r.randrange(1000)) for _ in range(300)).encode() for _ in range(2000)]
    data = b"".join(texts)
    chunk = suffix_dedup.unpack(np.arange(2000, dtype="<i8").tobytes(), np.array([len(t) for t in texts], "<i8").tobytes(), len(data), pa.compress(data, "zstd", asbytes=True))
    assert 3.5 < len(data) / 1e6 < 5
    monkeypatch.setattr(text, "_POWERS", {})
    assert peak_of(lambda: suffix_dedup.anchors_of(chunk, 50)) < 75
    assert peak_of(lambda: near_dedup.links_in(texts[:1], 0.8, 32, 6, 5)) < 20
    shared = np.sort(suffix_dedup.anchors_of(chunk, 50)[0])
    pieces, key = suffix_dedup.selected(chunk, shared, shared[:0], 50)
    one = np.zeros(1, np.int64)
    runs = (key[:1], one, one, one - 1)
    assert peak_of(lambda: suffix_dedup.mark(chunk, pieces, key, runs, 50)) < 45
    assert peak_of(lambda: near_dedup.links_in(texts, 0.8, 32, 6, 5)) < 150
    assert sum(p.nbytes for p in text._POWERS.values()) < 20e6  # a worker keeps them


def test_pieces_begin_and_end_in_their_documents():
    texts = [b"", b"x" * 49, b"", b"abc" * 30, b"y" * 50, b""] * 3
    for length in (17, 50, 51):
        chunk = suffix_dedup.unpack(np.arange(len(texts), dtype="<i8").tobytes(), np.array([len(t) for t in texts], "<i8").tobytes(), sum(map(len, texts)), pa.compress(b"".join(texts), "zstd", asbytes=True))
        p = suffix_dedup.cut(chunk, length)
        windows = np.concatenate([np.arange(a, a + n) for a, n in zip(p.start, p.windows, strict=True)])
        want = [i for a, b in zip(chunk.start, chunk.end, strict=True) for i in range(a, b - length + 1)]
        assert windows.tolist() == want
        assert (chunk.end[p.doc] - p.start >= p.windows + length - 1).all()


def test_suffix_dedup_of_the_documents(spark, empty):
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    docs = spark.read.parquet(f"{D}/documents.parquet")
    want = brute_dedup([(r.doc_id, r.text) for r in docs.collect()])
    for r in suffix_dedup.suffix_dedup(docs).collect():
        assert (r.n_bytes, bytes(r.kept), len(r.span_start)) == want[r.doc_id]


def test_tokens_equal_the_library():
    r = random.Random(1)
    letters = "ab'srtmdlve 12  \n\n\t.,!é ½²_-'\u0085\x1c\x00ß　日"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    e = encoder()
    for a, b in zip(e.encode(texts), e.whole(texts)):
        assert np.array_equal(a, b)


def test_huffman_codes_and_files():
    counts = {i: 2 ** (i // 2) for i in range(60)}
    lengths = token_output.code_lengths(counts)
    assert max(lengths.values()) <= 16 and sum(2.0**-n for n in lengths.values()) == 1
    assert token_output.code_lengths({5: 9}) == {5: 1} and token_output.code_lengths({}) == {}
    free = token_output.code_lengths({i: c for i, c in enumerate((5, 9, 12, 13, 16, 45))})
    assert sum(c * free[i] for i, c in enumerate((5, 9, 12, 13, 16, 45))) == 224  # Huffman's optimum
    r = np.random.default_rng(0)
    codes = token_output.canonical(lengths)
    docs = [(None, np.zeros(0, np.uint16)), *((i, r.integers(0, 60, r.integers(0, 300)).astype(np.uint16)) for i in range(40))]
    data = token_output.write_file(docs, codes, 64)
    ids, n, flat = token_output.read_file(data, codes)
    assert ids == [d for d, _ in docs] and np.array_equal(flat, np.concatenate([x for _, x in docs])) and n.tolist() == [len(x) for _, x in docs]
    assert np.array_equal(token_output.read_file(data, codes, range(3, 5))[2], flat[3 * 64 : 5 * 64])  # a block alone


def test_token_files_round_trip(spark, odd, empty):
    got = token_output.read_tokens(token_output.write_tokens(odd, file_ids=5000)).collect()
    want = sorted(((r.doc_id, [*encoder().encode([r.text])[0].tolist(), 2]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(((r.start, r.doc_id, np.frombuffer(r.ids, "<u2").tolist()) for r in got))
    assert [(d, x) for _, d, x in got] == want
    assert [s for s, _, _ in got] == [sum(len(x) for _, x in want[:i]) for i in range(len(want))]
    assert token_output.read_tokens(token_output.write_tokens(empty)).count() == 0
    # another program has the folders only
    spark, written = odd.sparkSession, token_output.write_tokens(odd, file_ids=5000)
    again = token_output.TokenFiles(*(spark.read.parquet(t._folder) for t in (written.files, written.lengths)))
    assert sorted(map(str, token_output.read_tokens(again).collect())) == sorted(map(str, token_output.read_tokens(written).collect()))


def test_packing(spark, odd, empty):
    pieces, placed = packing.pack(odd)
    got = placed.collect()
    assert len(got) == pieces.count()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    whole = {d: len(encoder().encode([t])[0]) + 1 for d, t in ((r.doc_id, r.text) for r in odd.collect())}
    for d, n in whole.items():
        mine = sorted({(r.piece, r.start, r.length) for r in got if r.doc_id == d})
        assert sum(x[2] for x in mine) == n and all(x[2] == 1024 for x in mine[1:])
    assert packing.pack(empty)[1].count() == 0


def test_reduction_never_costs_a_sequence():
    r = random.Random(5)
    for _ in range(60):
        size = 12
        items = [r.randint(1, size) for _ in range(r.randint(1, 9))]
        patterns = packing.pack_histogram(Counter(items), size)
        assert Counter(w for p, n in patterns for w in p * n) == Counter(items) and all(sum(p) <= size for p, _ in patterns)
        left = np.bincount(items, minlength=size + 1)
        fixed = packing.reduce(left, size)

        def fewest(items):
            best = len(items)

            def go(i, bins):
                nonlocal best
                if len(bins) >= best:
                    return
                if i == len(items):
                    best = len(bins)
                    return
                for k in range(len(bins)):
                    if bins[k] + items[i] <= size and bins[k] not in bins[:k]:
                        go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
                go(i + 1, [*bins, items[i]])

            go(0, [])
            return best

        rest = sorted((w for w in range(1, size + 1) for _ in range(left[w])), reverse=True)
        assert sum(n for _, n in fixed) + fewest(rest) == fewest(sorted(items, reverse=True))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def test_near_duplicates_against_all_pairs(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    for block in (4096, 3):  # the second splits components into blocks
        assert rows(near_dedup.near_duplicates(docs, block=block), "doc_id", "class_id") == [(d, root(d)) for d in ids]


def test_registers_lose_fewer_pairs_than_bands():
    n = near_dedup.BANDS * near_dedup.ROWS
    agree = near_dedup.SIMILARITY + (1 - near_dedup.SIMILARITY) / 256  # sketches of 8 bits agree by chance, too
    least = math.ceil(n * (near_dedup.SIMILARITY - near_dedup.SLACK) - 1e-9)
    lost = sum(math.comb(n, k) * agree**k * (1 - agree) ** (n - k) for k in range(least))
    assert lost + (1 - near_dedup.SIMILARITY**near_dedup.ROWS) ** near_dedup.BANDS < 1e-4


def test_near_duplicates_of_odd_rows(odd, empty):
    got = dict(rows(near_dedup.near_duplicates(odd), "doc_id", "class_id"))
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 1, 8: 8, 9: 9, 10: 10, 11: 11, None: None} and near_dedup.near_duplicates(odd).count() == 13
    assert near_dedup.near_duplicates(empty).count() == 0


def test_probability_jaccard():
    r = np.random.default_rng(2)
    for _ in range(50):
        x, y = r.integers(0, 4, 12), r.integers(0, 4, 12)
        side = lambda w: (np.flatnonzero(w).astype(np.uint64), w[w > 0])
        want = sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in range(12)) for d in range(12) if x[d] and y[d])
        assert math.isclose(near_dedup.exact_similarity(side(x), side(y)), want, abs_tol=1e-12)
    # registers agree as often as the index says
    x, y = r.integers(1, 5, 40), r.integers(1, 5, 40)
    h = np.arange(1, 41, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    m = near_dedup.prob_minhash(np.repeat([0, 1], 40), np.concatenate((h, h)), np.concatenate((x, y)), 2, 4000)
    order = np.argsort(h)
    assert abs((m[0] == m[1]).mean() - near_dedup.exact_similarity((h[order], x[order]), (h[order], y[order]))) < 0.05


def test_nearest_against_brute_force(spark):
    rows_ = spark.read.parquet(f"{D}/embeddings.parquet")
    extra = spark.createDataFrame([(10**6, None), (10**6 + 20, [0.0] * 64), (10**6 + 40, [float("nan")] * 64), (None, [1.0] * 64), (10**6 + 60, [1.0])], "vec_id long, embedding array<float>")
    copies = rows_.where("vec_id = 7").select((F.col("vec_id") + 2_000_000).alias("vec_id"), "embedding").crossJoin(spark.range(30)).select((F.col("vec_id") + F.col("id")).alias("vec_id"), "embedding")
    everything = rows_.select("vec_id", "embedding").unionByName(extra).unionByName(copies)
    got = {}
    for r in ann.nearest(everything, "id % 20 = 0").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    data = [(r.vec_id, np.array(r.embedding, float)) for r in everything.collect() if r.vec_id is not None and r.embedding and len(r.embedding) == 64 and np.isfinite(r.embedding).all() and any(r.embedding)]
    ids, v = np.array([d for d, _ in data]), np.stack([x for _, x in data])
    hits = 0
    queries = [i for i, d in enumerate(ids) if d % 20 == 0]
    assert set(got) == {int(ids[i]) for i in queries}
    for i in queries:
        score = v @ v[i]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:20]
        mine = sorted(got[int(ids[i])])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and all(math.isclose(s, score[ids == d][0], abs_tol=1e-12) for _, d, s in mine)
        hits += len({d for _, d, _ in mine} & set(ids[order].tolist()))
    assert hits >= 0.9 * 20 * len(queries)
    assert ann.nearest(everything.limit(0), "id % 20 = 0").count() == 0


def test_nearest_of_a_repeated_row(spark):
    """One row 30 times beside other ids of the same vector, larger ones included: every id is found once."""
    rows_ = [(1, [1.0, 2.0])] * 30 + [(20, [1.0, 2.0]), (31, [1.0, 2.0]), (40, [2.0, 0.5])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows_, "vec_id long, embedding array<float>"), "id in (1, 20, 40)").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: sorted(x) for q, x in got.items()} == {1: [(1, 20, 5.0), (2, 31, 5.0), (3, 40, 3.0)], 20: [(1, 1, 5.0), (2, 31, 5.0), (3, 40, 3.0)],
                                                      40: [(1, 1, 3.0), (2, 20, 3.0), (3, 31, 3.0)]}


def zip64(members):
    """A ZIP file whose directory keeps all sizes in ZIP64 fields."""
    out, central = b"", b""
    for name, data in members:
        head = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(data), len(data))
        central += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), 28, 0, 0, 0, 0, 0xFFFFFFFF) + name + struct.pack("<HHQQQ", 1, 24, len(data), len(data), len(out))
        out += head + data
    at = len(out)
    end = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, len(members), len(members), len(central), at)
    return out + central + end + struct.pack("<4sIQI", b"PK\6\7", 0, at + len(central), 1) + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


def test_members_and_indexes_are_found_in_the_directory():
    import gzip
    import json

    one = [warc.record(i, f"http://a/{i}", b"first %d" % i, "D", None, "2020-01-01T00:00:00Z") for i in range(4)]
    two = [warc.record(10 + i, f"http://b/{i}", b"second %d" % i, "D", None, "2020-01-01T00:00:00Z") for i in range(3)]
    packed = [gzip.compress(x) for x in two]
    lines = lambda name, parts, cdxj: "\n".join((f"com,a)/{i} 20200101000000 " if cdxj else "") + json.dumps(
        {"filename": name, "offset": str(sum(map(len, parts[:i]))) if cdxj else sum(map(len, parts[:i])), "length": str(len(p)) if cdxj else len(p)}) for i, p in enumerate(parts)).encode()
    members = [(b"archive/a.warc", b"".join(one)), (b"archive/b.warc.gz", b"".join(packed)), (b"indexes/a.cdxj", b"!meta {}\n" + lines("a.warc", one, True)),
               (b"indexes/b.cdx.gz", gzip.compress(lines("archive/b.warc.gz", packed, False))), (b"indexes/b.idx", b"not read"), (b"pages/pages.jsonl", b"{}"), (b"archive/empty.warc", b"")]
    for most in (50, 1 << 20):
        data = zip64(members)
        assert [d for _, d in warc.records_of(lambda at, n: data[at : at + n], len(data), most)] == one + two
    for broken in (members[:2] + members[2:3], members[1:], members[:1] + members[2:]):
        data = zip64(broken)
        with pytest.raises(ValueError):
            list(warc.records_of(lambda at, n: data[at : at + n], len(data)))


def test_classifier_features_are_words_and_code_points():
    texts = ["na\u00efve \u65e5\u672c\u8a9e ok", "", "a", "\U0001f600\U0001f600 ab", "plain ascii text"]
    block = next(blocks(pa.array(texts)))
    code, _ = quality_classifier.characters(np.frombuffer("\n".join(["", *texts, ""]).encode(), np.uint8))
    assert len(code) == len("\n".join(["", *texts, ""]))
    seen = {}
    for (ids, first), n in zip(quality_classifier.features(block), (3, 4, 0)):
        for i, t in enumerate(texts):
            mine = ids[first[i] : first[i + 1]].tolist()
            marked = f"\n{t}\n"
            grams = [marked[k : k + n] for k in range(len(marked) - n + 1)] if n else t.split()
            assert len(mine) == len(grams), (t, n)
            for g, x in zip(grams, mine):
                assert seen.setdefault((n, g), x) == x  # one id per gram, wherever it stands


def test_zip_directories():
    records = [(i, warc.record(i, "http://x", b"p%d" % i, "D", None, "2020-01-01T00:00:00Z")) for i in range(5)]
    plain = warc.pack_archive(records)
    read = lambda data: lambda at, n: data[at : at + n]
    members = warc.directory(read(plain), len(plain))
    parts = [(n.encode(), plain[warc.data_start(read(plain), m) :][: m.size]) for n, m in members.items()]
    for data in (plain, zip64(parts)):
        assert list(warc.records_of(read(data), len(data), 300)) == records
    with pytest.raises(ValueError):
        warc.directory(read(b"x" * 100), 100)


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a b\r\n", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "x\r\n\r\ny" * 1000), (None, "u", "same"), (6, "u", "é"), (6, "u", "é"), (9, "u", "é")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = rows(warc.read_archives(warc.write_archives(df, f"file://{tmp_path}/a")), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    top = {"same": 2, "": 4, "é": 9}
    want = [(p, len((t or "").encode()), sha(t), *(("revisit", top[t or ""]) if p is not None and top.get(t or "", p) != p else ("response", None))) for p, _, t in pages]
    assert got == sorted(want, key=lambda x: tuple((v is None, v) for v in x))
    assert warc.read_archives(warc.write_archives(df.limit(0), f"file://{tmp_path}/b")).count() == 0


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    n, rep = len(words), len(inside)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), rep, n < 10 or 100 * rep > 20 * n


def test_quality_rules(spark, odd, empty):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    model = quality_rules.train(docs, labels)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for df in (docs, odd):
        got = quality_rules.quality_rules(df, model)
        assert rows(got, "doc_id", *names) == sorted(((r.doc_id, *base_counts(r.text)) for r in df.collect()), key=lambda x: tuple((v is None, v) for v in x))
        assert not [r for r in got.collect() if r.kept and (r.base_failed or r.content_share < 0.5)]
        assert quality_rules.keep_good(df, model).count() == got.where("kept").count()
    joined = quality_rules.quality_rules(docs, model).join(labels, "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept for r in joined if r.quality]) > 0.97 and np.mean([r.kept for r in joined if not r.quality] or [0]) < 0.5
    assert quality_rules.quality_rules(empty, model).count() == 0
    none = quality_rules.train(docs, labels.limit(0))  # nothing to learn: all lines are content
    assert quality_rules.quality_rules(docs, none).where("kept = base_failed").count() == 0


def test_viterbi_against_all_labellings():
    r = np.random.default_rng(0)
    model = quality_rules.Crf(r.normal(size=(quality_rules.N_FEATURES, 2)), r.normal(size=(2, 2)))
    first = np.array([0, 3, 3, 9, 10])
    x = (r.random((10, quality_rules.N_FEATURES)) < 0.3).astype(np.float32)
    got, score = quality_rules.viterbi(model, x, first), x @ model.emit
    for a, b in zip(first, first[1:]):
        paths = [[(m >> k) & 1 for k in range(b - a)] for m in range(1 << (b - a))]
        value = lambda p: sum(score[a + k, y] for k, y in enumerate(p)) + sum(model.step[u, v] for u, v in zip(p, p[1:]))  # noqa: B023, E731
        assert math.isclose(value(got[a:b].tolist()), max(map(value, paths)))


def test_language_id(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"
    model = language_id.train(docs.where(f"not {held}").select("text", "lang"))
    got = language_id.language_id(docs, model, held).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and np.mean([r.lang_pred == r.lang for r in got]) > 0.98
    out = {r.doc_id: (r.lang_pred, r.score) for r in language_id.language_id(odd, model).collect()}
    assert out[3] == out[4] == out[5] == out[10] == ("und", 0.0) and out[1][0] == "en" and all(0 <= s <= 1 for _, s in out.values())
    nothing = language_id.train(empty.select("text", "lang"))
    assert {r.lang_pred for r in language_id.language_id(odd, nothing).collect()} == {"und"} and language_id.language_id(empty, model).count() == 0
    # an unseen word falls back to its n-grams, a known one does not
    w = language_id.words_of(["the zzthezz"])
    assert (language_id.word_scores(w, model)[0] == model.word_log[np.searchsorted(model.hashes, w.hashes[0])]).all()


def test_language_id_knows_every_word_and_gram(spark):
    """The few words a task holds change no result, and no word or n-gram of training is lost: scores are those of a count in Python."""
    texts = [("en", "the the the the cat sat onward"), ("fr", "le le le chat"), ("de", "der der hund straße")]
    docs = prepare(spark).createDataFrame([(i, x, lang) for i, (lang, x) in enumerate(texts)], "doc_id long, text string, lang string")
    asked = ["the cat", "chat", "sat strasse", "qqq", "hunde le hunde", "1"]
    words, grams = {}, {}
    for lang, x in texts:
        for w in x.split():
            words.setdefault(w, Counter())[lang] += 1
            for n in range(1, 5):
                for at in range(len(w) + 3 - n):
                    grams.setdefault(n, {}).setdefault(f" {w} "[at : at + n], Counter())[lang] += 1
    log = lambda table, key, lang: math.log((table[key][lang] + 0.5) / (sum(c[lang] for c in table.values()) + 0.5 * len(table)))

    def score(w, lang):
        if w in words:
            return log(words, w, lang)
        n = next(n for n in (4, 3, 2, 1) if any(f" {w} "[a : a + n] in grams[n] for a in range(len(w) + 3 - n)))
        hit = [g for a in range(len(w) + 3 - n) if (g := f" {w} "[a : a + n]) in grams[n]]
        return sum(log(grams[n], g, lang) for g in hit) / len(hit)

    for local in (0, 3, 1000):
        model = language_id.train(docs, local)
        got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.language_id(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
        for i, x in enumerate(asked):
            sums = {lang: 0.2 * sum(score(w, lang) for w in x.split()) for lang in ("de", "en", "fr")}
            top = max(sums, key=sums.get)
            assert got[i] == ("und", 0.0) if x == "1" else got[i][0] == top and math.isclose(got[i][1], 1 / sum(math.exp(v - sums[top]) for v in sums.values()), abs_tol=1e-5)
    assert language_id.keep_known(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), lambda: model, 0.0).count() == 5


def test_quality_classifier(spark, odd, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"
    model = quality_classifier.train(docs, labels, f"not {held}")
    got = quality_classifier.quality_scores(docs, model, held).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9 and np.mean([r.predicted for r in got if r.quality]) > 0.95
    assert quality_classifier.quality_scores(odd, model).where("score between 0 and 1").count() == 13 and quality_classifier.quality_scores(empty, model).count() == 0
    # the table of one number per feature is the averaged-embedding model: a text's score does not depend on its block
    texts = ["one two three", "", "|| ## || ##"]
    alone = [quality_classifier.score_block(b, model) for t in texts for b in blocks(pa.array([t]))]
    together = next(blocks(pa.array(texts)))
    assert np.allclose(np.concatenate(alone), quality_classifier.score_block(together, model))


def test_sampling_follows_the_lattice_and_decodes(spark, odd, empty):
    lat = sampling.lattice()
    piece = {p.decode("utf-8", "replace").replace(" ", "▁"): i for i, p in enumerate(lat.piece)}
    weight = dict(zip(lat.ids.tolist(), lat.weight.tolist()))

    def cuts(s):
        if not s:
            yield ()
        for e in range(1, len(s) + 1):
            if piece.get(s[:e]) in weight:
                yield from ((piece[s[:e]], *rest) for rest in cuts(s[e:]))

    n = 20_000
    got = Counter(tuple(x.tolist()) for x in lat.sample(["then"] * n, np.arange(n, dtype=np.uint64)))
    all_ = {c: math.exp(sum(weight[i] for i in c)) for c in cuts("▁then")}
    assert set(got) <= set(all_) and all(abs(got[c] / n - v / sum(all_.values())) < 0.02 for c, v in all_.items())
    coded = sampling.encode(odd)
    want = Counter((r.doc_id, (r.text or "").encode()) for r in odd.collect())
    assert Counter((r.doc_id, bytes(r.text)) for r in sampling.decode(coded).collect()) == want
    again = sampling.encode(odd.repartition(1))
    assert rows(coded, "doc_id", "ids") == rows(again, "doc_id", "ids") != rows(sampling.encode(odd, seed=2), "doc_id", "ids")
    assert sampling.encode(empty).count() == 0
    r = random.Random(2)
    texts = ["".join(r.choice("abthe  ▁\n\t日é\U0010ffff\U0001f600a1\x00") for _ in range(r.randint(0, 12))) for _ in range(500)]
    assert lat.decode(lat.sample(texts, np.arange(500, dtype=np.uint64))) == [t.encode() for t in texts]


def test_pieces_of_a_lattice_are_found_only_while_something_matches(monkeypatch):
    looked = 0

    class Counted(np.ndarray):
        def __getitem__(self, at):
            nonlocal looked
            looked += np.size(at)
            return np.asarray(self)[at]

    r = random.Random(7)
    lat = sampling.lattice()
    texts = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzé日\n▁") for _ in range(r.randint(1, 20))) for _ in range(30)) for _ in range(100)]
    keys = np.arange(100, dtype=np.uint64)
    assert zlib.crc32(np.concatenate(lat.sample(texts, keys)).tobytes()) == 2885863298  # as when every length was tried
    for name, table in vars(lat).items():
        if isinstance(table, np.ndarray):
            monkeypatch.setattr(lat, name, table.view(Counted))
    unknown = [" ".join("".join(chr(0xE000 + r.randrange(200)) for _ in range(40)) for _ in range(30)) for _ in range(100)]
    lat.sample(unknown, keys)
    assert looked < 10 * sum(map(len, unknown))  # 14.6 before


def test_trie_of_pieces_leads_to_its_words_only():
    r = random.Random(3)
    for letters in (1, 2, 3, 60, 700):
        words = sorted({tuple(r.randint(1, letters) for _ in range(r.randint(1, 4))) for _ in range(400)} | {(c,) for c in range(1, letters + 1)})
        base, owner, state = sampling._trie([np.array(w) for w in words], letters)
        known = {w[i:] for w in words for i in range(len(w))}
        probes = known | {tuple(r.randint(0, letters) for _ in range(r.randint(1, 5))) for _ in range(2000)} | {(c, *w) for w in words for c in (0, 1, letters)}
        reached = {}
        for w in probes:
            s = 0
            for c in reversed(w):
                to = int(base[s]) + c
                s = to if s is not None and owner[to] == s else None
                if s is None:
                    break
            assert (s is not None) == (w in known)
            reached[w] = s
        assert [reached[w] for w in words] == state.tolist() and len(set(state.tolist())) == len(words)
