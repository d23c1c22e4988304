"""The pipeline against its stages' decisions worked out plainly."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tripline.llm.text import prepare

D = "/root/testdata/sf0.001"


def smallest_of_classes(rows, similarity=0.8):
    """Ids left when of texts linked by five-word shingles (weighted by how often they occur) the smallest stays."""
    sets = {}
    for d, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets[d] = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if not (x == y and dict(rows)[a] == dict(rows)[b]) and not x.keys() & y.keys():
                continue
            # probability Jaccard: the chance that one race of exponential arrivals has one winner in both
            same = sum(1 / sum(max(x[k] / x[s], y[k] / y[s]) for k in x.keys() | y.keys()) for s in x.keys() & y.keys())
            if same >= similarity - 1e-9 or dict(rows)[a] == dict(rows)[b]:
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d for d in ids if parent[d] == d}


def test_each_stage_on_what_the_one_before_kept(spark):
    prepare(spark)
    docs = spark.read.parquet(f"{D}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in P.STAGES] == ["quality rules", "language ID", "near duplicates", "suffix-array dedup", "best-fit packing"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    good = P.rules(spark, docs, D).cache()
    assert good.columns == names
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    kept = {r.doc_id for r in good.collect()}
    clean = [d for d, q in labels.items() if q == 1 and words[d] >= 10]
    assert len([d for d in clean if d in kept]) >= 0.95 * len(clean)
    known = P.language(spark, good, D).cache()
    assert known.columns == names and known.count() >= 0.97 * good.count()
    single = P.near_duplicates(spark, known, D).cache()
    assert single.columns == names and {r.doc_id for r in single.collect()} == smallest_of_classes([(r.doc_id, r.text) for r in known.collect()])
    cut = P.passages(spark, single, D).cache()
    assert cut.columns == names and cut.count() == single.count()
    after = {r.doc_id: r.text for r in cut.collect()}
    seen = set()
    for r in sorted(single.collect(), key=lambda r: r.doc_id):
        b = r.text.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if b[i : i + 50] in seen:
                gone[i : i + 50] = b"\1" * 50
        seen |= {b[i : i + 50] for i in range(len(b) - 49)}
        assert after[r.doc_id] == bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    packed = P.sequences(spark, cut, D)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in cut.collect()}
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and repeated rows and columns whose names the stages might use themselves."""
    docs = prepare(spark).read.parquet(f"{D}/documents.parquet").where("doc_id < 40")
    extra = spark.createDataFrame([(1, None, "en", None, None), (900, "", None, None, 0), (901, " \n", "en", "x", 2), (None, "no id at all, but some words to read here", "en", "x", 41)], docs.schema)
    names = {c: F.lit(f"user {c}") for c in ("_kept", "_digest", "digest", "kept", "part", "node", "class_id", "y", "content_share", "lang_pred")}
    return docs.unionByName(docs.where("doc_id in (3, 5)")).unionByName(extra).withColumns(names)


def test_stages_take_odd_rows_and_clashing_columns(spark, odd):
    before = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, odd, D)
        assert out.columns == odd.columns, name
        assert all(r["_kept"] == "user _kept" and r["_digest"] == "user _digest" and r["kept"] == "user kept" for r in out.collect()), name
        before[name] = sorted((r.doc_id is not None, r.doc_id or 0) for r in out.collect())
    assert before["near duplicates"].count((True, 3)) in (0, 2) and (False, 0) in before["near duplicates"]
    assert len(before["suffix-array dedup"]) == odd.count()
    packed = P.sequences(spark, odd, D)
    assert packed.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()


def test_stages_of_an_empty_table(spark, odd):
    for name, stage in P.STAGES:
        assert stage(spark, odd.limit(0), D).collect() == [], name


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, D).cache()
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(tuple(r) for r in P.run(spark, D).select(same).collect()) == sorted(tuple(r) for r in docs.select(same).collect())
