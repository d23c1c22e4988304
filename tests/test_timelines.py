"""Ordered operators against brute force, with ties, hot keys and small blocks."""

import random

import pytest
from pyspark.sql import functions as F

from tripline.operators import asof as A
from tripline.operators import intervals as I
from tripline.operators import sequences as Q
from tripline.operators.timeline import scan


def points(seed, n=300, span=4000, hot=0.5):
    """(key, ts, id): one key holds about half of the rows and times repeat."""
    r = random.Random(seed)
    return [("hot" if r.random() < hot else f"k{r.randrange(4)}", r.randrange(span), i) for i in range(n)]


def frame(spark, rows, schema="key string, ts bigint, id int"):
    return spark.createDataFrame(rows, schema)


def by_key(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("width", [1, 2, 86_400])
def test_scan_matches_brute_force(spark, width):
    rows = points(width)
    out = scan(frame(spark, rows), ["key"], "ts", ["id"], lag={"p": "id"}, lead={"n": "id"}, total={"s": "id"}, peak={"m": "id"},
               peak_before={"b": "id"}, last={"l": F.when(F.col("id") % 3 == 0, F.col("id"))},
               following={"f": F.when(F.col("id") % 3 == 0, F.col("id"))}, width_s=width)
    got = {r["id"]: r for r in out.collect()}
    for seq in by_key(rows).values():
        ids = [r[2] for r in seq]
        for i, x in enumerate(ids):
            r = got[x]
            assert r["p"] == (ids[i - 1] if i else None) and r["n"] == (ids[i + 1] if i + 1 < len(ids) else None)
            assert r["s"] == sum(ids[:i + 1]) and r["m"] == max(ids[:i + 1]) and r["b"] == max(ids[:i], default=None)
            assert r["l"] == next((y for y in reversed(ids[:i + 1]) if y % 3 == 0), None)
            assert r["f"] == next((y for y in ids[i:] if y % 3 == 0), None)
    assert len(got) == len(rows)


def test_scan_keeps_rows_without_a_time(spark):
    rows = [("a", None, 1), ("a", 5, 2), ("a", 9_000, 3)]
    got = {r["id"]: r["p"] for r in scan(frame(spark, rows), ["key"], "ts", ["id"], lag={"p": "id"}, width_s=1).collect()}
    assert got == {1: None, 2: 1, 3: 2}


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("exact", [True, False])
def test_asof(spark, direction, exact):
    if direction == "nearest" and not exact:
        pytest.skip("nearest includes equal times")
    left, right = points(3), points(4, 120)
    r = frame(spark, right).groupBy("key", "ts").agg(F.min("id").alias("rid")).withColumnRenamed("ts", "rt")
    out = A.asof_join(frame(spark, left), r, ["key"], "ts", "rt", direction=direction, tolerance_ms=60, allow_exact=exact, width_s=1)
    got = {x["id"]: x["rt"] for x in out.collect()}
    for key, ts, i in left:
        times = sorted({t for k, t, _ in right if k == key and abs(t - ts) <= 60 and (exact or t != ts)})
        back, ahead = [t for t in times if t <= ts], [t for t in times if t >= ts]
        want = {"backward": max(back, default=None), "forward": min(ahead, default=None),
                "nearest": min(times, key=lambda t: (abs(t - ts), t), default=None)}[direction]
        assert got[i] == want
    assert len(got) == len(left)


def test_pairs_keep_ties_apart(spark):
    starts = frame(spark, [("a", 1, 0), ("a", 5, 0), ("a", 5, 1), ("a", 7, 0), ("a", 9, 0)])
    ends = frame(spark, [("a", 5, 0), ("a", 8, 0)])
    got = sorted((r["start_ts"], r["end_ts"]) for r in A.pair_events(starts, ends, ["key"]).collect())
    # the streak before the end, two zero-length pairs at it, one later pair; the last start has no end
    assert got == [(1, 5), (5, 5), (5, 5), (7, 8)]
    null_pair = A.pair_events(starts.withColumn("p", F.lit(None).cast("string")), ends.withColumn("p", F.lit(None).cast("string")), ["key"], pair=["p"])
    assert null_pair.count() == 4


def test_count_in_ranges_counts_touching_ranges_twice(spark):
    pts = points(8)
    ranges = [("hot", 10, 500), ("hot", 10, 500), ("k1", 0, 4000), ("none", 1, 2)]
    r = spark.createDataFrame(ranges, "key string, lo bigint, hi bigint")
    out = A.count_in_ranges(frame(spark, pts), r, ["key"], "ts", [("lo", "hi"), ("hi", "hi")], "n", width_s=1).collect()
    assert len(out) == 4
    for x in out:
        inside = [t for k, t, _ in pts if k == x["key"] and x["lo"] <= t <= x["hi"]]
        assert x["n"] == len(inside) + sum(t == x["hi"] for t in inside)


def test_interval_ends(spark):
    boots = spark.createDataFrame([("a", 1, 10, 20), ("a", 2, 20, None), ("b", 1, 5, 9)], "key string, n int, start bigint, end bigint")
    ev = frame(spark, [("a", 9, 0), ("a", 10, 1), ("a", 20, 2), ("a", 99, 3), ("b", 9, 4), ("c", 1, 5)])
    got = {r["id"]: r["n"] for r in A.assign_interval(ev, boots, ["key"], "ts", width_s=1).collect()}
    assert got == {0: None, 1: 1, 2: 2, 3: 2, 4: None, 5: None}


def covered(spans):
    return {x for s, e in spans for x in range(s, e)}


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_algebra(spark, seed):
    r = random.Random(seed)
    mk = lambda n, w: [("h" if r.random() < .6 else "z", s, s + r.randrange(w)) for s in (r.randrange(3000) for _ in range(n))]
    a, b = mk(60, 120), mk(40, 90)
    schema = "key string, start bigint, end bigint"
    fa, fb = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    for op, rule in ((I.merge_intervals, lambda x, y: x), (I.intersect_intervals, lambda x, y: x & y), (I.subtract_intervals, lambda x, y: x - y)):
        out = (op(fa, ["key"], width_s=1) if op is I.merge_intervals else op(fa, fb, ["key"], width_s=1)).collect()
        for key in ("h", "z"):
            spans = sorted((x["start"], x["end"]) for x in out if x["key"] == key)
            assert covered(spans) == rule(covered([x[1:] for x in a if x[0] == key]), covered([x[1:] for x in b if x[0] == key]))
            assert all(p[1] < q[0] for p, q in zip(spans, spans[1:]))  # disjoint, touching ones merged


def fold(times, limit):
    kept = []
    for t in times:
        if not kept or t - kept[-1] > limit:
            kept.append(t)
    return kept


@pytest.mark.parametrize("limit", [3, 40, 5000])
def test_fold_operators(spark, limit):
    rows = points(limit)
    df = frame(spark, rows)
    thin = Q.thin_events(df, ["key"], "ts", limit, ["id"], width_s=1).collect()
    clusters = Q.anchor_clusters(df, ["key"], "ts", limit, ["id"], width_s=1).collect()
    for key, seq in by_key(rows).items():
        want = fold([r[1] for r in seq], limit)
        assert sorted(r["ts"] for r in thin if r["key"] == key) == want
        mine = [r for r in clusters if r["key"] == key]
        assert sorted(r["cluster_start"] // 1000 for r in mine) == want
        assert sum(r["cluster_size"] for r in mine) == len(seq)
        for c in mine:
            start = c["cluster_start"] // 1000
            assert c["id"] == min(r[2] for r in seq if start <= r[1] <= start + limit and r[1] < min([w for w in want if w > start], default=1 << 60))


@pytest.mark.parametrize("limit", [7, 50])
def test_fold_of_a_key_that_never_pauses(spark, limit):
    # One run over thousands of limits: folded block by block, equal to the plain rule
    r = random.Random(limit)
    t, rows = 10 ** 12, []
    for i in range(4000):
        t += r.choice((0, 1, 3, limit)) * 100
        rows.append(("hot" if i % 50 else "k", t, i))
    df = frame(spark, rows)
    thin = Q.thin_events(df, ["key"], "ts", limit * 100, ["id"], width_s=1).collect()
    clusters = Q.anchor_clusters(df, ["key"], "ts", limit * 100, ["id"], width_s=1).collect()
    for key, seq in by_key(rows).items():
        want = fold([x[1] for x in seq], limit * 100)
        assert sorted(x["ts"] for x in thin if x["key"] == key) == want
        assert sum(x["cluster_size"] for x in clusters if x["key"] == key) == len(seq)
        assert sorted(x["cluster_start"] // 1000 for x in clusters if x["key"] == key) == want


def test_fold_over_a_thousand_blocks_that_depend_on_their_history(spark):
    # steady steps keep the phase of the first anchor for ever, so no block's outcome is known without the ones before it
    rows = [("hot", 60 * i, i) for i in range(21_000)] + [("other", 60 * i + 7, i) for i in range(40)] + [("none", None, 1)]
    thin = Q.thin_events(frame(spark, rows), ["key"], "ts", 100, ["id"], width_s=1)
    maps = Q._block_maps(frame(spark, rows).filter("ts is not null").selectExpr("key", "ts * 1000 as __us", "ts div 1000 as __blk"), ["key"], 100_000, 1_000_000)
    assert maps.filter("key = 'hot' and size(__steps) > 1").count() > 1_000
    got = by_key([(x["key"], x["ts"], x["id"]) for x in thin.collect()])
    assert {k: [x[1] for x in v] for k, v in got.items()} == {k: fold([60 * i + 7 * (k == "other") for i in range(n)], 100) for k, n in (("hot", 21_000), ("other", 40))}


def test_gap_equal_to_the_window_does_not_split(spark):
    rows = [("a", 0, 0), ("a", 10, 1), ("a", 21, 2), ("b", 5, 3)]
    got = {r["id"]: (r["batch"], r["batch_size"]) for r in Q.gap_sessions(frame(spark, rows), ["key"], "ts", 10, ["id"], width_s=1).collect()}
    assert got == {0: (1, 2), 1: (1, 2), 3: (2, 1), 2: (3, 1)}


def test_empty_inputs(spark):
    empty = frame(spark, [])
    assert Q.thin_events(empty, ["key"], "ts", 5).count() == 0
    assert A.asof_join(empty, empty.withColumnRenamed("ts", "rt"), ["key"], "ts", "rt", prefix="r_").count() == 0
    assert I.merge_intervals(empty.select("key", F.col("ts").alias("start"), F.col("ts").alias("end")), ["key"]).count() == 0
