"""Lists in parts against sorted sets."""

import random

import pytest

from tripline.operators.lists import joined_lists, ranked, segmented_lists


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_segments_join_to_the_sorted_list(spark, size):
    r = random.Random(size)
    rows = [("hot" if r.random() < 0.6 else r.choice(["a", "b", None]), r.choice([1, None]), f"v{r.randrange(400):04d}" if r.random() < 0.95 else None) for _ in range(1500)]
    df = spark.createDataFrame(rows, "g string, h int, v string").repartition(6)
    want = {}
    for g, h, v in rows:
        if v is not None:
            want.setdefault((g, h), set()).add(v)
    parts = segmented_lists(df, ["g", "h"], "v", size).collect()
    assert all(x["first_no"] == x["segment"] * size and 1 <= len(x["values"]) <= size for x in parts)
    for key, values in want.items():
        mine = sorted((x["segment"], x["values"]) for x in parts if (x["g"], x["h"]) == key)
        assert [v for _, part in mine for v in part] == sorted(values) and [n for n, _ in mine] == list(range(len(mine)))
    cells = {(x["g"], x["h"]): x["values"] for x in joined_lists(segmented_lists(df, ["g", "h"], "v", size), ["g", "h"], most=9).collect()}
    assert cells == {k: sorted(v)[:9] for k, v in want.items()}
    assert segmented_lists(df.limit(0), ["g", "h"], "v").collect() == []


def test_segments_by_another_order(spark):
    df = spark.createDataFrame([("m", f"d{i}", float((i * 7) % 11)) for i in range(11)], "g string, v string, o double")
    got = sorted((x["segment"], x["values"]) for x in segmented_lists(df, ["g"], "v", 4, ["o"]).collect())
    assert [v for _, part in got for v in part] == [v for _, v in sorted(((i * 7) % 11, f"d{i}") for i in range(11))]


def test_ranks_of_a_hot_value(spark):
    r = random.Random(4)
    rows = [(7 if r.random() < 0.7 else r.choice([1, 9, None]), f"d{i:04d}") for i in range(900)]
    r.shuffle(rows)
    got = {x["d"]: x["rank"] for x in ranked(spark.createDataFrame(rows, "s int, d string").repartition(5), ["s", "d"], "rank").collect()}
    assert got == {d: i + 1 for i, (_, d) in enumerate(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1])))}
