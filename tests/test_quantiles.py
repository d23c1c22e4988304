"""Exact quantiles against a sorted list."""

import math
import random

import pytest

from tripline.operators.quantiles import quantiles


def plain(values, q):
    v = sorted(values)
    place = (len(v) - 1) * q
    a, b = v[math.floor(place)], v[math.ceil(place)]
    return a if a == b else (1 - (place - math.floor(place))) * a + (place - math.floor(place)) * b


@pytest.mark.parametrize(("q", "buckets", "most"), [(0.9, 4, 3), (0.5, 256, 4096), (0.0, 3, 2), (1.0, 4, 3)])
def test_quantiles_against_sorting(spark, q, buckets, most):
    r = random.Random(9)
    groups = {
        "hot": [r.gauss(0, 1e3) for _ in range(1500)], "ties": [5.0] * 400 + [7.0] * 30, "one": [3.25], "two": [1.0, 2.0], "wide": [r.choice((-1, 1)) * 10.0 ** r.randrange(-300, 300) for _ in range(200)],
        "edge": [-1.7e308, 1.7e308, 0.0, 5e-324, 1e308, -1e308, 3.0], "near": [1.0 + k * 2.0**-52 for k in range(40)], None: [float(k) for k in range(11)], "inf": [float("-inf"), float("inf"), 1.0, 2.0, 3.0, 4.0, 5.0, 6.0],
    }
    rows = [(g, "x", v) for g, vs in groups.items() for v in vs] + [("hot", "x", None), ("none", "x", None)]
    r.shuffle(rows)
    got = {x["g"]: x["p"] for x in quantiles(spark.createDataFrame(rows, "g string, h string, v double").repartition(4), ["g", "h"], "v", q, "p", buckets, most).collect()}
    assert got.keys() == groups.keys()
    for g, v in got.items():
        want = plain(groups[g], q)
        assert v == want or math.isclose(v, want, rel_tol=1e-12), g


def test_quantiles_of_nothing_and_nan(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("b", float("nan"))], "g string, v double")
    got = {x["g"]: x["q"] for x in quantiles(df, ["g"], "v", 1.0, "q").collect()}
    assert math.isnan(got["a"]) and math.isnan(got["b"])
    assert quantiles(df.limit(0), ["g"], "v", 0.5).collect() == []
