"""Best and second-best prototype against all cosines."""

import math
import random

import pytest

from tripline.plans.classify import nearest_prototype


def plain(v, protos, k):
    scored = []
    for label, p in protos:
        size = math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in p))
        scored.append((-round(sum(x * y for x, y in zip(v, p)) / size if size else 0.0, 6), label))
    return [(label, -neg) for neg, label in sorted(scored)[:k]]


@pytest.mark.parametrize(("block", "k"), [(4096, 2), (7, 2), (5, 1)])
def test_nearest_prototypes_against_all_pairs(spark, block, k):
    r = random.Random(block)
    vec = lambda: [r.gauss(0, 1) for _ in range(4)]
    protos = [("x", f"l{i:02d}", vec()) for i in range(60)] + [("y", "only", vec())] + [("x", "zero", [0.0] * 4), ("x", "l05", vec()), ("x", "a copy", None)]
    protos += [("x", f"twin{i}", protos[3][2]) for i in range(3)] + [("x", None, vec())]
    rows = [(i, r.choice("xxxy"), vec()) for i in range(120)] + [(200, "x", [0.0] * 4), (201, "x", None), (202, "none", vec()), (203, "x", protos[3][2]), (203, "x", protos[3][2])]
    df = spark.createDataFrame(rows, "id int, kind string, embedding array<double>").repartition(3)
    ps = spark.createDataFrame(protos, "kind string, label string, embedding array<double>")
    got = [tuple(x) for x in nearest_prototype(df, ps, "id", by="kind", k=k, block=block).collect()]
    want = []
    for i, kind, v in rows:
        mine = [(label, p) for g, label, p in protos if g == kind and label and p and any(p)]
        if mine:
            top = plain(v, mine, k) if v and any(v) else []
            want.append((i, kind, *(x for j in range(k) for x in (top[j] if j < len(top) else (None, None)))))
    blank = lambda rows: sorted(tuple(x + 0.0 if isinstance(x, float) else x for x in w) for w in rows if w[2])
    assert blank(got) == blank(want) and len(got) == len(want)
    every = nearest_prototype(df.drop("kind"), ps.drop("kind"), "id", k=k, block=block).collect()
    alone = {i: plain(v, [(label, p) for _, label, p in protos if label and p and any(p)], k) if v and any(v) else [(None, None)] for i, _, v in rows}
    assert len(every) == len(rows) and all(x["best_label"] == alone[x["id"]][0][0] for x in every)
