"""The type model: features against a plain TF-IDF, and a round trip through a file."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array

from tripline.plans import classify as C
from tripline.plans.textmodel import strip_accents

WORDS = "camera reset upload failed modem lost gps fix ok ready caf\u00e9 na\u00efve \u00c9t\u00e9 x 42".split()


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    out = [(i, " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 9))) + (" failed" if i % 3 == 0 else " ready"), "error " if i % 3 == 0 else "INFO") for i in range(260)]
    out += [(900, None, "ERROR"), (901, "", "info"), (902, "unlabelled", "maybe"), (903, "none", None)]
    return spark.createDataFrame(out, "id int, description string, type string")


def terms(text):
    w = re.findall(r"\b\w\w+\b", strip_accents((text or "").lower()))
    return Counter([*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])


def test_features_and_margins_survive_saving(spark, rows, tmp_path):
    model, held_out = C.train_type_model(rows)
    counts = {(x["part"], x["type"]): x["rows_count"] for x in C.training_counts(rows).collect()}
    assert counts["dropped", None] == 2 and held_out.count() == sum(n for (part, _), n in counts.items() if part == "test")
    assert sum(counts.values()) == rows.count() and {"ERROR", "INFO"} == {t for p, t in counts if p == "train"}
    test_ids = {x["id"] for x in held_out.collect()}
    train = [terms(x["description"]) for x in rows.collect() if x["id"] not in test_ids and x["id"] not in (902, 903)]
    df = Counter(t for x in train for t in x)
    vocabulary = {t: k for k, t in enumerate(model.stages[4].vocabulary)}
    assert set(vocabulary) == {t for t, n in df.items() if n >= 2}
    for x in model.transform(held_out).select("description", vector_to_array("features").alias("f")).collect():
        v = {t: (1 + math.log(n)) * (math.log((1 + len(train)) / (1 + df[t])) + 1) for t, n in terms(x["description"]).items() if t in vocabulary}
        size = math.sqrt(sum(y * y for y in v.values())) or 1.0
        assert all(math.isclose(x["f"][k], v.get(t, 0.0) / size, abs_tol=1e-9) for t, k in vocabulary.items())
    before = {x["id"]: (x["predicted_type"], x["margin"]) for x in C.predict_type(model, rows, margin=True).collect()}
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    assert {x["id"]: (x["predicted_type"], x["margin"]) for x in C.predict_type(again, rows, margin=True).collect()} == before
    right = [before[x["id"]][0] == x["type"].strip().upper() for x in held_out.collect()]
    assert sum(right) >= 0.9 * len(right) and len(right) > 30


def test_too_few_rows(spark, rows):
    with pytest.raises(ValueError, match="at least 100"):
        C.train_type_model(rows.limit(50))
