"""Event types and priorities: pattern map, model, nearest prototype (ML-01 .. ML-07, TXT-05)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripline.functions import scalars as S
from tripline.functions import text as X
from tripline.operators.nearest import nearest_in_blocks
from tripline.operators.templates import match_templates
from tripline.plans.textmodel import AccentStripper, SmoothIDF, SublinearTF


def match_patterns(df: DataFrame, patterns: DataFrame, text: str = "description", most_patterns: int = 2_000, most_texts: int = 50_000) -> DataFrame:
    """TXT-05: type of the first pattern (by ``rank``) a text matches; ``<N>`` stands for any text of one character or more.

    Distinct texts are matched once, each against a trie of the patterns that share a word with it.
    """
    first = match_templates(df, patterns, text, most_patterns, most_texts).select(F.col("text").alias(text), F.col("type").alias("matched_type"))
    return df.join(first, text, "left")


# ── trained model ────────────────────────────────────────────────────────────


def labelled_rows(df: DataFrame, text: str = "description", label: str = "type") -> DataFrame:
    """Rows with a usable label; 1 is ERROR.  A null text counts as empty."""
    up = F.upper(F.trim(label))
    return df.filter(up.isin("ERROR", "INFO")).withColumns({"label": (up == "ERROR").cast("double"), "text": F.coalesce(F.col(text), F.lit(""))})


def _held_out(seed: int, share: int) -> Column:
    """Whether a labelled row is held out: by hash of text and label, so equal rows stay together and re-run tasks agree."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("label").cast("int").cast("string"), F.col("text")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100 < share


def training_counts(df: DataFrame, text: str = "description", label: str = "type", seed: int = 42, share: int = 20) -> DataFrame:
    """ML-01: (part, type, rows_count): rows trained on, held out, and dropped for their label (type null)."""
    rows = labelled_rows(df, text, label)
    parts = rows.groupBy(F.when(_held_out(seed, share), "test").otherwise("train").alias("part"), F.when(F.col("label") == 1, "ERROR").otherwise("INFO").alias("type")).agg(F.count(F.lit(1)).alias("rows_count"))
    invalid = ~F.coalesce(F.upper(F.trim(label)).isin("ERROR", "INFO"), F.lit(False))
    return parts.unionByName(df.filter(invalid).groupBy().agg(F.count(F.lit(1)).alias("rows_count")).select(F.lit("dropped").alias("part"), F.lit(None).cast("string").alias("type"), "rows_count"))


def train_type_model(df: DataFrame, text: str = "description", label: str = "type", features: int = 250_000,
                     min_rows: int = 100, seed: int = 42, share: int = 20) -> tuple[PipelineModel, DataFrame]:
    """ML-01: TF-IDF of words and word pairs into a class-weighted linear SVM.

    Texts are lower-cased and lose their accents; words have two characters or more; terms in one row only are left out; counts n weigh
    1 + ln(n), times ln((1 + rows) / (1 + rows with the term)) + 1, and rows have length 1.  Classes weigh alike.  Returns the model, which can be saved, and
    the held-out ``share`` per cent of the rows.
    """
    rows = labelled_rows(df, text, label).withColumn("__test", _held_out(seed, share))
    counts = {(r["__test"], r["label"]): r["n"] for r in rows.groupBy("__test", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    train = {k: n for (test, k), n in counts.items() if not test}
    if sum(counts.values()) < min_rows or len(train) < 2:
        raise ValueError(f"need at least {min_rows} rows of both types, got {counts}")
    n = sum(train.values())
    weight = F.when(F.col("label") == 1, n / (2 * train[1.0])).otherwise(n / (2 * train[0.0]))
    rows = rows.withColumn("weight", weight)
    stages = [
        AccentStripper(inputCol="text", outputCol="__plain"),
        RegexTokenizer(inputCol="__plain", outputCol="__words", pattern=r"(?U)\b\w\w+\b", gaps=False, toLowercase=False),
        NGram(n=2, inputCol="__words", outputCol="__pairs"),
        SQLTransformer(statement="SELECT *, concat(__words, __pairs) AS __terms FROM __THIS__"),
        CountVectorizer(inputCol="__terms", outputCol="__tf", minDF=2, vocabSize=features),
        SublinearTF(inputCol="__tf", outputCol="__log_tf"),
        SmoothIDF(inputCol="__log_tf", outputCol="__tf_idf"),
        Normalizer(p=2.0, inputCol="__tf_idf", outputCol="features"),
        # one unit of loss per weighted row against half the squared weights, as usual for a support vector machine with C = 1
        LinearSVC(featuresCol="features", labelCol="label", weightCol="weight", maxIter=50, regParam=1.0 / n, standardization=False),
    ]
    return Pipeline(stages=stages).fit(rows.filter("not __test").drop("__test")), rows.filter("__test").drop("__test")


def predict_type(model: PipelineModel, df: DataFrame, text: str = "description", margin: bool = False) -> DataFrame:
    """ML-03: predicted type per row, with the signed distance to the separating plane on request."""
    from pyspark.ml.functions import vector_to_array

    rows = df.withColumn("text", F.coalesce(F.col(text), F.lit("")))
    out = model.transform(rows)
    cols = [*df.columns, F.when(F.col("prediction") == 1, "ERROR").otherwise("INFO").alias("predicted_type")]
    if margin:
        cols.append(F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("margin"))
    return out.select(*cols)


def confusion(df: DataFrame, truth: str = "type", predicted: str = "predicted_type") -> DataFrame:
    """ML-02: rows per true and predicted type."""
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("rows_count"))


def class_report(df: DataFrame, truth: str = "type", predicted: str = "predicted_type") -> DataFrame:
    """ML-02: precision, recall, F1 and support per class, from the counts of the confusion table."""
    both = confusion(df, truth, predicted).select(F.explode(F.array(
        F.struct(F.col(truth).alias("cls"), F.col("rows_count").alias("t"), F.lit(0).cast("bigint").alias("p"),
                 F.when(F.col(truth) == F.col(predicted), F.col("rows_count")).otherwise(0).alias("hit")),
        F.struct(F.col(predicted).alias("cls"), F.lit(0).cast("bigint").alias("t"), F.col("rows_count").alias("p"),
                 F.lit(0).cast("bigint").alias("hit")))).alias("r")).select("r.*")
    sums = both.groupBy("cls").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("hit").alias("hit"))
    precision, recall = S.ratio("hit", "predicted"), S.ratio("hit", "support")
    return sums.select("cls", "support", F.coalesce(precision, F.lit(0.0)).alias("precision"),
                       F.coalesce(recall, F.lit(0.0)).alias("recall"),
                       F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0)).alias("f1"))


def predict_with(df: DataFrame, load: Callable[[], Callable[[Sequence[str]], Sequence[str]]],
                 text: str = "description", name: str = "predicted_type", batch: int = 512) -> DataFrame:
    """ML-04: any batch predictor on the raw text; ``load`` runs once per task.

    Distinct texts only are predicted, then joined back.
    """
    @F.pandas_udf(T.StringType())
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in texts:
            out: list[str] = []
            for i in range(0, len(part), batch):
                out.extend(model(part.iloc[i:i + batch].tolist()))
            yield pd.Series(out, dtype="object")

    once = df.select(F.col(text).alias("__t")).filter(F.col("__t").isNotNull()).distinct()
    labels = once.select("__t", predict("__t").alias(name))
    return df.join(labels, F.col(text) == F.col("__t"), "left").drop("__t")


# ── prototypes ───────────────────────────────────────────────────────────────


def nearest_prototype(df: DataFrame, protos: DataFrame, key: str, vec: str = "embedding", label: str = "label",
                      by: str | None = None, k: int = 2, block: int = 4096) -> DataFrame:
    """ML-05: best and second-best prototype of every vector by cosine, 6 decimals; ties go to the smaller label.  ``k`` <= 2.

    Rows of a type without prototypes are left out (without ``by`` they have no label); a null vector and one of length 0 have no label, prototypes like that and without label take no part.  A type's prototypes are scored in blocks.
    """
    work = df.withColumn("__g", F.col(by) if by else F.lit(0))
    known = protos.select((F.col(by) if by else F.lit(0)).alias("__g"), F.col(label).alias("label"), F.col(vec).alias("v"))
    rows, top = nearest_in_blocks(work, known, vec, k, block)
    out = [key, *([by] if by else [])]
    for i, name in enumerate(["best", "second"][:k]):
        out += [F.get("top", F.lit(i))["label"].alias(f"{name}_label"), (-F.get("top", F.lit(i))["neg"]).alias(f"{name}_score")]
    kept = rows.join(known.select("__g").distinct(), "__g", "left_semi") if by else rows
    return kept.join(top, "__id", "left").select(*out)


# ── cascade ──────────────────────────────────────────────────────────────────


def classify(df: DataFrame, pattern_map: DataFrame, model_type: Column | Callable[[DataFrame], DataFrame],
             priority_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """ML-06: type and priority of every event.

    The template's exact map row decides both; otherwise the model types the raw text and
    the priority comes from ``priority_of``, called once on the distinct (pattern, type)
    pairs of the misses.  ``model_type`` is an expression or a function adding ``model_type``.
    """
    rows = df.drop("type", "priority").withColumn("pattern", X.normalize_description("description"))
    pm = pattern_map.select(F.col("description_pattern").alias("pattern"), F.col("type").alias("__type"),
                            F.col("priority").alias("__prio"))
    joined = rows.join(pm, "pattern", "left")
    joined = joined.withColumn("model_type", model_type) if isinstance(model_type, Column) else model_type(joined)
    typed = joined.withColumns({
        "matched_via": F.when(F.col("__type").isNotNull(), "map").otherwise("model"),
        "type": F.coalesce("__type", "model_type")})
    if priority_of is None:
        return typed.withColumn("priority", F.col("__prio")).drop("__type", "__prio", "model_type")
    misses = typed.filter(F.col("matched_via") == "model").select("pattern", "type").distinct()
    prios = priority_of(misses).select("pattern", "type", F.col("priority").alias("__miss"))
    return (typed.join(prios, ["pattern", "type"], "left").withColumn("priority", F.coalesce("__prio", "__miss"))
            .drop("__type", "__prio", "__miss", "model_type"))


def classify_counts(classified: DataFrame) -> DataFrame:
    """ML-06: rows matched by the map and left to the model."""
    return classified.groupBy("matched_via").agg(F.count(F.lit(1)).alias("rows_count"))


def new_patterns(classified: DataFrame, pattern_map: DataFrame) -> DataFrame:
    """ML-07: patterns the map lacks, with the code and text of their first row."""
    fresh = classified.join(pattern_map.select(F.col("description_pattern").alias("pattern")), "pattern", "left_anti")
    first = F.min_by(F.struct("code", "description"), F.struct("ts", "device_id", "description"))
    return (fresh.groupBy("pattern", "type", "priority").agg(first.alias("h"))
            .select(F.col("pattern").alias("description_pattern"), "type", "priority", F.col("h.code").alias("code"),
                    F.col("h.description").alias("sample_description")))
