"""From raw documents to packed training sequences: quality rules, language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's documents.
Empty tables, null and repeated rows and extra columns of any name pass through all stages; what each does with them is said at the operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripline.llm import language_id, near_dedup, packing, quality_rules, suffix_dedup
from tripline.llm.text import prepare, table

#: Packing and the models have no SQL; tests/llm/test_pipeline.py works the stages out plainly.
ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines read as content; the model learns from the labels of these documents."""
    labels = prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality_rules.keep_good(docs, quality_rules.train(docs, labels))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language."""
    prepare(spark)
    return language_id.keep_known(docs, lambda: language_id.train(docs.select("text", "lang")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class of near duplicates."""
    prepare(spark)
    return near_dedup.keep_first(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller id holds."""
    prepare(spark)
    return suffix_dedup.without_repeats(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of at most 1024 ids."""
    prepare(spark)
    return packing.pack(docs)[1]


STAGES = [("quality rules", rules), ("language ID", language), ("near duplicates", near_duplicates), ("suffix-array dedup", passages), ("best-fit packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(prepare(spark), docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = table(docs)
    return docs
