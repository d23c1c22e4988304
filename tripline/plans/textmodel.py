"""Stages of the type model that Spark ML lacks (ML-01): accents off, 1 + ln(tf), smoothed IDF + 1.  They are saved and loaded with their pipeline."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.feature import IDF, ElementwiseProduct
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strip_accents(text: str) -> str:
    """Compatibility form without combining marks."""
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


class _Columns(HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A stage from one column to another."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)


class AccentStripper(_Columns, Transformer):
    """Lower-case text without accents; null counts as empty."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        @F.pandas_udf("string")
        def strip(texts: pd.Series) -> pd.Series:
            return pd.Series([strip_accents(t) for t in texts], dtype="object")

        return dataset.withColumn(self.getOutputCol(), strip(F.lower(F.coalesce(F.col(self.getInputCol()), F.lit("")))))


class SublinearTF(_Columns, Transformer):
    """Term counts n as 1 + ln(n); vectors stay sparse.  Vectors travel in Arrow batches."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        @F.udf(VectorUDT(), useArrow=True)
        def scale(v):
            return None if v is None else SparseVector(v.size, v.indices, 1.0 + np.log(v.values))

        return dataset.withColumn(self.getOutputCol(), scale(F.col(self.getInputCol())))


class SmoothIDF(_Columns, Estimator):
    """Fits ln((1 + n) / (1 + df)) + 1 per term; the model is a plain product with these weights."""

    def _fit(self, dataset: DataFrame) -> ElementwiseProduct:
        weights = IDF(inputCol=self.getInputCol(), outputCol="__idf").fit(dataset).idf.toArray() + 1.0
        return ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol=self.getInputCol(), outputCol=self.getOutputCol())
