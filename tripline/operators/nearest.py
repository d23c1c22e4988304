"""Nearest prototypes by cosine, exact, in blocks of prototypes that are skipped by an angle bound."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripline.session import settle

#: Vectors of one group of a task, and the fewest that are worth a group of their own.
GROUP_ROWS, LEAST_ROWS = 100_000, 2_000
#: Room for what rounding may add to a cosine.
ROOM = 1e-9


def _unit(rows: pd.Series | list) -> np.ndarray:
    """Vectors brought to length 1."""
    m = np.array([np.asarray(x, float) for x in rows])
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _has_length(v: str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) > 0


def _signature(v: str, bits: Column) -> Column:
    """Which side of ``bits`` fixed planes a vector lies on: like vectors mostly agree."""
    side = lambda j: F.aggregate(F.zip_with(v, F.sequence(F.lit(1), F.size(v)), lambda x, i: x.cast("double") * F.when(F.pmod(F.xxhash64(i, j), F.lit(2)) == 0, 1).otherwise(-1)), F.lit(0.0), lambda s, x: s + x)
    return F.when(bits > 0, F.aggregate(F.transform(F.sequence(F.lit(0), bits - 1), lambda j: F.when(side(j) > 0, F.pow(F.lit(2.0), j)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def prototype_blocks(protos: DataFrame, block: int) -> DataFrame:
    """(__g, blk, labels, vecs, center, reach): the prototypes of each group in blocks of about ``block``; every one lies within the angle ``reach`` of its center."""
    size = protos.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))
    bits = F.greatest(F.ceil(F.log2(F.col("__n") / block)), F.lit(0)).cast("int")
    signed = protos.join(size, "__g").withColumn("sig", _signature("v", bits)).drop("__n")
    many = signed.groupBy("__g", "sig").agg(F.ceil(F.count(F.lit(1)) / block).alias("__m"))
    cut = signed.join(many, ["__g", "sig"]).withColumn("blk", F.concat_ws("-", F.col("sig").cast("bigint"), F.pmod(F.xxhash64("label", "v"), F.col("__m"))))

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        unit = _unit(pdf["v"])
        middle = unit.sum(axis=0)
        length = math.sqrt(float(middle @ middle))
        center = middle / length if length > 0 else middle
        # a center without direction bounds nothing
        reach = math.pi if length == 0 else float(np.arccos(np.clip((unit @ center).min(), -1, 1)))
        return pd.DataFrame({"__g": [pdf["__g"].iloc[0]], "blk": [pdf["blk"].iloc[0]], "labels": [pdf["label"].tolist()], "vecs": [pdf["v"].tolist()], "center": [center.tolist()], "reach": [reach]})

    numbers = T.ArrayType(T.DoubleType())
    kinds = T.StructType([protos.schema["__g"], T.StructField("blk", T.StringType()), T.StructField("labels", T.ArrayType(protos.schema["label"].dataType)), T.StructField("vecs", T.ArrayType(numbers)),
                          T.StructField("center", numbers), T.StructField("reach", T.DoubleType())])
    return cut.select("__g", "blk", "label", F.col("v").cast("array<double>").alias("v")).groupBy("__g", "blk").applyInPandas(cell, kinds)


def nearest_in_blocks(df: DataFrame, protos: DataFrame, vec: str, k: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` (with ``__g``) numbered by ``__id``, and (__id, top): the ``k`` best (neg, label) by cosine rounded to 6 decimals, negated, then label.

    A vector meets the block whose center is nearest first.  Of the others it meets those that could hold something as good as its k-th so far: the angle to
    the center less the block's reach bounds every cosine in it.  What two blocks found is merged; no task sees all prototypes, and no row carries them.
    """
    rows = settle(df.withColumn("__id", F.monotonically_increasing_id()))
    vectors = rows.select("__id", "__g", F.col(vec).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & _has_length("v"))
    cells = settle(prototype_blocks(protos.filter(F.col("v").isNotNull() & F.col("label").isNotNull() & _has_length("v")), block))
    n = vectors.count()
    salts = max(1, -(-n // GROUP_ROWS), min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), n // LEAST_ROWS))
    label = protos.schema["label"].dataType.simpleString()
    found = f"__id bigint, __g {vectors.schema['__g'].dataType.simpleString()}, top array<struct<neg:double,label:{label}>>"
    salted = lambda d: d.withColumn("__salt", F.pmod("__id", F.lit(salts)))
    every = lambda d: d.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))

    def score(cell: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if not len(cell) or not len(some):
            return pd.DataFrame([], columns=["__id", "__g", "top"], dtype="object")
        labels = np.array(cell["labels"].iloc[0], dtype=object)
        rank = np.argsort(np.argsort(labels, kind="stable"), kind="stable")
        right = _unit(cell["vecs"].iloc[0])
        tops = []
        for lo in range(0, len(some), 1024):
            left = _unit(some["v"].iloc[lo : lo + 1024])
            neg = -np.round(left @ right.T, 6)
            for line in neg:
                best = np.flatnonzero(line <= np.partition(line, min(k, len(line)) - 1)[min(k, len(line)) - 1])
                best = best[np.lexsort((rank[best], line[best]))][:k]
                tops.append([{"neg": float(line[i]), "label": labels[i]} for i in best])
        return pd.DataFrame({"__id": some["__id"].to_numpy(), "__g": pd.Series(some["__g"].tolist(), dtype="object"), "top": pd.Series(tops, dtype="object")})

    def scored(pairs: DataFrame) -> DataFrame:
        by = ["__g", "blk", "__salt"]
        again = pairs.select(*[F.col(c).alias(c) for c in pairs.columns])  # names of its own, where both sides come from one table
        return every(cells).groupBy(*by).cogroup(salted(again).groupBy(*by)).applyInPandas(score, found)

    if cells.groupBy("__g").count().filter("count > 1").isEmpty():
        return rows, scored(vectors.join(cells.select("__g", "blk"), "__g")).select("__id", "top")
    centers = cells.select("__g", "blk", "center", "reach")

    def route(first: bool):
        def run(near: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
            if not len(near) or not len(some):
                return pd.DataFrame([], columns=["__id", "__g", "blk"], dtype="object")
            names, reach = near["blk"].to_numpy(), near["reach"].to_numpy()
            middle = np.array([np.asarray(c, float) for c in near["center"]])
            out_id, out_blk = [], []
            for lo in range(0, len(some), 1024):
                part = some.iloc[lo : lo + 1024]
                left = _unit(part["v"])
                away = np.arccos(np.clip(left @ middle.T, -1, 1))
                bound = np.where(reach >= math.pi, 1.0, np.cos(np.clip(away - reach - ROOM, 0, math.pi))) + ROOM
                if first:
                    hit = np.zeros(bound.shape, bool)
                    hit[np.arange(len(part)), away.argmin(axis=1)] = True
                else:
                    hit = (np.round(bound + 5e-7, 6) >= part["floor"].to_numpy()[:, None]) & (names[None, :] != part["done"].to_numpy()[:, None])
                i, j = np.nonzero(hit)
                out_id.append(part["__id"].to_numpy()[i])
                out_blk.append(names[j])
            ids = np.concatenate(out_id)
            return pd.DataFrame({"__id": ids, "__g": pd.Series([some["__g"].iloc[0]] * len(ids), dtype="object"), "blk": pd.Series(np.concatenate(out_blk).tolist(), dtype="object")})

        return run

    def routed(some: DataFrame, first: bool) -> DataFrame:
        kinds = T.StructType([T.StructField("__id", T.LongType()), vectors.schema["__g"], T.StructField("blk", T.StringType())])
        by = ["__g", "__salt"]
        again = some.select(*[F.col(c).alias(c) for c in some.columns])
        return every(centers).groupBy(*by).cogroup(salted(again).groupBy(*by)).applyInPandas(route(first), kinds)

    start = settle(routed(vectors, True))
    one = settle(scored(vectors.join(start.select("__id", "blk"), "__id")))
    floor = F.when(F.size("top") >= k, -F.get("top", F.lit(k - 1))["neg"]).otherwise(-2.0)
    more = routed(vectors.join(one.select("__id", floor.alias("floor")), "__id").join(start.select("__id", F.col("blk").alias("done")), "__id"), False)
    rest = scored(vectors.join(more.select("__id", "blk"), "__id"))
    both = one.unionByName(rest).groupBy("__id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    return rows, both
