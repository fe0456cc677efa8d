"""Vectors in array columns: products, norms, softmax pieces, pooling of token vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast, if they hold no more than a short array each.
SMALL = 50_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df marked for broadcast if it has at most `rows` rows (counted); beyond that the planner chooses."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def normalise(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def l1_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference of two vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def mean_vector(rows: DataFrame, keys: list[str], vector: str = "embedding", out: str = "vector") -> DataFrame:
    """(keys, out): the mean of each key's vectors, by dimension."""
    each = rows.select(*keys, F.posexplode(vector).alias("_k", "_v")).groupBy(*keys, "_k").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_m"))), lambda x: x["_m"]).alias(out))


def class_vectors(prompts: DataFrame, keys: list[str], vector: str = "embedding", out: str = "vector") -> DataFrame:
    """Prompt ensembling: the normalised mean of each class's normalised prompt vectors."""
    unit = prompts.select(*keys, normalise(F.col(vector)).alias("_u"))
    return mean_vector(unit, keys, "_u", out).withColumn(out, normalise(F.col(out)))


def stacked(descriptions: DataFrame, keys: list[str], order: str, vector: str = "embedding", out: str = "vectors") -> DataFrame:
    """(keys, out): each class's normalised description vectors in order, without a mean."""
    return descriptions.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), normalise(F.col(vector)).alias("_u")))), lambda x: x["_u"]).alias(out))


def softmax_pooled(rows: DataFrame, keys: list[str], score: str, vector: str = "embedding", out: str = "vector") -> DataFrame:
    """(keys, out): the mean of each key's vectors, weighted by the softmax of their scores within the key."""
    by = Window.partitionBy(*keys)
    weighed = rows.withColumn("_w", F.exp(F.col(score) - F.max(score).over(by)))
    each = weighed.select(*keys, "_w", F.posexplode(vector).alias("_k", "_v")).groupBy(*keys, "_k").agg((F.sum(F.col("_w") * F.col("_v").cast("double")) / F.sum("_w")).alias("_m"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_m"))), lambda x: x["_m"]).alias(out))


def pooled(tokens: DataFrame, keys: list[str], kind: str = "mean", position: str = "pos", vector: str = "embedding", mask: str | None = None, token: str | None = None, out: str = "vector") -> DataFrame:
    """(keys, out): one vector of each key's token vectors. mean and max take the tokens whose mask is 1 (all without a mask); first and last go by position; argmax takes the token with
    the largest id, the first of several."""
    if kind in ("mean", "max"):
        rows = tokens.where(F.col(mask) == 1) if mask else tokens
        agg = F.avg if kind == "mean" else F.max
        each = rows.select(*keys, F.posexplode(vector).alias("_k", "_v")).groupBy(*keys, "_k").agg(agg(F.col("_v").cast("double")).alias("_m"))
        return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_m"))), lambda x: x["_m"]).alias(out))
    orders = {"first": F.struct(position), "last": F.struct((-F.col(position)).alias("p"))}
    if kind == "argmax" and token:
        orders["argmax"] = F.struct((-F.col(token)).alias("t"), position)
    if kind not in orders:
        raise ValueError(f"no pooling {kind}")
    return tokens.groupBy(*keys).agg(F.min_by(F.col(vector).cast("array<double>"), orders[kind]).alias(out))


def sincos_positions(spark: SparkSession, length: int, dims: int, base: float = 10_000.0) -> DataFrame:
    """(pos, dim, value): the sine half and then the cosine half of a position table of `dims` (even) columns."""
    half = dims // 2
    at = spark.range(length).select(F.col("id").alias("pos")).crossJoin(spark.range(dims).select(F.col("id").cast("int").alias("dim")))
    angle = F.col("pos") * F.exp(F.lit(-math.log(base)) * (F.col("dim") % half) / half)
    return at.select("pos", "dim", F.when(F.col("dim") < half, F.sin(angle)).otherwise(F.cos(angle)).alias("value"))


def sincos_grid(spark: SparkSession, side: int, dims: int, base: float = 10_000.0) -> DataFrame:
    """(row, col, dim, value) of a square grid: the first half of the columns tells the column's place, the second the row's."""
    half = sincos_positions(spark, side, dims // 2, base)
    across = half.select(F.col("pos").alias("col"), "dim", "value").crossJoin(spark.range(side).select(F.col("id").alias("row")))
    down = half.select(F.col("pos").alias("row"), (F.col("dim") + dims // 2).alias("dim"), "value").crossJoin(spark.range(side).select(F.col("id").alias("col")))
    return across.select("row", "col", "dim", "value").unionByName(down)
