"""Evaluation metrics over tables of scores. Ties are broken by the candidate's key, so results don't depend on the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.similarity import true_ranks
from tessera.functions.vector import cosine, small


def class_scores(items: DataFrame, classes: DataFrame, vector: str = "embedding", class_vector: str = "vector") -> DataFrame:
    """items x classes with score, the cosine. Classes are few; they are broadcast where their number allows."""
    return items.crossJoin(small(classes)).withColumn("score", cosine(F.col(vector), F.col(class_vector)))


def probabilities(scores: DataFrame, key: str, score: str = "score", scale: float = 100.0) -> DataFrame:
    """scores with probability: the softmax of scale x score within the key."""
    by = Window.partitionBy(key)
    top = F.max(score).over(by)
    e = F.exp(scale * (F.col(score) - top))
    return scores.withColumn("probability", e / F.sum(e).over(by))


def top_k(scores: DataFrame, key: str, candidate: str, score: str, k: int) -> DataFrame:
    """The k best candidates of each key, with rk."""
    by = Window.partitionBy(key).orderBy(F.col(score).desc(), candidate)
    return scores.withColumn("rk", F.row_number().over(by)).where(F.col("rk") <= k)


def accuracy(scores: DataFrame, key: str, candidate: str, score: str, target: str, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """(top1, top5, ...): the share of keys whose target is among the k best."""
    by = Window.partitionBy(key).orderBy(F.col(score).desc(), candidate)
    own = scores.withColumn("rk", F.row_number().over(by)).where(F.col(candidate) == F.col(target))
    return own.agg(*[F.avg((F.col("rk") <= k).cast("double")).alias(f"top{k}") for k in ks])


def retrieval(images: DataFrame, texts: DataFrame, key: str, vector: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(direction, mean_rank, median_rank, r1, ...) of image_to_text and text_to_image; own pairs have equal keys."""
    place = true_ranks(images, texts, key, vector)
    recall = [F.avg((F.col("place") < k).cast("double")).alias(f"r{k}") for k in ks]
    return place.groupBy("direction").agg((F.avg("place") + 1).alias("mean_rank"), (F.floor(F.percentile("place", F.lit(0.5))) + 1).cast("double").alias("median_rank"), *recall)


def average_precision(rows: DataFrame, label: str, item: str, score: str, hit: Column, eps: float = 1e-8) -> DataFrame:
    """(label, ap): the mean precision at the hits, by score and then item."""
    w = Window.partitionBy(label).orderBy(F.col(score).desc(), item)
    o = rows.withColumn("_hit", hit.cast("int")).select(label, "_hit", F.row_number().over(w).alias("_pos"), F.sum("_hit").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_cum"))
    return o.groupBy(label).agg((F.sum(F.col("_hit") * F.col("_cum") / F.col("_pos")) / (F.sum("_hit") + eps)).alias("ap"))


def mean_average_precision(rows: DataFrame, label: str, item: str, score: str, hit: Column) -> DataFrame:
    return average_precision(rows, label, item, score, hit).agg(F.avg("ap").alias("mean_ap"))


def precision_recall(rows: DataFrame, label: str, said: Column, true: Column, eps: float = 1e-9) -> DataFrame:
    """(label, precision, recall)."""
    c = rows.groupBy(label).agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"))
    return c.select(label, (F.col("tp") / (F.col("tp") + F.col("fp") + eps)).alias("precision"), (F.col("tp") / (F.col("tp") + F.col("fn") + eps)).alias("recall"))


def macro(per_label: DataFrame) -> DataFrame:
    """The mean precision and recall over labels."""
    return per_label.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))


def running_mean(rows: DataFrame, keys: list[str], order: list[str], value: str, weight: str, out: str = "avg", reset: str | None = None) -> DataFrame:
    """rows with the weighted mean of all rows of the key up to this one; null while the weights sum to 0. A true `reset` starts anew with its row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    by = keys
    if reset:
        rows, by = rows.withColumn("_round", F.sum(F.col(reset).cast("int")).over(w)), [*keys, "_round"]
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    done = rows.withColumn(out, F.try_divide(F.sum(F.col(value) * F.col(weight)).over(w), F.sum(weight).over(w)))
    return done.drop("_round") if reset else done


def throughput(steps: DataFrame, batch: str, seconds: str, world: int = 1, accumulated: int = 1) -> DataFrame:
    """steps with samples_per_second and samples_per_second_per_worker."""
    total = F.try_divide(F.col(batch) * (accumulated * world), F.col(seconds))
    return steps.withColumns({"samples_per_second": total, "samples_per_second_per_worker": total / world})


def counts(rows: DataFrame, keys: list[str], batch: int) -> DataFrame:
    """(keys, samples, batches, whole_batches)."""
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(n.alias("samples"), F.ceil(n / batch).alias("batches"), F.floor(n / batch).alias("whole_batches"))
