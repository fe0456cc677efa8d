"""Losses of training steps as aggregates over tables of vectors, logits and tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.similarity import block_products
from tessera.functions.vector import sigmoid, softplus


def contrastive(images: DataFrame, texts: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(loss): the mean over pairs of half the cross entropies of an image among all texts and a text among all images. Sums of exponentials are kept against their block's maximum."""

    def part(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        z = scale * s
        top = [z.max(axis=1), z.max(axis=0)]
        total = [np.exp(z - top[0][:, None]).sum(axis=1), np.exp(z - top[1][None, :]).sum(axis=0)]
        own = np.where(a[:, None] == b[None, :], z, 0.0)
        names = pa.array(["a"] * len(a) + ["b"] * len(b))
        columns = [names, pa.array(np.concatenate([a, b])), pa.array(np.concatenate(top)), pa.array(np.concatenate(total)), pa.array(np.concatenate([own.sum(axis=1), own.sum(axis=0)]))]
        return pa.RecordBatch.from_arrays(columns, ["side", "id", "top", "total", "own"])

    parts = block_products(images, texts, part, "side string, id long, top double, total double, own double", (key, vector, key, vector))
    tops = parts.groupBy("side", "id").agg(F.max("top").alias("top"), F.sum("own").alias("own"), F.collect_list(F.struct("top", "total")).alias("parts"))
    total = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["total"] * F.exp(p["top"] - F.col("top")))
    return tops.agg((F.avg(F.col("top") + F.log(total) - F.col("own"))).alias("loss"))


def sigmoid_pairs(images: DataFrame, texts: DataFrame, key: str, vector: str, scale: float, bias: float) -> DataFrame:
    """(loss): the sum over all pairs of softplus(-label x logit), label 1 for own pairs and -1 for others, by the number of images."""

    def part(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        z = (scale * s + bias) * np.where(a[:, None] == b[None, :], -1.0, 1.0)
        return pa.RecordBatch.from_arrays([pa.array([float(np.logaddexp(0, z).sum())])], ["part"])

    total = block_products(images, texts, part, "part double", (key, vector, key, vector)).agg(F.sum("part").alias("s"))
    return total.crossJoin(images.agg(F.count(F.lit(1)).alias("n"))).select((F.col("s") / F.col("n")).alias("loss"))


def log_softmax(x: Column, by: Window) -> Column:
    top = F.max(x).over(by)
    return x - top - F.log(F.sum(F.exp(x - top)).over(by))


def distillation(rows: DataFrame, key: str, teacher: str, student: str) -> DataFrame:
    """(loss): minus the mean over keys of sum softmax(teacher) x log softmax(student). The maximum is subtracted first, so large logits don't overflow."""
    w = Window.partitionBy(key)
    each = rows.withColumn("_t", F.exp(log_softmax(F.col(teacher), w))).withColumn("_s", log_softmax(F.col(student), w))
    return each.agg((-F.sum(F.col("_t") * F.col("_s")) / F.countDistinct(key)).alias("loss"))


def asymmetric(rows: DataFrame, logit: Column, positive: Column, gamma_neg: float = 4.0, gamma_pos: float = 1.0, clip: float = 0.05, eps: float = 1e-8) -> DataFrame:
    """(loss): multi-label loss that focuses on hard rows, with the probability of negatives shifted by clip."""
    p = sigmoid(logit)
    n = F.least(1 - p + clip, F.lit(1.0))
    one = F.when(positive, F.log(F.greatest(p, F.lit(eps))) * F.pow(1 - p, F.lit(gamma_pos))).otherwise(F.log(F.greatest(n, F.lit(eps))) * F.pow(1 - n, F.lit(gamma_neg)))
    return rows.agg((-F.sum(one)).alias("loss"))


def caption_entropy(tokens: DataFrame, keys: list[str], logit: str, candidate: str, target: str, pad: int = 0, weight: float = 1.0) -> DataFrame:
    """(loss): weight x the mean cross entropy of the target over positions (keys) whose target isn't pad; a row for each position and candidate."""
    w = Window.partitionBy(*keys)
    each = tokens.withColumn("_l", log_softmax(F.col(logit), w)).where((F.col(candidate) == F.col(target)) & (F.col(target) != pad))
    return each.agg((-weight * F.avg("_l")).alias("loss"))


def weighted_mean(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """(keys, mean) by weight; null where all weights are 0."""
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"))


def rate(step: Column, base: float, warmup: int, steps: int, kind: str = "cosine", cooldown: int = 0, power: float = 1.0, end: float = 0.0) -> Column:
    """The learning rate at a step: a linear warm-up, then cosine, const, or const with a polynomial fall to `end` over the last `cooldown` steps."""
    warm = base * (step + 1) / warmup if warmup else F.lit(base)
    after = {
        "const": F.lit(base),
        "cosine": 0.5 * (1 + F.cos(F.pi() * (step - warmup) / float(steps - warmup))) * base,
        "cooldown": F.when(step < steps - cooldown, F.lit(base)).otherwise(F.pow(1 - (step - (steps - cooldown)) / float(max(1, cooldown)), F.lit(power)) * (base - end) + end),
    }
    if kind not in after:
        raise ValueError(f"no schedule {kind}")
    return F.when(step < warmup, warm).otherwise(after[kind])


__all__ = ["asymmetric", "caption_entropy", "contrastive", "distillation", "log_softmax", "rate", "sigmoid_pairs", "softplus", "weighted_mean"]
