"""Mixing sources to target weights by subset-sum budget fitting.

Each source has a budget of words. Whole passes over the source use it up as far as they go; for
the rest, its documents are counted by exact length, a share of each length is taken in proportion,
and a bounded-knapsack dynamic programme picks how many more of which lengths meet what is left of the budget.
Which documents of a length are taken is decided by a seeded hash order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import hashed_rank, read, written

WEIGHTS = (1, 2, 3)
MOST = 3
#: Budgets up to this many words are met by dynamic programming; before that, single documents are taken from the longest length down.
EXACT = 65_536
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with size: the number of words (runs of anything but ASCII white space); null texts have none."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD))
    return docs.withColumn("size", words.cast("long"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) with target. One row a source comes in, so its one task reads no more rows than there are sources.

    Capping at most x size and resharing the excess by weight until none is above ends at
    min(most x size, level x weight) for one level: sources are filled in the order of cap / weight.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    n = F.row_number().over(order) - 1
    by = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("weight", F.element_at(by, (n % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, after, whole = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("open", F.col("level") < F.col("cap") / F.col("weight"))
    s = s.withColumn("final", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    capped = F.col("final").isNull() | (F.col("cap") <= F.col("final") * F.col("weight"))
    return s.select("source", "source_size", F.when(capped, F.col("cap")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, exact: int = EXACT) -> np.ndarray:
    """How many documents of each length to take (at most counts) so that the words come as near to budget from below as found.

    First a proportional share of each length, then single documents from the longest length down, then a
    bounded knapsack over what is left of the budget (bitsets of reachable sums).
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return np.where(lengths > 0, counts, 0)
    if budget <= 0:
        return np.zeros(len(lengths), np.int64)
    shared = max(0, budget - min(exact // 2, 4 * int(lengths.max())))  # what is kept back lets the programme meet the budget
    taken = np.array([int(c) * shared // total for c in counts.tolist()], np.int64)
    left = budget - int((lengths * taken).sum())
    for k in np.argsort(-lengths, kind="stable").tolist():
        if left <= exact:
            break
        if lengths[k] > 0:
            more = min(int(counts[k] - taken[k]), 1, left // int(lengths[k]))
            taken[k] += more
            left -= more * int(lengths[k])
    for k in np.argsort(-lengths, kind="stable").tolist():  # a share of one for each length may not have sufficed
        if left <= exact:
            break
        if lengths[k] > 0:
            more = min(int(counts[k] - taken[k]), left // int(lengths[k]))
            taken[k] += more
            left -= more * int(lengths[k])
    left = min(left, int((lengths * (counts - taken)).sum()))
    window = (1 << (left + 1)) - 1
    reached, steps = 1, []
    for k in np.argsort(lengths, kind="stable").tolist():
        size = int(lengths[k])
        if not 0 < size <= left or reached >> left & 1:
            continue
        free, chunk = min(int(counts[k] - taken[k]), left // size), 1
        while free > 0:  # counts in powers of two
            chunk = min(chunk, free)
            steps.append((k, chunk, reached))
            reached |= (reached << (size * chunk)) & window
            free, chunk = free - chunk, chunk * 2
    at = reached.bit_length() - 1
    for k, chunk, before in reversed(steps):
        if not before >> at & 1:
            taken[k] += chunk
            at -= chunk * int(lengths[k])
    return taken


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """One row per document: id, source, mark (a hash of the text), size, source_size, target, passes (times it is taken), taken (= passes x size).

    Null sources are one source, ranked last; null texts have size 0 and are never taken; rows with equal ids are rows of their own.
    """
    rows = written(sized(docs, text).select(F.col(id_col).alias("id"), F.col(source).alias("source"), "size", F.xxhash64(text).alias("_mark")), "sized", few=True)
    by_length = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths", few=True)
    sources = by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    budget = written(targets(sources, weights, most).withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")), "targets")

    def chosen(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size")
        rest = int(round(part["target"].iloc[0] - part["passes"].iloc[0] * part["source_size"].iloc[0]))
        rest = 0 if part["passes"].iloc[0] >= most else rest
        return part.assign(extra=fit(part["size"].to_numpy(), part["n"].to_numpy(), rest))[["source", "size", "source_size", "target", "passes", "extra"]]

    plan = by_length.join(budget.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = written(plan.groupBy("source").applyInPandas(chosen, "source string, size long, source_size long, target double, passes long, extra long"), "plan")
    n = by_length.agg(F.sum("n")).first()[0] or 0
    ranked = hashed_rank(rows, ["source", "size"], ["id", "_mark"], n, seed)
    p = plan.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "source_size", "target", "passes", "extra")
    joined = ranked.join(p, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    passes = F.when(F.col("size") > 0, F.col("passes") + (F.col("rank") < F.col("extra")).cast("long")).otherwise(0)
    return joined.select("id", "source", F.col("_mark").alias("mark"), "size", "source_size", "target", passes.alias("passes"), (passes * F.col("size")).alias("taken"))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
