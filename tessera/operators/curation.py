"""Concept-aware sub-batch selection: targets, frequency ranking, greedy diversity."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sub_batch_size(n: Column, filter_ratio: float = 0.8) -> Column:
    """The power of two nearest, in logarithms, to what the filter leaves of n."""
    return F.when(n > 0, F.pow(F.lit(2.0), F.rint(F.log2((1 - filter_ratio) * n)))).otherwise(0).cast("int")


def frequency_select(samples: DataFrame, group: str = "sb", filter_ratio: float = 0.8) -> DataFrame:
    """The samples of each group with the most concepts (repeats count), by idx where equal; as many as its sub-batch size. Adds n_concepts and rk."""
    by = Window.partitionBy(group)
    ranked = samples.withColumn("n_concepts", F.size("classes").cast("long")).withColumns({
        "rk": F.row_number().over(by.orderBy(F.col("n_concepts").desc(), "idx")).cast("long"),
        "target": sub_batch_size(F.count(F.lit(1)).over(by), filter_ratio),
    })
    return ranked.where("rk <= target")


def concept_frequency(samples: DataFrame, group: str = "sb") -> DataFrame:
    """(group, concept, freq): how many samples have the concept."""
    return samples.select(group, F.explode(F.array_distinct("classes")).alias("concept")).groupBy(group, "concept").agg(F.count(F.lit(1)).alias("freq"))


def concept_neighbours(samples: DataFrame, group: str = "sb") -> DataFrame:
    """(group, idx, neighbours): how many other samples of the group share a concept with the sample, where any do. Each concept's members are listed once, at most a group long, and the lists of a sample united: no row for each pair."""
    each = samples.select(group, "idx", F.explode(F.array_distinct("classes")).alias("concept"))
    members = each.groupBy(group, "concept").agg(F.collect_set("idx").alias("members"))
    united = each.join(members, [group, "concept"]).groupBy(group, "idx").agg(F.array_distinct(F.flatten(F.collect_list("members"))).alias("near"))
    return united.select(group, "idx", (F.size("near") - 1).cast("long").alias("neighbours")).where("neighbours > 0")


def concept_targets(frequency: DataFrame, budget: DataFrame, group: str = "sb", cap: int = 10, least: int = 1) -> DataFrame:
    """(group, concept, freq, concept_id, target): an even share of the group's budget T for each concept in name order, capped and scaled down where the sum is over T."""
    by = Window.partitionBy(group)
    d = frequency.join(budget, group).withColumn("concept_id", (F.row_number().over(by.orderBy("concept")) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(by))
    d = d.withColumn("base", F.least(F.expr("T div n"), F.lit(cap))).withColumn("first", F.greatest(F.least(F.col("base") + ((F.col("concept_id") < F.col("T") % F.col("n")) & (F.col("base") < cap)).cast("long"), F.lit(cap)), F.lit(least)))
    total = F.sum("first").over(by)
    scaled = F.greatest(F.lit(1), F.least(F.floor(F.col("first") * F.col("T") / total), F.lit(cap)))
    return d.select(group, "concept", "freq", "concept_id", F.when(total > F.col("T"), scaled).otherwise(F.col("first")).cast("long").alias("target"))


def initial_gain(samples: DataFrame, targets: DataFrame, group: str = "sb") -> DataFrame:
    """(group, idx, gain) before anything is selected: the mean over listed concepts of 1 + 1 / frequency (targets are at least 1)."""
    each = samples.select(group, "idx", F.explode("classes").alias("concept")).join(targets, [group, "concept"])
    return each.groupBy(group, "idx").agg(F.avg(F.when(F.col("target") > 0, 1 + 1 / F.greatest(F.lit(1.0), F.col("freq").cast("double"))).otherwise(-0.5)).alias("gain"))


def greedy(classes: list[list[int]], freq: np.ndarray, target: np.ndarray, size: int, cap: int) -> list[int]:
    """Exact greedy choice of `size` rows: the largest mean gain first, then the smallest index. A concept that reaches cap bars its rows. Gains only fall, so stale heap entries are re-queued."""
    count = np.zeros(len(freq), np.int64)

    def gain(own: list[int]) -> float | None:
        value = 0.0
        for c in own:
            if count[c] >= cap:
                return None
            value += (target[c] - count[c]) / max(1, target[c]) + 1 / max(1, freq[c]) if count[c] < target[c] else -0.5
        return value / len(own)

    heap = [(-g, i) for i, own in enumerate(classes) if own and (g := gain(own)) is not None]
    heapq.heapify(heap)
    picked: list[int] = []
    while heap and len(picked) < size:
        negative, i = heapq.heappop(heap)
        now = gain(classes[i])
        if now is None:
            continue
        if -now > negative:
            heapq.heappush(heap, (-now, i))
            continue
        picked.append(i)
        for c in classes[i]:
            count[c] += 1
    return picked


def diversity_select(samples: DataFrame, targets: DataFrame, group: str = "sb", world: int = 1, filter_ratio: float = 0.8, cap: int = 10, seed: int = 0) -> DataFrame:
    """(group, rank, idx, pick) of each rank's greedy choice against its group's targets; rows without concepts fill up in a seeded order.

    A group and rank is one super-batch's share, a few thousand rows; groups run in parallel.
    """
    each = samples.withColumn("rank", (F.col("idx") % world).cast("int"))
    ready = each.withColumn("fill", F.xxhash64(F.lit(seed), group, "idx")).select(group, "rank", "idx", "classes", "fill")
    sizes = each.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    ranks = F.explode(F.sequence(F.lit(0), F.lit(world - 1))).alias("rank")
    # a group's targets go once to each of its ranks, with its size; a row without a concept stands for a group that has none
    own = targets.select(F.col(group).alias("_group"), "concept_id", "concept", "freq", "target")
    known = sizes.select(F.col(group).alias("_group"), "n").join(own, "_group", "left").select("_group", ranks, "n", "concept_id", "concept", "freq", "target")

    def choose(part: pd.DataFrame, concepts: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({group: [], "rank": [], "idx": [], "pick": []}).astype({"rank": np.int32, "idx": np.int64, "pick": np.int64})
        part = part.sort_values("idx", kind="stable")
        n, rank, name = int(concepts["n"].iloc[0]), int(part["rank"].iloc[0]), part[group].iloc[0]
        total = int(2 ** round(math.log2((1 - filter_ratio) * n))) if n else 0
        size = total // world + (rank < total % world)
        concepts = concepts[concepts["concept"].notna()].sort_values("concept_id")
        number = {c: k for k, c in enumerate(concepts["concept"])}
        classes = [[number[c] for c in own] for own in part["classes"]]
        picked = greedy(classes, concepts["freq"].to_numpy(np.int64), concepts["target"].to_numpy(np.int64), size, cap)
        if len(picked) < size:
            spare = sorted((f, i) for i, (f, own) in enumerate(zip(part["fill"], classes, strict=True)) if not own)
            picked += [i for _, i in spare[: size - len(picked)]]
        return pd.DataFrame({group: name, "rank": rank, "idx": part["idx"].to_numpy()[picked], "pick": np.arange(len(picked))})

    kind = dict(samples.dtypes)[group]
    return ready.groupBy(group, "rank").cogroup(known.groupBy("_group", "rank")).applyInPandas(choose, f"{group} {kind}, rank int, idx long, pick long")


def select(samples: DataFrame, mode: str = "dm", **options) -> DataFrame:
    """iid: all rows; fm: frequency_select; dm: diversity_select against targets from the samples themselves."""
    if mode == "iid":
        return samples
    if mode == "fm":
        return frequency_select(samples, **options)
    if mode != "dm":
        raise ValueError(f"no selection mode {mode}")
    group, ratio = options.get("group", "sb"), options.get("filter_ratio", 0.8)
    budget = samples.groupBy(group).agg(sub_batch_size(F.count(F.lit(1)), ratio).cast("long").alias("T"))
    return diversity_select(samples, concept_targets(concept_frequency(samples, group), budget, group), **options)


#: Rows that a task numbers on average.
NUMBERED = 100_000


def numbered(rows: DataFrame, order: list[str], out: str = "number") -> DataFrame:
    """Adds each row's place in the order, from 0. Rows are dealt to ranges of the first column (a number or a time) by its quantiles, so no task numbers them all; a column of one value is one range."""
    spark, first = rows.sparkSession, order[0]
    value = F.col(first).cast("timestamp").cast("double") if dict(rows.dtypes)[first].startswith(("timestamp", "date")) else F.col(first).cast("double")
    n = rows.count()
    parts = max(1, -(-n // NUMBERED))
    cuts = sorted(set(rows.select(value.alias("v")).approxQuantile("v", [k / parts for k in range(1, parts)], 0.5 / parts))) if parts > 1 else []
    dealt = rows.withColumn("_part", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= value)) if cuts else F.lit(0))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_size")).collect()  # a row for each part
    total, offsets = 0, []
    for r in sorted(sizes):
        offsets.append((r["_part"], total))
        total += r["_size"]
    known = F.broadcast(spark.createDataFrame(offsets, "_part int, _before long"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_within", within).join(known, "_part").withColumn(out, F.col("_within") + F.col("_before")).drop("_part", "_within", "_before")


def batches(rows: DataFrame, order: list[str], size: int, keep_partial: bool = False, key: str | None = None) -> DataFrame:
    """Numbers rows within key (or overall) in batches of `size`; a partial last batch is dropped unless kept."""
    if key is None:
        out = numbered(rows, order, "_number")
        whole = rows.count() // size * size
        out = out if keep_partial else out.where(F.col("_number") < whole)
        return out.withColumn("batch", F.floor(F.col("_number") / size).cast("long")).drop("_number")
    by = Window.partitionBy(key)
    out = rows.withColumn("batch", F.floor((F.row_number().over(by.orderBy(*order)) - 1) / size).cast("long"))
    return out if keep_partial else out.withColumn("_n", F.count(F.lit(1)).over(by)).where((F.col("batch") + 1) * size <= F.col("_n")).drop("_n")


def epochs(rows: DataFrame, per_epoch: int, most: int | None = None, batch: str = "batch") -> DataFrame:
    """Adds epoch, the number of the cut of `per_epoch` batches that a batch is in; with `most` later epochs are left out."""
    out = rows.withColumn("epoch", F.expr(f"{batch} div {per_epoch}"))
    return out if most is None else out.where(F.col("epoch") < most)


def epoch_plan(samples: int, batch: int, world: int, workers: int, floor: bool = False) -> dict[str, int]:
    """Batches and samples of an epoch after rounding to whole batches for each worker of each process."""
    up = (lambda a, b: a // b) if floor else (lambda a, b: -(-a // b))
    per_worker = up(up(samples, batch * world), max(1, workers))
    n = per_worker * max(1, workers)
    return {"worker_batches": per_worker, "batches": n, "samples": n * batch * world}


def shuffled(rows: DataFrame, key: str, seed: int, epoch: int = 0) -> DataFrame:
    """rows in a seeded order that is the same on every worker (position_key, then the key)."""
    return rows.withColumn("position_key", F.xxhash64(F.lit(seed + epoch), key)).orderBy("position_key", key)


def worker_seed(seed: int, worker: int, workers: int, increment: int = 0) -> int:
    """The seed of a worker: its own, moved on by `increment` rounds of all workers."""
    return seed + worker + increment * workers


def rank_seed(seed: int, rank: int) -> int:
    return seed + rank


def sample_per_class(rows: DataFrame, label: str, key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows of each class, drawn by a seeded hash, with k, their number from 1. Repeats of a key follow one another."""
    by = Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), key), key)
    return rows.withColumn("k", F.row_number().over(by).cast("long")).where(F.col("k") <= k)


def rank_plan(sizes: DataFrame, target: int, rank: str = "rank", size: str = "size") -> DataFrame:
    """sizes with quota (an even share of target, the rest to the first ranks) and first_index (the sizes of the ranks before it). A row for each rank."""
    world = F.count(F.lit(1)).over(Window.partitionBy())
    before = Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    quota = F.floor(F.lit(target) / world) + (F.col(rank) < F.lit(target) % world).cast("long")
    return sizes.withColumns({"quota": quota.cast("long"), "first_index": F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long")})


def local_slice(rows: DataFrame, rank: int, size: int, index: str = "idx") -> DataFrame:
    """The rows whose global index lies in the rank's share of `size`, with local, the index within it."""
    local = F.col(index) - rank * size
    return rows.withColumn("local", local).where((F.col("local") >= 0) & (F.col("local") < size))
