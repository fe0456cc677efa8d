"""Concept vocabulary cleanup: normal forms, spelling variants, leader merging, safety."""

from __future__ import annotations

import difflib
import tempfile
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.similarity import similar_pairs
from tessera.functions.text import SPACE, singular, strip
from tessera.functions.vector import cosine, small

RATIO, LONGER_THAN = 0.92, 4


def normal_key(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit("_"), F.lit(" ")))


def single_spaced(c: Column) -> Column:
    """White space at the ends cut, within made one space."""
    return F.regexp_replace(strip(c), rf"[{SPACE}]+", " ")


def morphological(c: Column, lemma: Callable[[Column], Column] = singular) -> Column:
    """Each word by its noun lemma, with single spaces."""
    return F.array_join(F.transform(F.split(single_spaced(c), " "), lemma), " ")


def initials(c: Column) -> Column:
    return F.array_join(F.transform(F.split(F.lower(c), " "), lambda w: F.substring(w, 1, 1)), "")


def first_of_each(rows: DataFrame, form: Column, order: str) -> DataFrame:
    """The first row of each normal form (added as form)."""
    d = rows.withColumn("form", form)
    return d.withColumn("_n", F.row_number().over(Window.partitionBy("form").orderBy(order))).where("_n = 1").drop("_n")


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


@cache
def _left_out(m: int, n: int) -> int:
    """The most characters that matching blocks of names of m and n characters may leave out of both at a ratio over RATIO; -1 if the lengths rule it out."""
    return next((m + n - 2 * k for k in range(min(m, n) + 1) if 2.0 * k / (m + n) > RATIO), -1)


@cache
def _cuts(m: int) -> list[tuple[int, int]]:
    """Bounds of the pieces of a name of m characters: one more than any name at least as long may break. A character left out of either name breaks one piece at most, so one lies whole in the other name."""
    k, n = 1, m
    while (d := _left_out(m, n)) >= 0:
        k, n = max(k, d + 1), n + 1
    return [(i * m // k, (i + 1) * m // k) for i in range(k)]


def _met_by(c: str) -> list[str]:
    n, out, m = len(c), set(), len(c)
    while m and (d := _left_out(m, n)) >= 0:
        for i, (start, end) in enumerate(_cuts(m)):
            # moved by the characters left out before it: of the shorter name to the left, of the longer one to the right
            for at in range(max(0, start - (d - n + m) // 2), min(n - end + start, start + (d + n - m) // 2) + 1):
                out.add(f"{m} {i} {c[at : at + end - start]}")
        m -= 1
    return list(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _pieces(c: pd.Series) -> pd.Series:
    """The pieces of a name, each with the name's length and its number."""
    return pd.Series([[f"{len(x)} {i} {x[a:b]}" for i, (a, b) in enumerate(_cuts(len(x)))] for x in c])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _met(c: pd.Series) -> pd.Series:
    """What a name holds in the places where pieces of names up to its length may lie."""
    return pd.Series([_met_by(x) for x in c])


def variant_pairs(concepts: DataFrame) -> DataFrame:
    """(earlier, later, kind) of concepts that are spellings of one another: one is the other's initials, or both are long and their match ratio is over RATIO.

    Candidates share their initials or a piece (_pieces, _met); no pair is lost.
    """
    c = concepts.select("ord", F.lower("concept").alias("c"))
    many = c.where(F.size(F.split("c", " ")) >= 2).select("ord", "c", initials(F.col("c")).alias("short"))
    one = c.where(F.size(F.split("c", " ")) == 1).select(F.col("ord").alias("o2"), F.col("c").alias("short"))
    short = many.join(one, "short").select(F.least("ord", "o2").alias("earlier"), F.greatest("ord", "o2").alias("later"), F.lit("abbreviation").alias("kind"))
    x = c.where(F.length("c") > LONGER_THAN)
    shorter = x.select("ord", "c", F.explode(_pieces("c")).alias("piece"))
    longer = x.select(F.col("ord").alias("o2"), F.col("c").alias("c2"), F.explode(_met("c")).alias("piece"))
    swap = F.col("ord") > F.col("o2")
    near = shorter.join(longer, "piece").where("ord <> o2").select(F.least("ord", "o2").alias("earlier"), F.greatest("ord", "o2").alias("later"), F.when(swap, F.col("c2")).otherwise(F.col("c")).alias("a"), F.when(swap, F.col("c")).otherwise(F.col("c2")).alias("b")).distinct()
    spelled = near.where(_ratio("a", "b") > RATIO).select("earlier", "later", F.lit("spelling").alias("kind"))
    return short.unionByName(spelled).distinct()


def duplicate_pairs(concepts: DataFrame, embeddings: DataFrame | None = None, threshold: float = 0.95) -> DataFrame:
    """variant_pairs and, where embeddings (ord, embedding) are given, the pairs whose cosine is over threshold (kind "meaning")."""
    pairs = variant_pairs(concepts)
    if embeddings is None:
        return pairs
    near = similar_pairs(embeddings, "ord", "embedding", threshold).select(F.col("a").alias("earlier"), F.col("b").alias("later"), F.lit("meaning").alias("kind"))
    return pairs.unionByName(near.join(pairs, ["earlier", "later"], "left_anti"))


def leaders(concepts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ord, concept, leader): in order, a concept joins the first kept one it is a variant of, or is kept itself. Not a closure: rounds settle those all of whose earlier variants are settled."""
    context = concepts.sparkSession.sparkContext
    if context.getCheckpointDir() is None:  # spark.checkpoint.dir is not set, as in tests
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    edges = pairs.select("earlier", "later").distinct()
    state = concepts.select("ord", F.lit(None).cast("boolean").alias("kept"))
    while True:
        seen = edges.join(state.select(F.col("ord").alias("earlier"), F.col("kept").alias("k")), "earlier").groupBy("later").agg(F.bool_or(F.coalesce("k", F.lit(False))).alias("lost"), F.bool_and(F.coalesce(~F.col("k"), F.lit(False))).alias("free"))
        settled = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("later").isNull() | F.col("free"), True).when(F.col("lost"), False)
        state = state.join(seen, F.col("ord") == F.col("later"), "left").select("ord", settled.alias("kept")).checkpoint()
        if state.where("kept IS NULL").isEmpty():
            break
    heads = state.where("kept").select(F.col("ord").alias("earlier"))
    joined = edges.join(heads, "earlier").groupBy("later").agg(F.min("earlier").alias("leader"))
    out = concepts.join(state, "ord").join(joined, F.col("ord") == F.col("later"), "left")
    return out.select("ord", "concept", F.when(F.col("kept"), F.col("ord")).otherwise(F.col("leader")).alias("leader"))


def safety(queries: DataFrame, exemplars: DataFrame, race: float = 0.70, nsfw: float = 0.65, margin: float = 0.05) -> DataFrame:
    """vec_id, the largest cosine to each kind of exemplar (safe, race, nsfw) and a verdict. Exemplars are a small set; it is broadcast where its size allows."""
    s = queries.crossJoin(small(exemplars)).withColumn("s", cosine(F.col("embedding"), F.col("exemplar")))
    m = s.groupBy("vec_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("s"))).alias(k) for k in ("safe", "race", "nsfw")])
    verdict = F.when((F.col("race") > race) & (F.col("race") > F.col("safe") + margin), "UNSAFE_RACE").when((F.col("nsfw") > nsfw) & (F.col("nsfw") > F.col("safe") + margin), "UNSAFE_NSFW").otherwise("SAFE")
    return m.withColumn("verdict", verdict)


def clean_concepts(vocabulary: DataFrame, embeddings: DataFrame | None = None, verdicts: DataFrame | None = None, lemma: Callable[[Column], Column] = singular) -> tuple[DataFrame, DataFrame]:
    """(kept, counters) of a vocabulary (ord, concept, value): the first of each key, of each spacing, of each lemma, then leaders of duplicates, then what verdicts (concept, verdict) call SAFE
    (concepts without a verdict stay). The name of an entry is its normal form, the value that of its first one. Counters: (step, stage, status, n)."""
    spark = vocabulary.sparkSession
    now, counts = vocabulary, []

    def count(step: int, stage: str, after: DataFrame, status: str = "removed") -> DataFrame:
        n, m = now.agg(F.count(F.lit(1)).alias("n")), after.agg(F.count(F.lit(1)).alias("m"))
        return n.crossJoin(m).select(F.lit(step).alias("step"), F.lit(stage).alias("stage"), F.lit(status).alias("status"), (F.col("n") - F.col("m")).alias("n"))

    for step, (stage, form) in enumerate((("key", normal_key), ("spacing", single_spaced), ("lemma", lambda c: morphological(c, lemma)))):
        after = first_of_each(now, form(F.col("concept")), "ord").select("ord", F.col("form").alias("concept"), "value")
        counts.append(count(step, stage, after, "merged"))
        now = after
    chosen = leaders(now.select("ord", "concept"), duplicate_pairs(now, embeddings)).where("ord = leader").select("ord")
    after = now.join(chosen, "ord", "left_semi")
    counts.append(count(3, "duplicate", after, "merged"))
    now = after
    if verdicts is not None:
        bad = now.join(verdicts.where("verdict <> 'SAFE'"), "concept")
        counts.append(bad.groupBy(F.col("verdict").alias("status")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(4).alias("step"), F.lit("safety").alias("stage"), "status", "n"))
        now = now.join(verdicts.where("verdict <> 'SAFE'").select("concept"), "concept", "left_anti").select("ord", "concept", "value")
    counters = spark.createDataFrame([], "step int, stage string, status string, n long")
    for c in counts:
        counters = counters.unionByName(c)
    return now, counters
