"""Filtering and repeating rows by what the operators decide, for pipelines over a documents table.

Every function takes docs with doc_id, text and source and keeps its columns, whatever further ones there are: helper columns get
names that docs does not have. Null texts count as empty, an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from tessera.llm.common import written


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """Each name, lengthened until docs has no such column (in any case)."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose score reaches THRESHOLD."""
    (score,) = free_names(docs, "_score")
    return toxicity.score(docs, toxicity.train(docs, labels), column=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts. Of rows equal in id and text that both could stay, any one does."""
    i, sha, n, s, length = free_names(docs, "_id", "_sha", "_n", "_s", "_l")
    decided = written(exact_dedup.dedup(docs), "decided", few=True)
    stays = decided.where("kept").select(F.col("id").alias(i), F.col("text_sha256").alias(sha), F.col("n_chars").alias(n))
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.withColumns({s: F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""), 256), length: F.length(text).cast("long")})
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(s) == F.col(sha)) & (F.col(length) == F.col(n))
    kept = own.join(stays, same, "left_semi")
    twice = (F.col("id").eqNullSafe(F.col(i))) & (F.col("text_sha256") == F.col(sha)) & (F.col("n_chars") == F.col(n))
    if not decided.where("NOT kept").join(stays, twice, "left_semi").isEmpty():
        kept = kept.dropDuplicates(["doc_id", s, length])  # rows repeated in full
    return kept.drop(s, length)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one document of each near-duplicate group; documents without an id stay. Rows that share an id are told apart by their texts."""
    i, mark = free_names(docs, "_id", "_mark")
    goes = near_dedup.groups(docs).where("NOT kept").select(F.col("id").alias(i), F.col("mark").alias(mark)).distinct()
    return docs.join(goes, (F.col("doc_id") == F.col(i)) & (F.xxhash64("text") == F.col(mark)), "left_anti")


def repeat_to_mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """docs, each row as often as the mix takes it. Rows equal in id, source and text share what they are taken, in the order of a hash of all columns."""
    i, source, mark, passes, rows_, number, time = free_names(docs, "_id", "_source", "_mark", "_passes", "_rows", "_number", "_time")
    key = [i, source, mark]
    mixed = mixing.mix(docs, seed=seed).select(F.col("id").alias(i), F.col("source").alias(source), F.col("mark").alias(mark), "passes")
    plan = written(mixed.groupBy(*key).agg(F.sum("passes").alias(passes), F.count(F.lit(1)).alias(rows_)).where(F.col(passes) > 0), "passes", few=True)
    same = F.col("doc_id").eqNullSafe(F.col(i)) & F.col("source").eqNullSafe(F.col(source)) & (F.xxhash64("text") == F.col(mark))
    out = docs.join(plan, same)
    if not plan.where(F.col(rows_) > 1).isEmpty():
        order = F.xxhash64(*[F.col(c).cast("string") for c in docs.columns])
        out = out.withColumn(number, F.row_number().over(Window.partitionBy(*key).orderBy(order)))
        out = out.withColumn(passes, F.expr(f"{passes} div {rows_}") + (F.col(number) <= F.col(passes) % F.col(rows_)).cast("long"))
    times = F.when(F.col(passes) > 0, F.sequence(F.lit(1), F.col(passes).cast("int"))).otherwise(F.array().cast("array<int>"))
    return out.select(*docs.columns, F.explode(times).alias(time)).select(*docs.columns)


def pack_all(docs: DataFrame) -> DataFrame:
    return packing.result(packing.pack(docs))
