"""Samples, boxes, captions and logits bound to the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a super-batch.
SUPER_BATCH = 640


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as samples: their parts' brands as concepts (repeats kept, sorted); sb and idx from the key."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    concepts = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("p_brand")).alias("classes"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    joined = orders.join(concepts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(F.expr(f"o_orderkey div {SUPER_BATCH}").alias("sb"), (F.col("o_orderkey") % SUPER_BATCH).alias("idx"), F.coalesce("classes", F.array().cast("array<string>")).alias("classes"))


SAMPLES_SQL = f"""c AS (SELECT l_orderkey, list_sort(list(p_brand)) AS classes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
s AS (SELECT o_orderkey // {SUPER_BATCH} AS sb, o_orderkey % {SUPER_BATCH} AS idx, coalesce(classes, CAST([] AS VARCHAR[])) AS classes FROM orders LEFT JOIN c ON o_orderkey = l_orderkey)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored, labelled boxes of their order."""
    li = table(spark, sf_dir, "lineitem")
    x1, y1 = F.col("l_quantity") / 100, F.col("l_discount")
    return li.select(
        F.col("l_orderkey").alias("image_id"), F.expr("row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax)").cast("long").alias("idx"),
        x1.alias("x1"), y1.alias("y1"), (x1 + 0.2 + F.col("l_tax")).alias("x2"), (y1 + 0.2).alias("y2"),
        (0.2 + (F.col("l_extendedprice") % 1000) / 1250).alias("score"), F.col("l_returnflag").alias("label"), (F.col("l_linenumber") % 4).alias("scale"),
    )


BOXES_SQL = """b AS (SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS idx,
l_quantity / 100 AS x1, l_discount AS y1, l_quantity / 100 + 0.2 + l_tax AS x2, l_discount + 0.2 AS y2, 0.2 + (l_extendedprice % 1000) / 1250 AS score, l_returnflag AS label, l_linenumber % 4 AS scale FROM lineitem)"""


#: White space of any script as a class of regular expressions in SQL.
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def singular_sql(w: str) -> str:
    return f"(CASE WHEN regexp_matches({w}, '\\p{{L}}\\p{{L}}ies$') THEN regexp_replace({w}, 'ies$', 'y') WHEN regexp_matches({w}, '(s|sh|ch|x|z)es$') THEN regexp_replace({w}, 'es$', '') WHEN regexp_matches({w}, '\\p{{L}}[^sui\\s]s$') THEN regexp_replace({w}, 's$', '') ELSE {w} END)"


def forms_sql(w: str) -> str:
    """The word, its singular, and the -ing forms and plurals of both."""
    one = "[x, x || 'ing', CASE WHEN x LIKE '%e' THEN regexp_replace(x, 'e$', 'ing') ELSE x || 'ing' END, CASE WHEN x LIKE '%y' THEN regexp_replace(x, 'y$', 'ies') WHEN regexp_matches(x, '(s|sh|ch|x|z)$') THEN x || 'es' ELSE x || 's' END]"
    return f"list_sort(list_distinct(flatten(list_transform([{w}, {singular_sql(w)}], lambda x: {one}))))"


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as captions; the classes of each are the different words of four or more letters of one benchmark item, sorted (the items take turns by doc_id)."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " "), " "), lambda w: F.length(w) >= 4)))
    items = table(spark, sf_dir, "benchmark").select("item_id", words.alias("classes"))
    turn = F.row_number().over(Window.orderBy("item_id")) - 1  # a benchmark has few items
    n = items.agg(F.count(F.lit(1)).alias("n"))
    numbered = items.withColumn("turn", turn).crossJoin(n)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").crossJoin(n)
    return docs.withColumn("turn", F.pmod("doc_id", "n").cast("int")).join(numbered.select("turn", "classes"), "turn").select("doc_id", "text", "classes")


CAPTIONS_SQL = rf"""i AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS turn, list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g'), ' '), lambda w: length(w) >= 4))) AS classes FROM benchmark),
cap AS (SELECT doc_id, text, classes FROM documents JOIN i ON turn = doc_id % (SELECT count(*) FROM benchmark))"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, k, logit): ten times each dimension of the embeddings; tag k is dimension k."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("k", "v")).select("vec_id", "label", "k", (F.col("v").cast("double") * 10).alias("logit"))


LOGITS_SQL = "g AS (SELECT vec_id, label, CAST(k AS INT) AS k, CAST(embedding[k + 1] AS DOUBLE) * 10 AS logit FROM embeddings, range(64) AS r(k))"
