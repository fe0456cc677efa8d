"""All queries of the curation operators with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import boxes as bx
from tessera.functions import metrics
from tessera.functions import text as tx
from tessera.functions import tagging
from tessera.operators import caption_qa, curation, vocabulary
from tessera.plans import bindings as b
from tessera.sources import shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(c, digits: int = 6):
    return F.round(c, digits)


# Selection

TARGET = "CASE WHEN count(*) OVER (PARTITION BY sb) > 0 THEN CAST(pow(2, round_even(log2((1 - 0.8) * count(*) OVER (PARTITION BY sb)), 0)) AS INT) END"
FREQ = "f AS (SELECT sb, concept, count(*) AS freq FROM (SELECT DISTINCT sb, idx, unnest(classes) AS concept FROM s) GROUP BY ALL)"
TARGETS = f"""{FREQ}, n AS (SELECT sb, CAST(pow(2, round_even(log2((1 - 0.8) * count(*)), 0)) AS BIGINT) AS T FROM s GROUP BY sb),
t1 AS (SELECT f.*, T, row_number() OVER (PARTITION BY sb ORDER BY concept) - 1 AS concept_id, count(*) OVER (PARTITION BY sb) AS n FROM f JOIN n USING (sb)),
t2 AS (SELECT *, least(T // n, 10) AS base FROM t1), t3 AS (SELECT *, greatest(least(base + CASE WHEN concept_id < T % n AND base < 10 THEN 1 ELSE 0 END, 10), 1) AS first FROM t2),
t AS (SELECT sb, concept, freq, concept_id, CAST(CASE WHEN sum(first) OVER w > T THEN greatest(1, least(floor(first * T / sum(first) OVER w), 10)) ELSE first END AS BIGINT) AS target FROM t3 WINDOW w AS (PARTITION BY sb))"""


@query(f"WITH {b.SAMPLES_SQL}, r AS (SELECT *, len(classes) AS n_concepts, row_number() OVER (PARTITION BY sb ORDER BY len(classes) DESC, idx) AS rk, {TARGET} AS target FROM s) SELECT sb, idx, n_concepts, rk FROM r WHERE rk <= target")
def cabs_fm_select(spark, d):
    return curation.frequency_select(b.samples(spark, d)).select("sb", "idx", "n_concepts", "rk")


@query(f"WITH {b.SAMPLES_SQL}, {FREQ} SELECT * FROM f")
def concept_frequency(spark, d):
    return curation.concept_frequency(b.samples(spark, d))


def _targets(spark, d):
    s = b.samples(spark, d)
    budget = s.groupBy("sb").agg(curation.sub_batch_size(F.count(F.lit(1))).cast("long").alias("T"))
    return curation.concept_targets(curation.concept_frequency(s), budget)


@query(f"WITH {b.SAMPLES_SQL}, {TARGETS} SELECT sb, concept, concept_id FROM t")
def concept_dictionary(spark, d):
    return _targets(spark, d).select("sb", "concept", "concept_id")


@query(f"WITH {b.SAMPLES_SQL}, {TARGETS} SELECT sb, concept, freq, target FROM t")
def cabs_dm_targets(spark, d):
    return _targets(spark, d).select("sb", "concept", "freq", "target")


@query(f"WITH {b.SAMPLES_SQL}, {TARGETS}, e AS (SELECT sb, idx, unnest(classes) AS concept FROM s) SELECT sb, idx, round(avg(CASE WHEN target > 0 THEN 1 + 1 / greatest(1.0, CAST(freq AS DOUBLE)) ELSE -0.5 END), 6) AS gain FROM e JOIN t USING (sb, concept) GROUP BY ALL")
def cabs_dm_initial_gain(spark, d):
    return curation.initial_gain(b.samples(spark, d), _targets(spark, d)).select("sb", "idx", _r("gain").alias("gain"))


@query()
def cabs_dm_select(spark, d):
    return curation.diversity_select(b.samples(spark, d), _targets(spark, d), world=4)


@query()
def cabs_dm_class_balance(spark, d):
    chosen = cabs_dm_select(spark, d).select("sb", "idx")
    return curation.concept_frequency(b.samples(spark, d).join(chosen, ["sb", "idx"], "left_semi"))


@query(f"WITH {b.SAMPLES_SQL} SELECT sb, idx, len(classes) AS listed, len(list_distinct(classes)) AS different FROM s")
def concepts_per_sample(spark, d):
    return b.samples(spark, d).select("sb", "idx", F.size("classes").cast("long").alias("listed"), F.size(F.array_distinct("classes")).cast("long").alias("different"))


@query(f"WITH {b.SAMPLES_SQL} SELECT sb, idx FROM s WHERE len(classes) = 0")
def zero_concept_samples(spark, d):
    return b.samples(spark, d).where(F.size("classes") == 0).select("sb", "idx")


@query(f"WITH {b.SAMPLES_SQL} SELECT sb, idx FROM s")
def iid_select(spark, d):
    return curation.select(b.samples(spark, d), "iid").select("sb", "idx")


@query(f"WITH {b.SAMPLES_SQL}, e AS (SELECT DISTINCT sb, idx, unnest(classes) AS concept FROM s) SELECT x.sb, x.idx, count(DISTINCT y.idx) AS neighbours FROM e x JOIN e y ON x.sb = y.sb AND x.concept = y.concept AND x.idx <> y.idx GROUP BY ALL")
def concept_neighbours(spark, d):
    return curation.concept_neighbours(b.samples(spark, d))


# Batching, sampling, shards

EVENTS = "e AS (SELECT event_id, user_id, event_type, value, ts FROM events)"


@query(f"WITH {EVENTS} SELECT * FROM (SELECT event_id, event_type, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 64 AS batch FROM e) QUALIFY (batch + 1) * 64 <= count(*) OVER (PARTITION BY event_type)")
def super_batches(spark, d):
    return curation.batches(b.table(spark, d, "events"), ["ts", "event_id"], 64, key="event_type").select("event_id", "event_type", "batch")


@query(f"WITH {EVENTS} SELECT event_type, count(*) AS samples, CAST(ceil(count(*) / 64) AS BIGINT) AS batches, count(*) // 64 AS whole_batches FROM e GROUP BY 1")
def count_samples(spark, d):
    return metrics.counts(b.table(spark, d, "events"), ["event_type"], 64)


@query("WITH x AS (SELECT event_type, event_id, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS new, user_id, ts FROM events), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM x) SELECT user_id, CAST(island AS BIGINT) AS island, min(event_type) AS event_type, count(*) AS n, min(event_id) AS first_id FROM y GROUP BY user_id, island")
def adjacent_key_groups(spark, d):
    return shards.adjacent_groups(b.table(spark, d, "events"), "event_type", ["ts", "event_id"], "user_id").groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


URLS = "u AS (SELECT CAST(i AS INT) AS shard_no, 'sh/' || lpad(CAST(i AS VARCHAR), 5, '0') || '.tar' AS url, CASE WHEN i < 60 THEN 2.0 ELSE 1.0 END AS weight FROM range(100) AS r(i))"


def _urls(spark):
    return shards.expand_urls(spark, "sh/{00000..00059}.tar::sh/{00060..00099}.tar", "2::1").select("shard_no", "url", "weight")


@query(f"WITH {URLS} SELECT shard_no, url, weight FROM u")
def expand_urls(spark, d):
    return _urls(spark)


@query(f"WITH {URLS} SELECT url, shard_no % 4 AS node, (shard_no // 4) % 2 AS worker FROM u")
def round_robin_shards(spark, d):
    return shards.round_robin(_urls(spark), "shard_no", 4, 2).select("url", F.col("node").cast("int").alias("node"), F.col("worker").cast("int").alias("worker"))


@query(f"WITH {URLS} SELECT CASE WHEN shard_no < 60 THEN 'a' ELSE 'b' END AS source, CAST(sum(1000 + shard_no * 7 % 13) AS BIGINT) AS samples FROM u GROUP BY 1")
def shard_sizes(spark, d):
    sizes = spark.range(100).select(F.format_string("%05d.tar", "id").alias("name"), (1000 + F.col("id") * 7 % 13).alias("n"))
    joined = shards.with_sizes(_urls(spark), sizes)
    return joined.groupBy(F.when(F.col("shard_no") < 60, "a").otherwise("b").alias("source")).agg(F.sum("n").alias("samples"))


@query(f"WITH {URLS}, c AS (SELECT shard_no, url, sum(weight) OVER (ORDER BY shard_no) AS hi, sum(weight) OVER (ORDER BY shard_no) - weight AS lo FROM u), p AS (SELECT i AS draw, ((i * 7919 + 13) % 10007) / 10007.0 * 160 AS x FROM range(500) AS r(i)) SELECT draw, url FROM p JOIN c ON x >= lo AND x < hi")
def weighted_resample(spark, d):
    draws = spark.range(500).select(F.col("id").alias("draw"), (((F.col("id") * 7919 + 13) % 10007) / 10007.0).alias("u"))
    return shards.resample(_urls(spark), draws).select("draw", "url")


@query("SELECT * FROM (VALUES (128000000, 5120, 4, 8, 782, 6256, 128122880), (1000, 64, 1, 4, 4, 16, 1024)) AS v(samples, batch, world, workers, worker_batches, batches, epoch_samples)")
def epoch_arithmetic(spark, d):
    rows = []
    for case in ((128_000_000, 5120, 4, 8), (1000, 64, 1, 4)):
        plan = curation.epoch_plan(*case)
        rows.append((*case, plan["worker_batches"], plan["batches"], plan["samples"]))
    return spark.createDataFrame(rows, "samples int, batch int, world int, workers int, worker_batches int, batches int, epoch_samples int")


@query()
def stratified_k(spark, d):
    return curation.sample_per_class(b.table(spark, d, "embeddings"), "label", "vec_id", 50).select("vec_id", "label", "k")


@query()
def deterministic_shuffle(spark, d):
    return curation.shuffled(_urls(spark), "url", 3, 1)


@query("WITH s AS (SELECT user_id % 4 AS rank, count(*) AS size FROM events GROUP BY 1) SELECT rank, size, CAST(1030 // 4 + CASE WHEN rank < 1030 % 4 THEN 1 ELSE 0 END AS BIGINT) AS quota, CAST(coalesce(sum(size) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_index FROM s")
def rank_quota(spark, d):
    sizes = b.table(spark, d, "events").groupBy((F.col("user_id") % 4).alias("rank")).agg(F.count(F.lit(1)).alias("size"))
    return curation.rank_plan(sizes, 1030)


@query("SELECT event_id AS idx, event_id - 2 * 640 AS local FROM events WHERE event_id >= 1280 AND event_id < 1920")
def local_slice(spark, d):
    return curation.local_slice(b.table(spark, d, "events").select(F.col("event_id").alias("idx")), 2, 640)


@query("SELECT event_id, batch, batch // 20 AS epoch FROM (SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 16 AS batch FROM events) WHERE (batch + 1) * 16 <= (SELECT count(*) FROM events)")
def epoch_batches(spark, d):
    return curation.epochs(curation.batches(b.table(spark, d, "events"), ["ts", "event_id"], 16), 20).select("event_id", "batch", "epoch")


# Filters and projections


@query("SELECT event_type, count(*) FILTER (WHERE has_text AND has_image) AS alt, count(*) FILTER (WHERE has_json AND has_image) AS cabs FROM (SELECT event_type, event_id % 3 <> 0 AS has_text, event_id % 5 <> 0 AS has_image, event_id % 7 <> 0 AS has_json FROM events) GROUP BY 1")
def filter_caption_image(spark, d):
    e = F.col("event_id")
    member = lambda on, name: F.when(on, F.map_from_arrays(F.array(F.lit(name)), F.array(F.lit("x")))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    rows = b.table(spark, d, "events").select("event_type", F.map_concat(member(e % 3 != 0, "txt"), member(e % 5 != 0, "webp"), member(e % 7 != 0, "json")).alias("members"))
    return rows.groupBy("event_type").agg(F.count_if(shards.usable("members", "txt")).alias("alt"), F.count_if(shards.usable("members", "json")).alias("cabs"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN 'j' END, CASE WHEN event_id % 3 = 0 THEN 'p' END, 'w') AS image FROM events")
def member_coalesce(spark, d):
    e = F.col("event_id")
    held = F.map_filter(F.create_map(F.lit("jpg"), F.when(e % 2 == 0, "j"), F.lit("png"), F.when(e % 3 == 0, "p"), F.lit("webp"), F.lit("w")), lambda k, v: v.isNotNull())
    return b.table(spark, d, "events").select("event_id", held.alias("members")).select("event_id", shards.first_present("members").alias("image"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS text, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 2 END AS n_classes FROM customer")
def metadata_defaults(spark, d):
    c = b.table(spark, d, "customer")
    raw = F.concat(F.lit("{"), F.concat_ws(",", F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit('"recap":"'), F.col("c_name"), F.lit('"'))), F.when(F.col("c_custkey") % 2 != 0, F.lit('"classes":["a","a"]'))), F.lit("}"))
    m = shards.metadata(c.select("c_custkey", raw.alias("json")), "json")
    return m.select("c_custkey", F.col("text"), F.size("classes").alias("n_classes"))


@query(f"WITH {URLS} SELECT url FROM u WHERE shard_no BETWEEN 10 AND 80 AND shard_no % 7 <> 0 AND 1000 + shard_no * 3 % 11 < 1008")
def chunk_plan(spark, d):
    u = _urls(spark)
    allowed = u.where("shard_no % 7 <> 0").select("url")
    done = u.select("url", (1000 + F.col("shard_no") * 3 % 11).alias("written"))
    return shards.to_do(u.where("shard_no BETWEEN 10 AND 80"), allowed, done, 1010).select("url")


@query("SELECT min(p_partkey) AS p_partkey, lower(replace(p_name, '_', ' ')) AS key FROM part GROUP BY 2")
def first_wins_dedupe(spark, d):
    return vocabulary.first_of_each(b.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("concept")), vocabulary.normal_key(F.col("concept")), "p_partkey").select("p_partkey", F.col("form").alias("key"))


@query("SELECT p_partkey, regexp_replace(p_name || '.tar.jpg', '\\.[^.]*$', '') || '.json' AS sidecar FROM part")
def sidecar_names(spark, d):
    return b.table(spark, d, "part").select("p_partkey", shards.sidecar(F.concat("p_name", F.lit(".tar.jpg"))).alias("sidecar"))


# Text


_STRIPPED = b.strip_sql("text")


@query(f"WITH t AS (SELECT doc_id, text, {_STRIPPED} AS t FROM documents) SELECT doc_id, sha256({b.strip_sql("CASE WHEN length(text) - length(replace(text, '.', '')) > 1 AND NOT ends_with(t, '.') THEN regexp_extract(t, '(?s)^(.*\\.)', 1) ELSE t END")}) AS caption FROM t")
def trim_caption(spark, d):
    return b.table(spark, d, "documents").select("doc_id", F.sha2(tx.trim_caption(F.col("text")), 256).alias("caption"))


_MARKED = f"regexp_replace(replace(regexp_replace(coalesce(text, ''), '{tx.EMOJI}', '', 'g'), '  ', ' '), '{b.WHITE}+([{tx.MARKS}])', '\\1', 'g')"
_JOINED = _MARKED
for _m in "([{?.,!|-/<>~`@#_=;:]})":
    _JOINED = f"regexp_replace({_JOINED}, '[{chr(92) if _m in '[]-' else ''}{_m}]{{2,}}', '{_m}', 'g')"
_SPACED = "regexp_replace({0}, '([{1}])([^{2}{1}])', '\\1 \\2', 'g')"


@query(f"SELECT doc_id, sha256({b.strip_sql(_SPACED.format(_JOINED, tx.MARKS, b.WHITE[1:-1]))}) AS caption FROM documents")
def preprocess_caption(spark, d):
    return b.table(spark, d, "documents").select("doc_id", F.sha2(tx.preprocess_caption(F.col("text")), 256).alias("caption"))


@query(f"SELECT doc_id, sha256({b.strip_sql(_SPACED.format(_MARKED, tx.MARKS, b.WHITE[1:-1]))}) AS caption FROM documents")
def space_caption(spark, d):
    return b.table(spark, d, "documents").select("doc_id", F.sha2(tx.preprocess_caption(F.col("text"), join_repeats=False), 256).alias("caption"))


_PREAMBLES = "CASE turn % 4 WHEN 0 THEN 'system' || chr(10) || 'assistant' || chr(10) || 'The image shows a ' WHEN 1 THEN 'the IMAGE depicts the' WHEN 2 THEN 'The image shows ' ELSE 'The image is an ' END || coalesce(text, '')"


@query(f"WITH t AS (SELECT conv_id, turn, regexp_replace(regexp_replace({_PREAMBLES}, '(?s).*?\\nassistant\\n', '', 'g'), '(?i)^(The image{b.WHITE}+[\\p{{L}}\\p{{N}}_]+{b.WHITE}+(an|the|a){b.WHITE}?)', '') AS t FROM conversations) SELECT conv_id, turn, sha256(upper(substr(t, 1, 1)) || substr(t, 2)) AS caption FROM t")
def clean_and_capitalize(spark, d):
    c = b.table(spark, d, "conversations")
    head = F.element_at(F.array(F.lit("system\nassistant\nThe image shows a "), F.lit("the IMAGE depicts the"), F.lit("The image shows "), F.lit("The image is an ")), (F.col("turn") % 4 + 1).cast("int"))
    return c.select("conv_id", "turn", F.sha2(tx.clean_and_capitalize(F.concat(head, F.coalesce("text", F.lit("")))), 256).alias("caption"))


@query(f"WITH {b.SAMPLES_SQL} SELECT sb, idx, '{tx.PROMPT} Alt-text: ' || substr('caption of order ' || sb || ' with some more words so that it is longer than the limit of characters', 1, 77) || '.' || CASE WHEN len(classes) > 0 THEN ' Classes: ' || array_to_string(classes, ', ') || '.' ELSE '' END AS prompt FROM s")
def build_prompt(spark, d):
    caption = F.concat(F.lit("caption of order "), F.col("sb"), F.lit(" with some more words so that it is longer than the limit of characters"))
    return b.samples(spark, d).select("sb", "idx", tx.build_prompt(caption, F.col("classes")).alias("prompt"))


@query(f"""SELECT doc_id, array_to_string(list_slice(string_split(trim(rtrim(regexp_replace(regexp_replace(lower(text), '[.!"()*#:;~]', ' ', 'g'), '{b.WHITE}{{2,}}', ' ', 'g'), chr(10)), ' '), ' '), 1, 30), ' ') AS caption FROM documents""")
def pre_caption(spark, d):
    return b.table(spark, d, "documents").select("doc_id", tx.pre_caption(F.col("text"), 30).alias("caption"))


@query("""SELECT doc_id, array_to_string(list_slice(string_split(rtrim(regexp_replace(lower(text), '[.!"()*#:;~]', '', 'g'), ' '), ' '), 1, 50), ' ') AS question FROM documents""")
def pre_question(spark, d):
    return b.table(spark, d, "documents").select("doc_id", tx.pre_question(F.col("text")).alias("question"))


_PUNCT = tx.ASCII_PUNCTUATION.replace("'", "''")


@query(f"SELECT doc_id, sha256({b.strip_sql(f"regexp_replace(lower(regexp_replace(replace(text, '_', ' '), '{_PUNCT}', '', 'g')), '{b.WHITE}+', ' ', 'g')")}) AS form FROM documents")
def canonicalize_text(spark, d):
    return b.table(spark, d, "documents").select("doc_id", F.sha2(tx.canonicalize(F.col("text")), 256).alias("form"))


@query(f"SELECT doc_id, sha256({b.strip_sql(f"regexp_replace(text, '{b.WHITE}+', ' ', 'g')")}) AS form FROM documents")
def whitespace_clean(spark, d):
    return b.table(spark, d, "documents").select("doc_id", F.sha2(tx.whitespace_clean(F.col("text")), 256).alias("form"))


@query()
def basic_clean(spark, d):
    return b.table(spark, d, "pages").select("page_id", F.sha2(tx.clean("lower")(F.col("html")), 256).alias("form"))


@query("SELECT p_partkey, replace(replace(p_name, ' ', ','), ',', ' | ') AS tags FROM part")
def tag_separators(spark, d):
    return b.table(spark, d, "part").select("p_partkey", tx.tag_separators(F.replace("p_name", F.lit(" "), F.lit(","))).alias("tags"))


@query("""WITH n AS (SELECT DISTINCT p_type, regexp_replace(lower(replace(replace(p_type, '_', ' '), '/', ' or ')), '\\.+$', '') AS name FROM part), t AS (SELECT * FROM (VALUES (0, 'a photo of {article} {name}.'), (1, 'itap of my {name}.'), (2, 'a close-up photo of the {name}.')) AS v(k, template))
SELECT p_type, k, CASE WHEN starts_with(p, 'a') OR starts_with(p, 'the') THEN 'This is ' || p ELSE p END AS prompt FROM (SELECT p_type, k, replace(replace(template, '{article}', CASE WHEN substr(name, 1, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 'an' ELSE 'a' END), '{name}', name) AS p FROM n, t)""")
def prompt_templates(spark, d):
    names = b.table(spark, d, "part").select("p_type").distinct().withColumn("name", tx.class_name(F.col("p_type")))
    templates = spark.createDataFrame([(0, "a photo of {article} {name}."), (1, "itap of my {name}."), (2, "a close-up photo of the {name}.")], "k int, template string")
    p = F.replace(F.replace(F.col("template"), F.lit("{article}"), tx.article(F.col("name"))), F.lit("{name}"), F.col("name"))
    return names.crossJoin(F.broadcast(templates)).withColumn("p", p).select("p_type", "k", F.when(F.col("p").startswith("a") | F.col("p").startswith("the"), F.concat(F.lit("This is "), F.col("p"))).otherwise(F.col("p")).alias("prompt"))


# Boxes

_IOU = "CASE WHEN (a.x2-a.x1)*(a.y2-a.y1)+(o.x2-o.x1)*(o.y2-o.y1)-greatest(least(a.x2,o.x2)-greatest(a.x1,o.x1),0)*greatest(least(a.y2,o.y2)-greatest(a.y1,o.y1),0) > 0 THEN greatest(least(a.x2,o.x2)-greatest(a.x1,o.x1),0)*greatest(least(a.y2,o.y2)-greatest(a.y1,o.y1),0)/((a.x2-a.x1)*(a.y2-a.y1)+(o.x2-o.x1)*(o.y2-o.y1)-greatest(least(a.x2,o.x2)-greatest(a.x1,o.x1),0)*greatest(least(a.y2,o.y2)-greatest(a.y1,o.y1),0)) ELSE 0 END"


@query(f"WITH {b.BOXES_SQL} SELECT a.image_id, a.idx AS i, o.idx AS j, round({_IOU}, 6) AS iou FROM b a JOIN b o ON a.image_id = o.image_id AND a.idx < o.idx")
def box_iou(spark, d):
    box = b.boxes(spark, d)
    side = lambda p: box.select("image_id", *[F.col(c).alias(p + c) for c in (*bx.CORNERS, "idx")])
    pairs = side("a").join(side("o"), "image_id").where("aidx < oidx")
    both = [tuple(F.col(p + c) for c in bx.CORNERS) for p in "ao"]
    return pairs.select("image_id", F.col("aidx").alias("i"), F.col("oidx").alias("j"), _r(bx.iou(*both)).alias("iou"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_discount - l_tax / 2, 6) AS x1, round(l_discount - l_tax / 2 + l_tax, 6) AS x2 FROM lineitem")
def box_corner(spark, d):
    x1, _, x2, _ = bx.corners(F.col("l_discount"), F.col("l_discount"), F.col("l_tax"), F.col("l_tax"))
    return b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _r(x1).alias("x1"), _r(x2).alias("x2"))


@query(f"WITH {b.BOXES_SQL} SELECT image_id, idx, label FROM b a WHERE NOT EXISTS (SELECT 1 FROM b o WHERE a.image_id = o.image_id AND a.label <> o.label AND (a.score < o.score OR (a.score = o.score AND a.idx < o.idx)) AND {_IOU} > 0.5)")
def box_overlap_filter(spark, d):
    return bx.overlap_filter(b.boxes(spark, d)).select("image_id", "idx", "label")


@query(f"WITH {b.BOXES_SQL} SELECT image_id, count(*) AS n, count(DISTINCT label) AS labels, count(DISTINCT scale) AS scales FROM b WHERE score >= 0.26 GROUP BY 1")
def box_collect(spark, d):
    kept = tagging.collected(b.boxes(spark, d).where("score >= 0.26"), "image_id")
    return kept.select("image_id", *[F.size(c).cast("long").alias(n) for c, n in (("boxes", "n"), ("labels", "labels"), ("scales", "scales"))])


@query()
def box_nms(spark, d):
    return bx.suppress(b.boxes(spark, d), ["image_id", "scale"])


@query()
def box_wbf(spark, d):
    return bx.fuse(b.boxes(spark, d))


@query()
def box_ensemble(spark, d):
    """Boxes of each scale suppressed, fused over the scales, and filtered across labels."""
    return bx.ensemble(b.boxes(spark, d))


# Vocabulary and caption checks


@query(f"SELECT DISTINCT p_name AS concept, lower(replace(p_name, '_', ' ')) AS key, regexp_replace({b.strip_sql("p_name || '  x '")}, '{b.WHITE}+', ' ', 'g') AS spacing, array_to_string(list_transform(string_split(p_name || 's', ' '), lambda w: {b.singular_sql('w')}), ' ') AS lemma FROM part")
def vocab_normalize(spark, d):
    c = F.col("p_name")
    return b.table(spark, d, "part").select(c.alias("concept"), vocabulary.normal_key(c).alias("key"), vocabulary.single_spaced(F.concat(c, F.lit("  x "))).alias("spacing"), vocabulary.morphological(F.concat(c, F.lit("s"))).alias("lemma")).distinct()


@query("SELECT DISTINCT p_name AS concept, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda x: substr(x, 1, 1)), '') AS initials FROM part")
def vocab_abbreviation(spark, d):
    return b.table(spark, d, "part").select(F.col("p_name").alias("concept"), vocabulary.initials(F.col("p_name")).alias("initials")).distinct()


def _concepts(spark, d):
    return b.table(spark, d, "part").groupBy(F.col("p_name").alias("concept")).agg(F.min("p_partkey").alias("ord"))


def variants_planted(spark, d):
    """The part names as a vocabulary, each followed by spellings of it: upper case, underscores, wide spaces, plural, a letter doubled, and its initials. (ord, concept, value)"""
    c = F.col("concept")
    forms = F.array(c, F.upper(c), F.replace(c, F.lit(" "), F.lit("_")), F.concat(F.lit(" "), F.replace(c, F.lit(" "), F.lit("  "))), F.concat(c, F.lit("s")), F.concat(c, F.substring(c, -1, 1)), vocabulary.initials(c))
    each = _concepts(spark, d).select("ord", F.posexplode(forms).alias("k", "concept"))
    return each.select((F.col("k") * 1_000_000 + F.col("ord")).alias("ord"), "concept", F.col("k").cast("string").alias("value"))


@query()
def vocab_variants(spark, d):
    return vocabulary.variant_pairs(variants_planted(spark, d))


@query()
def vocab_leader_merge(spark, d):
    c = variants_planted(spark, d)
    return vocabulary.leaders(c, vocabulary.variant_pairs(c))


@query()
def vocab_cleanup(spark, d):
    return vocabulary.clean_concepts(variants_planted(spark, d))[0]


@query()
def vocab_cleanup_counters(spark, d):
    return vocabulary.clean_concepts(variants_planted(spark, d))[1]


@query(f"SELECT w, {b.forms_sql('w')} AS forms FROM (SELECT DISTINCT replace(lower(unnest(string_split(p_name, ' '))), '-', ' ') AS w FROM part)")
def word_forms(spark, d):
    words = b.table(spark, d, "part").select(F.explode(F.split(F.replace(F.lower("p_name"), F.lit("-"), F.lit(" ")), " ")).alias("w")).distinct()
    return words.select("w", tx.word_forms(F.col("w")).alias("forms"))


_QA = f"""WITH {b.CAPTIONS_SQL}, n AS (SELECT doc_id, classes, regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}_{b.WHITE[1:-1]}-]', '', 'g'), '{b.WHITE}+-{b.WHITE}+', ' ', 'g') AS t FROM cap),
w AS (SELECT DISTINCT doc_id, replace(unnest(string_split(regexp_replace(t, '{b.WHITE}+', ' ', 'g'), ' ')), '-', ' ') AS w FROM n), v AS (SELECT w, {b.forms_sql('w')} AS forms FROM (SELECT DISTINCT w FROM w WHERE w <> '')), said AS (SELECT DISTINCT doc_id, unnest(forms) AS form FROM w JOIN v USING (w)),
k AS (SELECT doc_id, t, unnest(range(len(classes))) AS idx, unnest(classes) AS class FROM n), g AS (SELECT class, unnest({b.forms_sql('class')}) AS form FROM (SELECT DISTINCT class FROM k)),
q AS (SELECT k.doc_id, idx, class, bool_or(contains(t, g.form) OR said.form IS NOT NULL) AS found FROM k JOIN g USING (class) LEFT JOIN said ON said.doc_id = k.doc_id AND said.form = g.form GROUP BY ALL)"""


@query(_QA + " SELECT doc_id, CAST(idx AS INT) AS idx, class, found FROM q")
def class_in_caption_vanilla(spark, d):
    return caption_qa.details(caption_qa.check(b.captions(spark, d))).select("doc_id", "idx", "class", "found")


@query(_QA + ", r AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE NOT found) AS lost FROM q GROUP BY 1) SELECT (SELECT count(*) FROM n) AS images, CAST(sum(n) AS BIGINT) AS instances, CAST(sum(lost) AS BIGINT) AS missing, count(*) FILTER (WHERE lost > 0) AS images_with_miss, round(100.0 * (sum(n) - sum(lost)) / sum(n), 6) AS success FROM r")
def caption_qa_summary(spark, d):
    return caption_qa.summary(caption_qa.check(b.captions(spark, d)))


def synonyms_of(word: str) -> tuple[str, ...]:
    """Stands for a dictionary in the queries: a word's synonym is its reverse."""
    return (word[::-1],)


@query()
def class_in_caption_synonyms(spark, d):
    return caption_qa.details(caption_qa.check(b.captions(spark, d), "synonyms", language=caption_qa.Language(synonyms=synonyms_of))).select("doc_id", "idx", "class", "found")


@query()
def class_in_caption_full(spark, d):
    return caption_qa.details(caption_qa.check(b.captions(spark, d), "full", language=caption_qa.Language(synonyms=synonyms_of))).select("doc_id", "idx", "class", "found", "form", "word", F.round("score", 6).alias("score"))


@query()
def caption_strategy_rates(spark, d):
    return caption_qa.strategy_rates(b.captions(spark, d))


from tessera.plans import evaluation  # noqa: E402, F401  (registers its queries)
