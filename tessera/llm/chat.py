"""Relational chat formatting with Spark expressions only.

Template: `<s>` then for each run of turns with one role `[TURN]role[TEXT]text[SEG]text...</s>`.
Adjacent turns with the same role are merged into one such block; `[SEG]` keeps their borders. Where a
text or role holds a control string, a backslash after its first character takes its meaning away
(one more where backslashes stand there already), so the template can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import read

#: What follows the first character of a control string.
REST = r"(/?s>|/?INST\]|TURN\]|TEXT\]|SEG\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*)" + REST, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])\\(\\*)" + REST, r"$1$2$3")


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start, length in code points of the texts of `trained`).

    Turns go by turn (nulls first), then role, then text; repeated rows are turns of their own. A null role or text is
    empty. Null conversation ids form one conversation. A conversation is one output row, so it has to fit one.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sorted_turns = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(x["text"])).alias("texts"))
        new = F.struct(x["role"].alias("role"), F.array(x["text"]).alias("texts"))
        same = (F.size(acc) > 0) & (last["role"] == x["role"])
        return F.when(same, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(new)))

    none = F.array().cast("array<struct<role:string,texts:array<string>>>")
    merged = F.aggregate("turns", none, step)
    safe = F.transform(merged, lambda m: F.struct(escape(m["role"]).alias("role"), (m["role"] == trained).alias("loss"), F.transform(m["texts"], escape).alias("texts")))
    blocks = sorted_turns.select("conv_id", safe.alias("blocks"))
    block = lambda b: F.concat(F.lit("[TURN]"), b["role"], F.lit("[TEXT]"), F.array_join(b["texts"], "[SEG]"), F.lit("</s>"))
    formatted = F.concat(F.lit("<s>"), F.array_join(F.transform("blocks", block), ""))

    def part(length: Column, loss: Column) -> Column:
        return F.array(F.struct(length.cast("long").alias("length"), loss.alias("loss")))

    def parts(b: Column) -> Column:
        texts = F.transform(b["texts"], lambda t, i: F.concat(part(F.when(i == 0, F.length(b["role"]) + 12).otherwise(5), F.lit(False)), part(F.length(t), b["loss"])))
        return F.concat(F.flatten(texts), part(F.lit(4), F.lit(False)))

    start = F.struct(F.lit(3).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def walk(acc: Column, p: Column) -> Column:
        more = F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), p["length"].alias("length"))))
        return F.struct((acc["at"] + p["length"]).alias("at"), F.when(p["loss"], more).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(F.flatten(F.transform("blocks", parts)), start, walk)["spans"]
    return blocks.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text), loss_text: parsed from the formatted string and its spans alone."""
    blocks = F.split(F.expr("substring(formatted, 4)"), "</s>")
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(b: Column) -> Column:
        halves = F.split(F.substring(b, F.lit(7), F.length(b)), r"\[TEXT\]", 2)
        return F.transform(F.split(halves[1], r"\[SEG\]"), lambda t: F.struct(unescape(halves[0]).alias("role"), unescape(t).alias("text")))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return chats.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns)).alias("turns"), loss.alias("loss_text"))


def op1_chat_formatting(spark, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = read_back(format_chats(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
w AS (SELECT *, row_number() OVER o AS rn, lag(role) OVER o AS before FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|TURN\]|TEXT\]|SEG\])', '\1\\\2\3', 'g')) AS n,
  length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|TURN\]|TEXT\]|SEG\])', '\1\\\2\3', 'g')) AS r FROM w)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n + CASE WHEN before = role THEN 5 ELSE 16 + r END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
