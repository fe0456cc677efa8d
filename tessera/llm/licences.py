"""Licence scan by canonical digest, in DataFrame functions only.

A text is brought to a canonical form (case, copyright lines, equivalent spellings, punctuation and
white space) and its digest is looked up among the digests of known licences in the same form. The
whole text has to be the licence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import read
from tessera.llm.licence_texts import DIGESTS, LICENCES

#: Lines that state a copyright. "Copyright" before one of these words belongs to a sentence that was wrapped there, unless a colon follows; "(c)" without a year is a list mark.
WRAPPED = r"(notices?|holders?|owners?|licen[cs]es?|laws?|statements?|interests?|treaty|rights?|disclaimers?|permission|the software|and|or|on|in|is|by|to)\b(?![ \t]*:)"
STATED = r"\(c\)[^\n]*\b(?:19|20)[0-9][0-9]\b|©|all rights reserved"
COPYRIGHT = rf"(^|\n)[ \t*#/;>-]*(copyright\b(?![\s*#/;>-]+{WRAPPED})|{STATED})[^\n]*"
#: The same in the SQL, which has no lookahead and so takes wrapped lines for statements.
SQL_COPYRIGHT = rf"(^|\n)[ \t*#/;>-]*(copyright\b|{STATED})[^\n]*"
#: Spellings that count as the same, after lower-casing.
EQUIVALENT = (
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-infringement", "noninfringement"), ("organisation", "organization"),
    ("merchantibility", "merchantability"), ("authorisation", "authorization"), ("favour", "favor"), ("behaviour", "behavior"), ("http://", "https://"), ("per cent", "percent"), ("&", "and"),
)


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "\n")
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def known(spark) -> DataFrame:
    """licence_id, known_digest of the fixed list of licences: short ones by their texts, long ones by the digest of their canonical form (one row each, under a hundred; a licence may have several)."""
    rows = F.array(*[F.struct(F.lit(k).alias("licence_id"), F.sha2(canonical(F.lit(v)), 256).alias("known_digest")) for k, v in LICENCES])
    fixed = F.array(*[F.struct(F.lit(k).alias("licence_id"), F.lit(v).alias("known_digest")) for k, v in DIGESTS])
    return spark.range(1).select(F.explode(F.concat(rows, fixed)).alias("r")).select("r.licence_id", "r.known_digest")


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, digest, canonical_chars, licence_id (null if the text is no known licence).

    The known digests are a fixed list and are broadcast; documents are not shuffled. Null and empty texts match nothing; null ids stay null; rows repeated or with equal ids are rows of
    their own; other columns are not read; an empty table gives no rows.
    """
    form = docs.select(F.col(id_col).alias("id"), canonical(F.col(text)).alias("_form"))
    d = form.select("id", F.sha2("_form", 256).alias("digest"), F.length("_form").cast("long").alias("canonical_chars"))
    return d.join(F.broadcast(known(docs.sparkSession)), F.col("digest") == F.col("known_digest"), "left").select("id", "digest", "canonical_chars", "licence_id")


def op6_licence_scan(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _sql(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), '{SQL_COPYRIGHT}', chr(10), 'g')"
    for a, b in EQUIVALENT:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"


def oracle() -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in LICENCES)
    fixed = ", ".join(f"('{k}', '{v}')" for k, v in DIGESTS)
    return f"""WITH k AS (SELECT licence_id, sha256({_sql("body")}) AS digest FROM (VALUES {values}) AS v(licence_id, body) UNION ALL VALUES {fixed}),
d AS (SELECT doc_id, {_sql("text")} AS form FROM documents)
SELECT doc_id, sha256(form) AS digest, length(form) AS canonical_chars, licence_id FROM d LEFT JOIN k ON k.digest = sha256(form)"""
