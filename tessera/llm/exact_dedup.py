"""Exact dedup by deterministic block naming.

A text (as bytes, after deleting a set of white space) is cut into blocks of fixed size. All
distinct blocks are sorted (by a hash of their digests) and get their ranks as integer names; then adjacent pairs of names are named in the
same way, level by level, until each document has one integer. Names stand for contents, never
for hashes of them, so equal names mean equal texts.

How it runs: distinct blocks are found with map-side combine, so a block that a third of all rows
share is shuffled once a task. Rows refer to blocks by a 128-bit digest; that a digest stands for one block
only is proven over the whole table of names; should it ever not hold, the run stops with an error instead
of a wrong answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_rows, chunks, give_back, hashed_rank, written

#: Bytes of a block.
BLOCK = 4096
#: Text of about this many bytes is worked on at once, and rows with texts in a batch at most.
CHUNK, BATCH = 4_000_000, 2000
WHITE = b" \t\n\x0b\x0c\r"


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    column = batch.column(0).cast(pa.large_binary())
    return [(t or b"").translate(None, WHITE) for t in column.to_pylist()]


def _blocks(text: bytes, block: int) -> list[bytes]:
    return [text[i : i + block] for i in range(0, len(text), block)] or [b""]


def distinct_blocks(docs: DataFrame, text: str, block: int) -> DataFrame:
    """(digest, block), a row for each distinct block of each slice of an Arrow batch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, 0, CHUNK)):
            found = list(dict.fromkeys(b for t in _texts(batch) for b in _blocks(t, block)))
            for i in range(0, len(found), 2000):
                part = found[i : i + 2000]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(b) for b in part], pa.binary()), pa.array(part, pa.binary())], ["digest", "block"])
        give_back()

    return docs.select(F.col(text)).mapInArrow(cut, "digest binary, block binary")


def described(docs: DataFrame, id_col: str, text: str, block: int) -> DataFrame:
    """A row for each document: its id, text_sha256, n_chars (code points of the original) and its blocks' digests."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, 0, CHUNK)):
            texts = _texts(batch)
            chars = [len(t) if t else 0 for t in batch.column(0).to_pylist()]
            rows = [batch.column(1), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(chars, pa.int64())]
            rows.append(pa.array([[xxhash.xxh3_128_digest(b) for b in _blocks(t, block)] for t in texts], pa.list_(pa.binary())))
            yield pa.RecordBatch.from_arrays(rows, ["id", "text_sha256", "n_chars", "digests"])
        give_back()

    return docs.select(F.col(text), F.col(id_col)).mapInArrow(cut, "id long, text_sha256 string, n_chars long, digests array<binary>")


def _named(distinct: DataFrame, keys: list[str], table: str) -> DataFrame:
    """keys and name of distinct rows: their ranks in the order of a hash of the keys, from 0 on without gaps. Names follow from the rows alone, not from partitions or attempts."""
    rows = written(distinct.select(*keys), f"{table}-rows", few=True)
    return written(hashed_rank(rows, [], keys, rows.count(), rank="name"), table, few=True)


def block_names(docs: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """(digest, name) of every distinct block. A digest with two names is a digest of two contents."""
    return _named(distinct_blocks(docs, text, block).groupBy("block").agg(F.first("digest").alias("digest")), ["digest"], "names")


def identities(docs: DataFrame, id_col: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per distinct (id, text, n_chars): id, text_sha256, n_chars, copies, levels, name.

    Two texts are equal exactly when (levels, name) are. Null texts count as empty; an empty text
    has one empty block. Null ids are kept; rows repeated in full are one row with their number in copies.
    """
    with arrow_rows(docs.sparkSession, BATCH):
        names = block_names(docs, text, block)
        rows = written(described(docs, id_col, text, block).groupBy("id", "text_sha256", "n_chars").agg(F.count(F.lit(1)).alias("copies"), F.first("digests").alias("digests")), "rows", few=True)
    if not names.groupBy("digest").count().where("count > 1").isEmpty():
        raise ValueError("two blocks share a 128-bit digest; run again with another block size")
    row = ["id", "text_sha256", "n_chars", "copies"]
    exploded = rows.select(*row, F.size("digests").alias("n_blocks"), F.posexplode("digests").alias("pos", "digest"))
    current = exploded.join(names, "digest").select(*row, "n_blocks", "pos", "name")
    level, done, longest = 0, [], None
    while True:
        current = written(current, f"level{level}", few=True)
        done.append(current.where("n_blocks = 1").select(*row, F.lit(level).alias("levels"), "name"))
        rest = current.where("n_blocks > 1")
        if longest is None:
            longest = rest.agg(F.max("n_blocks")).first()[0] or 1
        if longest <= 1:
            break
        pairs = rest.groupBy(*row, "n_blocks", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right")
        )
        pairs = written(pairs, f"pairs{level}", few=True)
        fresh = _named(pairs.select("left", "right").distinct(), ["left", "right"], f"names{level}")
        current = pairs.join(fresh, ["left", "right"]).select(*row, F.ceil(F.col("n_blocks") / 2).cast("int").alias("n_blocks"), "pos", "name")
        longest, level = -(-longest // 2), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, n_chars.

    Of rows with equal identity the one with the most code points, then the smallest id (nulls
    last), stays; of rows that tie in both, one stays.
    """
    known = identities(docs, id_col, text, block)
    best = F.struct(-F.col("n_chars"), F.col("id").isNull(), F.col("id"))
    groups = written(known.groupBy("levels", "name").agg(F.min(best).alias("best"), F.sum("copies").alias("group_size")), "groups", few=True)  # so that a large group's rows can be split in the join
    joined = known.join(groups, ["levels", "name"])
    wins = (F.col("n_chars") == -F.col("best.col1")) & F.col("id").eqNullSafe(F.col("best.id"))
    each = joined.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return each.select("id", F.col("best.id").alias("keep_id"), "group_size", (wins & (F.col("copy") == 1)).alias("kept"), "text_sha256", "n_chars")


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import read

    return dedup(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
g AS (SELECT t, count(*) AS group_size FROM d GROUP BY t),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS rn, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(t) AS text_sha256 FROM r JOIN g USING (t)
"""
