"""All products of two sets of vectors, in blocks: what a block gives is reduced where it is computed, so the n x m products are never rows.

The vectors of a side are dealt to blocks of about BLOCK rows; a task multiplies two blocks at a time. The work is n x m products by nature
(each item is ranked among all); memory is two blocks and their products.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024


def blocks(vectors: DataFrame, key: str, vector: str, side: str, block: int = BLOCK) -> DataFrame:
    """A row for each block: its number, ids and vectors, with the side's letter in the names. Ids are long and unique."""
    n = vectors.count()
    parts = max(1, -(-n // block))
    one = F.struct(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return vectors.groupBy(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(parts)).alias(f"{side}_no")).agg(F.collect_list(one).alias(f"{side}_rows"))


def block_products(left: DataFrame, right: DataFrame, reduce: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str, on: tuple[str, str, str, str], block: int = BLOCK) -> DataFrame:
    """reduce(ids of left, ids of right, matrix of products) of every pair of blocks. `on` names key and vector of both sides."""
    a, b = blocks(left, on[0], on[1], "a", block), blocks(right, on[2], on[3], "b", block)
    pairs = a.crossJoin(b).repartition("a_no", "b_no").select("a_rows", "b_rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sides = []
                for c in (0, 1):
                    rows = batch.column(c).slice(k, 1).flatten()
                    ids = rows.field(0).to_numpy(zero_copy_only=False)
                    sides += [ids, rows.field(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)]
                yield reduce(sides[0], sides[2], sides[1] @ sides[3].T)

    return pairs.mapInArrow(run, schema)


def similar_pairs(vectors: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs a < b whose cosine is over threshold. A vector without length is like none."""

    def over(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        i, j = np.nonzero((s > threshold) & (a[:, None] < b[None, :]))
        return pa.RecordBatch.from_arrays([pa.array(a[i]), pa.array(b[j]), pa.array(s[i, j])], ["a", "b", "similarity"])

    from tessera.functions.vector import normalise

    unit = vectors.select(F.col(key).alias("_k"), normalise(F.col(vector)).alias("_u"))
    return block_products(unit, unit, over, "a long, b long, similarity double", ("_k", "_u", "_k", "_u"))


def true_ranks(images: DataFrame, texts: DataFrame, key: str, vector: str) -> DataFrame:
    """(direction, id, place): how many other texts are more like an image than its own text (image_to_text), and the reverse. Both sides have each id once."""
    from tessera.functions.vector import dot

    own = images.select(F.col(key).alias("id"), F.col(vector).alias("x")).join(texts.select(F.col(key).alias("id"), F.col(vector).alias("y")), "id").select("id", dot(F.col("x"), F.col("y")).alias("own"))
    known = lambda df: df.select(F.col(key).alias("id"), vector).join(own, "id").select("id", F.concat(F.transform(vector, lambda v: v.cast("double")), F.array("own")).alias("v"))

    def count(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        s = x[:, :-1] @ y[:, :-1].T
        s[a[:, None] == b[None, :]] = -np.inf
        over = [(s > x[:, -1:]).sum(axis=1), (s > y[:, -1][None, :]).sum(axis=0)]
        names = pa.array(["image_to_text"] * len(a) + ["text_to_image"] * len(b))
        return pa.RecordBatch.from_arrays([names, pa.array(np.concatenate([a, b])), pa.array(np.concatenate(over).astype(np.int64))], ["direction", "id", "n"])

    a, b = blocks(known(images), "id", "v", "a"), blocks(known(texts), "id", "v", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sides = [batch.column(c).slice(k, 1).flatten() for c in (0, 1)]
                ids = [r.field(0).to_numpy(zero_copy_only=False) for r in sides]
                yield count(*ids, *(r.field(1).flatten().to_numpy(zero_copy_only=False).reshape(len(i), -1) for r, i in zip(sides, ids, strict=True)))

    parts = a.crossJoin(b).repartition("a_no", "b_no").select("a_rows", "b_rows").mapInArrow(run, "direction string, id long, n long")
    return parts.groupBy("direction", "id").agg(F.sum("n").alias("place"))
