"""Shortest-pack-first histogram packing.

Documents become token ids, are cut into pieces of at most `capacity` ids, and only the histogram
of piece lengths (at most `capacity` numbers) reaches the driver. There lengths are placed from the
longest to the shortest, each on the packs with the most room, as counts of packing patterns. A
pattern's slots own ranges of ranks of their length; pieces find their slot by their rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import arrow_rows, chunks, give_back, hashed_rank, read, written

CAPACITY = 1024
#: Text of about this many bytes is encoded at once.
CHUNK = 4_000_000
#: Rows with texts in a batch at most.
BATCH = 4000
SLOTS = "length int, low long, high long, first_sequence long, offset int"


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a pack, number of such packs)]: longest lengths first, each onto the shortest packs that exist."""
    room: dict[int, list[list]] = {}  # by free space: [pack, count]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1 to {capacity}")
        placed = []
        for free in sorted((f for f in room if f >= length), reverse=True):
            packs = room[free]
            while packs and left:
                pack, count = packs[-1]
                used = min(count, left)
                placed.append((free - length, (*pack, length), used))
                left -= used
                if used == count:
                    packs.pop()
                else:
                    packs[-1][1] = count - used
            if not packs:
                del room[free]
            if not left:
                break
        while left:  # new packs, each filled with as many of this length as fit
            per = min(capacity // length, left)
            n = left // per
            placed.append((capacity - per * length, (length,) * per, n))
            left -= per * n
        for free, pack, count in placed:
            room.setdefault(free, []).append([pack, count])
    return sorted((tuple(pack), count) for packs in room.values() for pack, count in packs)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """SLOTS rows: pieces of a length whose rank is in [low, high) go to sequence first_sequence + rank - low at offset."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for pack, count in patterns:
        at = 0
        for length in pack:
            low = taken.get(length, 0)
            out.append((length, low, low + count, sequence, at))
            taken[length] = low + count
            at += length
        sequence += count
    return out


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece of each document: id, start, length, doc_tokens and ids (little-endian unsigned 32-bit). Null texts count as empty; each document ends with `end`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(vocabulary)
        for batch in (part for whole in batches for part in chunks(whole, 1, CHUNK)):
            offsets, ids = coder.encode(batch.column(1))
            flat = np.insert(ids, offsets[1:], np.uint32(end)).astype("<u4")
            size = np.diff(offsets) + 1
            count = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), count)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * capacity
            length = np.minimum(capacity, size[doc] - start)
            edges = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * 4
            data = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(flat)])
            columns = [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(size[doc]), data]
            yield pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "doc_tokens", "ids"])
        give_back()

    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(cut, "id long, start long, length int, doc_tokens long, ids binary")


def place(pieced: DataFrame, keep: list[str], capacity: int = CAPACITY) -> DataFrame:
    """The columns `keep` of a table of pieces (it must be one that reads the same each time) with sequence_id and offset.

    Ranks are dealt by hash within each length, so a length that a third of all rows share is
    ranked by many tasks. The slots are at most a few for each length; they are broadcast.
    """
    spark = pieced.sparkSession
    histogram = {r["length"]: r["n"] for r in pieced.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = slots(pack_histogram(histogram, capacity))
    frame = spark.createDataFrame(table, SLOTS)
    small = F.broadcast(frame) if len(table) <= 64 * capacity else frame
    ranked = hashed_rank(pieced.select(*keep), ["length"], [c for c in keep if c != "length"], sum(histogram.values()))
    s = small.withColumnRenamed("length", "slot_length")
    fits = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    return ranked.join(s, fits).select(*keep, (F.col("first_sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def sequences(placed: DataFrame, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """The packed sequences: sequence_id, input_ids (padded to capacity), segments (1, 2, ... by piece; 0 where padded). `placed` has ids."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, seg = [], []
            for parts in batch.column(1).to_pylist():
                row, mark = np.full(capacity, pad, np.int32), np.zeros(capacity, np.int32)
                for k, p in enumerate(sorted(parts, key=lambda p: p["offset"])):
                    data = np.frombuffer(p["ids"], "<u4")
                    row[p["offset"] : p["offset"] + len(data)] = data
                    mark[p["offset"] : p["offset"] + len(data)] = k + 1
                out.append(row)
                seg.append(mark)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind), pa.array(seg, kind)], ["sequence_id", "input_ids", "segments"])

    grouped = placed.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "ids")).alias("parts"))
    return grouped.mapInArrow(build, "sequence_id long, input_ids array<int>, segments array<int>")


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0, vocabulary: str | None = None) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts count as empty (one piece that holds `end`); null ids stay null; rows that share an id or are repeated in full are documents of their own. Reads id_col and text alone, so
    other columns don't matter. An empty table gives no rows.
    """
    with arrow_rows(docs.sparkSession, BATCH):
        pieced = written(pieces(docs, id_col, text, capacity, end, vocabulary), "pieces")
    pieced = pieced.withColumn("ids_crc32", F.crc32("ids"))
    return place(pieced, ["id", "start", "length", "ids_crc32", "doc_tokens"], capacity)


def result(packed: DataFrame) -> DataFrame:
    return packed.select(F.col("id").alias("doc_id"), "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return result(pack(read(spark, sf_dir, "documents")))


