"""Token ids as Arrow IPC files of fixed-size-list batches.

Documents are sorted by id across shards (range partitions), encoded, ended with an end id and
laid end to end; each shard is one Arrow file whose batches hold equal-length sequences and masks
as fixed-size lists (16-bit ids where the vocabulary allows), so sequence k is reached by arithmetic alone and read without a copy from a
memory map. A second Arrow file per shard has each document's place. The files lie in a shared
folder; a manifest table lists those of the attempts that were committed, so a task that ran twice
or was lost leaves nothing that is read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import chunks, read, scratch, written

#: Ids of a sequence, and sequences of a batch.
LENGTH, ROWS = 1024, 256
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


class _Shard:
    """Writes one shard with the memory of one batch."""

    def __init__(self, folder: str, name: str, length: int, rows: int, kind: pa.DataType):
        store, base = _filesystem(folder)
        store.create_dir(base, recursive=True)
        self.name, self.length, self.rows, self.total, self.docs = name, length, rows, 0, 0
        self.sinks = [store.open_output_stream(f"{base}/{name}.arrow"), store.open_output_stream(f"{base}/{name}.index.arrow")]
        self.ids, self.index = pa.ipc.new_file(self.sinks[0], _schema(length, kind)), pa.ipc.new_file(self.sinks[1], INDEX)
        self.kind = kind.to_pandas_dtype()
        self.rest = np.zeros(0, self.kind)

    def _write(self, flat: np.ndarray, used: int) -> None:
        mask = np.arange(len(flat)) < used
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.ids.write_batch(pa.RecordBatch.from_arrays(lists, ["ids", "mask"]))

    def add(self, docs: pa.Array, counts: np.ndarray, flat: np.ndarray) -> None:
        starts = self.total + np.cumsum(counts) - counts
        self.index.write_batch(pa.RecordBatch.from_arrays([docs.cast(pa.int64()), pa.array(starts), pa.array(counts)], schema=INDEX))
        self.total, self.docs = self.total + int(counts.sum()), self.docs + len(docs)
        data, size = np.concatenate([self.rest, flat.astype(self.kind)]), self.length * self.rows
        whole = len(data) // size * size
        for at in range(0, whole, size):
            self._write(data[at : at + size], size)
        self.rest = data[whole:]

    def close(self) -> None:
        if len(self.rest):
            padded = -(-len(self.rest) // self.length) * self.length
            self._write(np.concatenate([self.rest, np.zeros(padded - len(self.rest), self.kind)]), len(self.rest))
        for x in (self.ids, self.index, *self.sinks):
            x.close()


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text: str = "text", end: int = 2, length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """Writes the shards and returns the manifest: shard, name, n_docs, n_tokens, first_token (ids in earlier shards).

    Null ids come first; rows with equal ids are ordered by a hash of their text; null texts are empty (one end id).
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = tokens.encoder(vocabulary), None
        number = TaskContext.get().partitionId()
        kind = pa.uint16() if max(coder.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else pa.uint32()
        for batch in (part for whole in batches for part in chunks(whole, 1)):
            shard = shard or _Shard(folder, f"shard-{number:06d}-{uuid.uuid4().hex}", length, ROWS, kind)
            offsets, ids = coder.encode(batch.column(1))
            flat = np.insert(ids, offsets[1:], np.uint32(end))
            shard.add(batch.column(0), np.diff(offsets) + 1, flat)
        if shard:
            shard.close()
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([shard.name]), pa.array([shard.docs], pa.int64()), pa.array([shard.total], pa.int64())], ["shard", "name", "n_docs", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text"))
    order = [F.col("_id"), F.xxhash64("_text"), F.col("_text")]
    sorted_rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    manifest = written(sorted_rows.mapInArrow(write, "shard long, name string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return manifest.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def open_shard(folder: str, name: str) -> pa.ipc.RecordBatchFileReader:
    """A shard's sequences: get_batch(k // ROWS) holds sequence k at k % ROWS. Local folders are mapped, not read."""
    if folder.startswith("file:") or "://" not in folder:
        _, base = _filesystem(folder)
        return pa.ipc.open_file(pa.memory_map(f"{base}/{name}.arrow"))
    store, base = _filesystem(folder)
    return pa.ipc.open_file(store.open_input_file(f"{base}/{name}.arrow"))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _filesystem(folder)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = open_shard(folder, name)
                held, ids, size = -1, None, 0
                with store.open_input_file(f"{base}/{name}.index.arrow") as source, pa.ipc.open_file(source) as index:
                    for k in range(index.num_record_batches):
                        docs = index.get_batch(k)
                        sums = []
                        for start, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist(), strict=True):
                            value, at = 0, start
                            while at < start + n:
                                size = size or len(data.get_batch(0).column(0).values)
                                if at // size != held:
                                    held = at // size
                                    ids = data.get_batch(held).column(0).values.to_numpy()
                                low = at % size
                                high = min(low + start + n - at, size)
                                value = zlib.crc32(ids[low:high].astype("<u4"), value)
                                at += high - low
                            sums.append(value)
                        yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(docs.column(1).to_numpy() + first), docs.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = manifest.sparkSession.sparkContext.defaultParallelism * 2
    return manifest.select("name", "first_token").repartition(shards).mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_arrow_output(spark, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "arrow")
    return read_tokens(write_tokens(read(spark, sf_dir, "documents"), folder), folder)
