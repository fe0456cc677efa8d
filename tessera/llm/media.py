"""Media columns: TIFF files in a binary column, one row per page.

Files are decoded where they lie, page by page; a column of files is never shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import tiff
from tessera.llm.common import read

ACROSS, PAGE_ROWS = 64, 16_384
PAGES = "id long, page int, width int, height int, channels int, compression int, predictor int, tiled boolean, samples binary, error string"


def pages(files: DataFrame, id_col: str, media: str) -> DataFrame:
    """A row for each page of each file (PAGES); a page that can't be read gives a row with its error, and the next ones follow as long as their offsets can be read.

    Null files give no rows, empty and damaged ones one with an error. Rows with equal ids or files are rows of their own; other columns are not read; an empty table gives none."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PAGES.split(", ")]
        kinds = [pa.int64(), *[pa.int32()] * 6, pa.bool_(), pa.binary(), pa.string()]
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                if data is not None:
                    for p in tiff.read_pages(data):
                        if isinstance(p, ValueError):
                            rows.append((i, len(rows), None, None, None, None, None, None, None, str(p)))
                        else:
                            rows.append((i, p.number, p.width, p.height, p.channels, p.compression, p.predictor, p.tiled, p.samples.tobytes(), None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select(F.col(id_col).cast("long"), F.col(media)).mapInArrow(decode, PAGES)


def payload(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, these with bytes 0 up to a positive multiple of 64)."""
    data = (text or "").encode()
    return len(data), data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def stored(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes and media of every row (null texts are empty; equal texts give equal files; other columns are not read): each text as a TIFF of 64 grey samples a row, deflated, with the horizontal predictor; a page holds PAGE_ROWS rows."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 500):
                made = [payload(t) for t in texts[at : at + 500]]
                files = []
                for _, data in made:
                    image = np.frombuffer(data, np.uint8).reshape(-1, ACROSS)
                    files.append(tiff.encode([image[k : k + PAGE_ROWS] for k in range(0, len(image), PAGE_ROWS)]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 500], pa.array([n for n, _ in made], pa.int64()), pa.array(files, pa.binary())], ["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(write, "id long, n_bytes long, media binary")


def features(files: DataFrame) -> DataFrame:
    """From stored(): id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, all of what the decoded pages hold. One row per row: null ids stay null, equal files have equal values."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for data in batch.column(2).to_pylist():
                digest, size, count, tail, shape = hashlib.sha256(), 0, np.zeros(256, np.int64), b"", []
                for page in tiff.decode_pages(data):
                    raw = page.samples.tobytes()
                    digest.update(raw)
                    size, tail = size + len(raw), (tail + raw[-64:])[-64:]
                    count += np.bincount(page.samples.ravel(), minlength=256)
                    shape.append(f"{page.width}x{page.height}")
                eighths = ",".join(map(str, (count.reshape(8, 32).sum(axis=1) * 10_000 // size).tolist()))
                mean = int((count * np.arange(256)).sum()) * 1000 // size
                feature = f"pages={'+'.join(shape)};mean={mean};parts={eighths};histogram={xxhash.xxh3_64_hexdigest(count.tobytes())}"
                for column, value in zip(columns, (size, digest.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    kinds = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return files.select("id", "n_bytes", "media").mapInArrow(describe, kinds)


def op7_media_columns(spark, sf_dir: str) -> DataFrame:
    return features(stored(read(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")
