"""What annotation and evaluation runs leave: a JSON file per sample, tables by shard, vocabularies, results."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def pretty(fields: dict) -> str:
    """An object with a line for each field; arrays stay on their line."""

    lines = ",\n".join(f"    {json.dumps(k)}: {json.dumps(v, ensure_ascii=False, default=str)}" for k, v in fields.items())
    return "{\n" + lines + "\n}" if fields else "{}"


def write_samples(samples: DataFrame, folder: str, name: str = "filename") -> DataFrame:
    """Writes <stem>.json for each sample with its other columns; returns (file, bytes). Files get their names when they are complete, so a task that is run again leaves whole files. Of equal names one is left."""
    columns = [c for c in samples.columns if c != name]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            names, sizes = [], []
            for row in batch.to_pylist():
                file = row[name].rsplit("/", 1)[-1].rsplit(".", 1)[0] + ".json"
                body = pretty({c: row[c] for c in columns}).encode()
                temporary = f"{base}/.{file}.{uuid.uuid4().hex}"
                with store.open_output_stream(temporary) as sink:
                    sink.write(body)
                store.move(temporary, f"{base}/{file}")
                names.append(file)
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["file", "bytes"])

    return samples.mapInArrow(write, "file string, bytes long")


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key by order."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*key).agg(F.max_by(whole, order).alias("_r")).select("_r.*")


def write_by_shard(rows: DataFrame, folder: str, shard: str = "shard", key: str = "filename", order: str | None = None) -> None:
    """A folder for each shard; of rows with one key in a shard the last by order is left. Shards that are written again are replaced, others stay."""
    own = latest(rows, [shard, key], order) if order else rows
    own.repartition(shard).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard).parquet(folder)


def write_vocabulary(entries: DataFrame, folder: str) -> None:
    """A file with a JSON list of one-entry objects (concept to value) in the order of ord. One task writes it, since it is one file."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for line in batch.column(0).to_pylist():
                if held is not None:
                    out.append(held if held == "[" else held + ",")
                held = line
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["line"])
        yield pa.RecordBatch.from_arrays([pa.array([held, "]"], pa.string())], ["line"])

    one = entries.select(F.col("ord").cast("long").alias("ord"), F.to_json(F.map_from_arrays(F.array("concept"), F.array("value"))).alias("line"))
    opened = entries.sparkSession.createDataFrame([(None, "[")], "ord long, line string").unionByName(one)
    opened.repartition(1).sortWithinPartitions("ord").select("line").mapInArrow(lines, "line string").write.mode("overwrite").text(folder)


def append_result(spark: SparkSession, folder: str, **values) -> None:
    """One more line of results."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(folder)


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.json(folder)


def merged(rows: DataFrame, rank: str = "rank", position: str = "pos", key: str | None = None) -> DataFrame:
    """Rows of all ranks with place, their number in the order of rank and position; with a key the first of each."""
    own = rows
    if key:
        own = rows.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(rank, position)).alias("_r")).select("_r.*")
    sizes = own.groupBy(rank).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)  # a row for each rank
    offsets = sizes.select(rank, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return own.join(offsets, rank).withColumn("place", F.col("_before") + F.row_number().over(Window.partitionBy(rank).orderBy(position)) - 1).drop("_before")


def save_result(rows: DataFrame, folder: str, rank: str = "rank", position: str = "pos", key: str | None = None) -> DataFrame:
    """Writes the ranks' rows to folder/ranks, a folder for each, and what merged() makes of them to folder/merged; returns the latter."""
    rows.write.mode("overwrite").partitionBy(rank).parquet(f"{folder}/ranks")
    whole = rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/ranks")
    merged(whole, rank, position, key).write.mode("overwrite").parquet(f"{folder}/merged")
    return rows.sparkSession.read.parquet(f"{folder}/merged")


def scalars(metrics: DataFrame, step: str, names: list[str]) -> DataFrame:
    """(step, name, value), a row for each metric of each step."""
    return metrics.unpivot(step, names, "name", "value") if len({dict(metrics.dtypes)[n] for n in names}) == 1 else metrics.select(step, *[F.col(n).cast("double") for n in names]).unpivot(step, names, "name", "value")
