"""Shared pieces of the corpus operators: the shared folder, written tables, skew-proof ranks."""

from __future__ import annotations

import atexit
import ctypes
import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one rank bucket holds at most on average, and the least number of buckets.
BUCKET_ROWS, MIN_BUCKETS = 20_000, 256
#: Of tables without texts: files for each core that are never put together, and bytes of the inputs that a file stands for at least.
FILES, FILE_BYTES = 4, 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where none is set, a folder of its own if all runs on this machine, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc

    def drop() -> None:
        try:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone by then
            return

    atexit.register(drop)
    return path


def bytes_read(df: DataFrame) -> int:
    """Bytes of the tables that df is made from, as Spark knows them without a job."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def written(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it again.

    few: where much less than FILE_BYTES would come to each file, partitions are joined, to FILES a core at least; for rows of ids and numbers. In a
    local folder Hadoop starts two processes (chmod) for each file, and until such a process is under way it counts as large as the executor.
    """
    path = scratch(df.sparkSession, name)
    if few:
        df = df.coalesce(max(FILES * df.sparkSession.sparkContext.defaultParallelism, min(bytes_read(df) // FILE_BYTES, 1_000_000)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, batches that go to Python have `rows` rows at most (for rows that hold texts)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Returns freed memory to the system; Python workers live on between tasks and would hold it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def chunks(batch: pa.RecordBatch, columns: int | tuple[int, ...], most: int = 10_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text columns together hold about `most` bytes at most (or one row), so that memory stays bounded."""
    each = [pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ((columns,) if isinstance(columns, int) else columns)]
    sizes = np.sum(each, axis=0)
    edges = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def buckets_for(rows: int) -> int:
    return max(MIN_BUCKETS, math.ceil(rows / BUCKET_ROWS))


def hashed_rank(df: DataFrame, keys: list[str], order: list[str], rows: int, seed: int = 0, rank: str = "rank") -> DataFrame:
    """Adds a 0-based rank of each row among those with the same keys, in a seeded hash order.

    No key is ranked by one task: rows of a key are dealt to buckets by hash, ranked within the
    bucket, and the buckets' sizes (pre-aggregated) give the offsets. Rows equal in all of `order`
    are interchangeable. Null keys are keys of their own.
    """
    n = buckets_for(rows)
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), *order), F.lit(n)).cast("int"))
    parts = [*keys, "_bucket"]
    sizes = dealt.groupBy(*parts).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(parts)], F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*parts).orderBy(F.xxhash64(F.lit(seed + 1), *order), *order)
    ranked = dealt.withColumn("_within", F.row_number().over(within) - 1)
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(parts)]
    joined = ranked.join(offsets, same[0] if len(same) == 1 else all_of(same), "inner")
    return joined.withColumn(rank, F.col("_within") + F.col("_offset")).drop("_bucket", "_within", "_offset", *[f"_k{i}" for i in range(len(parts))])


def all_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
