"""Shard lists, tar shards, sample metadata and work lists."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGES = ("png", "jpg", "jpeg", "webp")
METADATA = "caption string, recap string, classes array<string>, bounding_boxes array<array<double>>, scores array<double>, tags string, tag_probs array<float>"
MEMBERS = "shard string, ord long, key string, members map<string,binary>"


def braces(pattern: str) -> list[str]:
    """{00000..00099} and {a,b} expanded, first to last."""
    found = re.search(r"\{([^{}]*)\}", pattern)
    if not found:
        return [pattern]
    body = found[1]
    if span := re.fullmatch(r"(\d+)\.\.(\d+)", body):
        a, b = int(span[1]), int(span[2])
        width = len(span[1]) if span[1].startswith("0") or len(span[1]) == len(span[2]) else 0
        options = [str(k).zfill(width) for k in range(a, b + (1 if b >= a else -1), 1 if b >= a else -1)]
    else:
        options = body.split(",")
    return [x for o in options for x in braces(pattern[: found.start()] + o + pattern[found.end() :])]


def expand_urls(spark: SparkSession, urls: str, weights: str | None = None) -> DataFrame:
    """(shard_no, url, weight): sources separated by "::", each with its weight for all its shards. Raises ValueError where their numbers differ."""
    sources = urls.split("::")
    own = [float(w) for w in weights.split("::")] if weights else [1.0] * len(sources)
    if len(own) != len(sources):
        raise ValueError(f"{len(sources)} sources but {len(own)} weights")
    rows = [(u, w) for s, w in zip(sources, own, strict=True) for u in braces(s)]
    return spark.createDataFrame([(k, u, w) for k, (u, w) in enumerate(rows)], "shard_no int, url string, weight double")


def round_robin(shards: DataFrame, order: str, nodes: int, workers: int) -> DataFrame:
    """Deals shards to nodes, then each node's to its workers."""
    return shards.withColumn("node", F.pmod(F.col(order), F.lit(nodes))).withColumn("worker", F.pmod(F.floor(F.col(order) / nodes), F.lit(workers)))


def with_sizes(shards: DataFrame, sizes: DataFrame) -> DataFrame:
    """shards with n by file name; an absent size fails the job."""
    name = F.regexp_extract("url", r"([^/]*)$", 1)
    joined = shards.withColumn("name", name).join(sizes, "name", "left")
    return joined.withColumn("n", F.when(F.col("n").isNull(), F.raise_error(F.concat(F.lit("no size for "), F.col("name"))).cast("long")).otherwise(F.col("n")))


def resample(shards: DataFrame, draws: DataFrame) -> DataFrame:
    """A shard for each draw u in [0, 1), by weight. The shards, a list that the driver made, are held by every task and searched by halving."""
    listed = shards.orderBy("shard_no").select("url", "weight").collect()
    high, urls = np.cumsum([r["weight"] for r in listed]), np.array([r["url"] for r in listed], object)

    @F.pandas_udf(T.StringType())
    def pick(u: pd.Series) -> pd.Series:
        return pd.Series(urls[np.minimum(np.searchsorted(high, u.to_numpy() * high[-1], side="right"), len(urls) - 1)])

    return draws.withColumn("url", pick("u"))


def usable(members: str, text: str) -> Column:
    return F.map_contains_key(members, text) & F.arrays_overlap(F.map_keys(members), F.array(*[F.lit(x) for x in IMAGES]))


def is_image(name: Column, extensions: tuple[str, ...] = ("png", "jpg", "jpeg")) -> Column:
    """Whether a name ends in one of the extensions, in any case."""
    return F.lower(name).rlike(rf"\.({'|'.join(re.escape(x.lower()) for x in extensions)})$")


def first_present(members: str, names: tuple[str, ...] = ("jpg", "png", "jpeg", "webp")) -> Column:
    """The first member that is there."""
    return F.coalesce(*[F.try_element_at(members, F.lit(n)) for n in names])


def complete(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows none of whose columns (all, if none is named) failed, that is, is null."""
    return rows.dropna(subset=list(columns) or None)


def map_columns(rows: DataFrame, **changes: Callable[[Column], Column]) -> DataFrame:
    """Each named column by its function (of Column expressions or pandas UDFs)."""
    return rows.withColumns({c: f(F.col(c)) for c, f in changes.items()})


def overlay(base: Column, over: Column) -> Column:
    """The base map with the values that `over` has for its keys; keys that base doesn't know and nulls are left out of the overlay."""
    return F.transform_values(base, lambda k, v: F.coalesce(F.try_element_at(over, k), v))


def with_sidecar(images: DataFrame, texts: DataFrame, name: str = "name", json: str = "json", keep: bool = False) -> DataFrame:
    """images with the JSON text of the same name but for the ending; without one they are dropped, or kept with "{}"."""
    own = texts.select(F.col(name).alias("_side"), F.col(json).alias("_json"))
    joined = images.join(own, sidecar(F.col(name)) == F.col("_side"), "left" if keep else "inner")
    return joined.select(*images.columns, F.coalesce("_json", F.lit("{}")).alias(json) if keep else F.col("_json").alias(json))


def with_list(rows: DataFrame, key: str, separator: str = " | ") -> DataFrame:
    """rows whose text column `key` becomes the array of its parts."""
    return rows.withColumn(key, F.split(key, re.escape(separator)))


def metadata(rows: DataFrame, json: str, text: str = "recap") -> DataFrame:
    """rows with text ("" where absent or malformed) and classes (empty where absent) from a JSON column."""
    m = F.from_json(json, METADATA)
    return rows.withColumn("_m", m).withColumn("text", F.coalesce(F.col(f"_m.{text}"), F.lit(""))).withColumn("classes", F.coalesce("_m.classes", F.array().cast("array<string>"))).drop("_m")


def sidecar(name: Column) -> Column:
    return F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(".json"))


def to_do(shards: DataFrame, allowed: DataFrame, done: DataFrame, n_samples: int, slack: int = 2) -> DataFrame:
    """Shards on the allow-list whose written samples don't reach n_samples - slack."""
    finished = done.where(F.col("written") >= n_samples - slack).select("url")
    return shards.join(allowed, "url", "left_semi").join(finished, "url", "left_anti")


def adjacent_groups(rows: DataFrame, key: str, order: list[str], by: str) -> DataFrame:
    """Adds island: a number for each run of equal adjacent keys within by."""
    w = Window.partitionBy(by).orderBy(*order)
    new = F.coalesce((F.lag(key).over(w) != F.col(key)).cast("int"), F.lit(1))
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def tar_samples(data: bytes, lower: bool = True) -> Iterator[tuple[str, dict[str, bytes]]]:
    """(key, members by suffix) of adjacent members of a tar; a repeated suffix starts a new sample. Stops where the file is cut off."""
    key, held = None, {}
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as tar:
            for member in tar:
                base, _, name = member.name.rpartition("/")
                stem, dot, suffix = name.partition(".")
                if not member.isfile() or not dot:
                    continue
                suffix, prefix = suffix.lower() if lower else suffix, f"{base}/{stem}" if base else stem
                body = tar.extractfile(member).read()
                if prefix != key or suffix in held:
                    if held:
                        yield key, held
                    key, held = prefix, {}
                held[suffix] = body
    except (tarfile.ReadError, EOFError, OSError):
        pass
    if held:
        yield key, held


def read_tars(spark: SparkSession, path: str) -> DataFrame:
    """MEMBERS rows of all tar files under path, a task per file; corrupt files give what can be read."""

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for url, data in zip(part["path"], part["content"], strict=True):
                rows = [(url, k, key, members) for k, (key, members) in enumerate(tar_samples(data))]
                if rows:
                    yield pd.DataFrame(rows, columns=["shard", "ord", "key", "members"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(path).select("path", "content").mapInPandas(split, MEMBERS)
