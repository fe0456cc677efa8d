"""Tar shards as a data source: a task for each shard, which reads member by member and holds one sample at a time.

What can't be read is not lost in silence: with option errors=keep a shard or sample that fails gives a row whose `error` says why, to be counted or logged; with errors=drop (the
default) such rows are left out.
"""

from __future__ import annotations

import json
import tarfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: File name endings of images (fixed values).
EXTENSIONS = ("png", "jpg", "jpeg")
SAMPLES = "shard string, ord long, key string, members map<string,binary>, error string"
IMAGES = "shard string, ord long, name string, image binary, json string, error string"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_files(path: str, suffix: str = ".tar") -> list[str]:
    """The files at a path (a file, or all in a folder, by name) that end in suffix."""
    from pyarrow import fs

    store, base = _store(path)
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    info = store.get_file_info(base)
    if info.type == fs.FileType.File:
        return [path]
    if info.type != fs.FileType.Directory:
        return []
    found = store.get_file_info(fs.FileSelector(base))
    return sorted((scheme if not scheme or x.path.startswith("/") else scheme) + x.path for x in found if x.type == fs.FileType.File and x.path.endswith(suffix))


def members(path: str, limits: list[str]) -> Iterator[tuple[str, bytes]]:
    """(name, content) of a tar's files, one after another. Ends where the file is cut off, with the reason appended to limits."""
    store, base = _store(path)
    try:
        with store.open_input_stream(base) as source, tarfile.open(fileobj=source, mode="r|*") as tar:
            for m in tar:
                if m.isfile():
                    body = tar.extractfile(m).read()
                    if len(body) < m.size:
                        raise tarfile.ReadError("unexpected end of data")
                    yield m.name, body
    except (tarfile.TarError, EOFError, OSError) as e:
        limits.append(f"{type(e).__name__}: {e}")


def grouped(found: Iterator[tuple[str, bytes]], lower: bool = True) -> Iterator[tuple[str, dict[str, bytes]]]:
    """(key, contents by suffix) of adjacent members with one stem; a suffix that comes again starts a new sample."""
    key, held = None, {}
    for path, body in found:
        base, _, name = path.rpartition("/")
        stem, dot, suffix = name.partition(".")
        if not dot:
            continue
        suffix, prefix = suffix.lower() if lower else suffix, f"{base}/{stem}" if base else stem
        if prefix != key or suffix in held:
            if held:
                yield key, held
            key, held = prefix, {}
        held[suffix] = body
    if held:
        yield key, held


def images(path: str, extensions: tuple[str, ...], mode: str, limits: list[str]) -> Iterator[tuple[int, str, bytes, str | None, str | None]]:
    """(place, name, image, JSON text, error) of a tar's images by name, with the JSON file of the same stem. mode "drop": an image whose JSON is absent or malformed is an error; "permissive": it has "{}"; "none": JSON isn't read."""
    store, base = _store(path)
    try:
        with store.open_input_file(base) as source, tarfile.open(fileobj=source) as tar:
            by_name = {}
            try:
                for m in tar:
                    by_name[m.name] = m
            except (tarfile.TarError, EOFError, OSError) as e:
                limits.append(f"{type(e).__name__}: {e}")
            names = sorted(n for n, m in by_name.items() if m.isfile() and n.lower().endswith(tuple("." + x for x in extensions)))
            for k, name in enumerate(names):
                try:
                    image = tar.extractfile(by_name[name]).read()
                    if len(image) < by_name[name].size:
                        raise tarfile.ReadError("unexpected end of data")
                except (tarfile.TarError, EOFError, OSError) as e:
                    yield k, name, None, None, f"{type(e).__name__}: {e}"
                    continue
                text, error = "{}", None
                if mode != "none":
                    try:
                        text = tar.extractfile(by_name[name.rsplit(".", 1)[0] + ".json"]).read().decode()
                        json.loads(text)
                    except (KeyError, ValueError, tarfile.TarError, EOFError, OSError) as e:
                        text, error = ("{}", None) if mode == "permissive" else (None, f"{type(e).__name__}: {e}")
                yield k, name, image, text, error
    except (tarfile.TarError, EOFError, OSError) as e:
        limits.append(f"{type(e).__name__}: {e}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        paths = [p for p in self.options.get("path", "").split("\n") if p]
        return [InputPartition(f) for p in paths for f in list_files(p)] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        shard, limits = partition.value, []
        if not shard:
            return
        keep = self.options.get("errors", "drop") == "keep"
        if self.options.get("rows", "samples") == "images":
            extensions = tuple(x.strip(" .").lower() for x in self.options.get("extensions", ",".join(EXTENSIONS)).split(","))
            for place, name, image, text, error in images(shard, extensions, self.options.get("json", "drop"), limits):
                if error is None or keep:
                    yield shard, place, name, image, text, error
            if keep:
                yield from ((shard, None, None, None, None, e) for e in limits)
            return
        for place, (key, held) in enumerate(grouped(members(shard, limits), self.options.get("lower", "true") == "true")):
            yield shard, place, key, held, None
        if keep:
            yield from ((shard, None, None, None, e) for e in limits)


class TarShards(DataSource):
    """format("tar_shards"): path (one or several, by line feeds), rows (samples or images), errors (drop or keep); of images: extensions, json (drop, permissive, none); of samples: lower."""

    @classmethod
    def name(cls) -> str:
        return "tar_shards"

    def schema(self) -> str:
        return IMAGES if self.options.get("rows", "samples") == "images" else SAMPLES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_samples(spark: SparkSession, paths: str | list[str], errors: str = "drop", **options: str) -> DataFrame:
    """SAMPLES of all tar files at the paths."""
    spark.dataSource.register(TarShards)
    return spark.read.format("tar_shards").options(rows="samples", errors=errors, **options).option("path", paths if isinstance(paths, str) else "\n".join(paths)).load()


def read_images(spark: SparkSession, paths: str | list[str], json: str = "drop", extensions: tuple[str, ...] = EXTENSIONS, errors: str = "drop") -> DataFrame:
    """IMAGES of all tar files at the paths, by name within a shard."""
    spark.dataSource.register(TarShards)
    reader = spark.read.format("tar_shards").options(rows="images", errors=errors, json=json, extensions=",".join(extensions))
    return reader.option("path", paths if isinstance(paths, str) else "\n".join(paths)).load()


def caption_rows(rows: DataFrame) -> DataFrame:
    """(name, image, caption, classes) of read_images rows; absent captions are null, absent classes empty."""
    m = F.from_json("json", "caption string, classes array<string>")
    return rows.select("name", "image", m["caption"].alias("caption"), F.coalesce(m["classes"], F.array().cast("array<string>")).alias("classes"))


def member_counts(paths: list[str], spark: SparkSession) -> DataFrame:
    """(shard, files) of each tar: how many regular files can be read."""

    def count(parts):
        import pandas as pd

        for part in parts:
            yield pd.DataFrame({"shard": part["shard"], "files": [sum(1 for _ in members(p, [])) for p in part["shard"]]})

    return spark.createDataFrame([(p,) for p in paths], "shard string").repartition(max(1, len(paths))).mapInPandas(count, "shard string, files long")
