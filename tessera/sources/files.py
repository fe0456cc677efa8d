"""Captions, vocabularies, tags and annotations in files, and the choice of a reader by the path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.tagging import DEFAULT_THRESHOLD, multi_hot
from tessera.sources import tars

#: Caption of synthetic rows (fixed value).
DUMMY = "Dummy caption"


def read_pairs(spark: SparkSession, path: str, image: str = "filepath", caption: str = "title", sep: str = "\t") -> DataFrame:
    """(image path, caption) of a separated file with a header; only these two columns are read."""
    return spark.read.option("sep", sep).option("header", True).csv(path).select(F.col(image).alias("filepath"), F.col(caption).alias("caption"))


def synthetic(spark: SparkSession, rows: int, caption: str = DUMMY, side: int = 224) -> DataFrame:
    """`rows` equal rows: caption and an all-zero image of side x side pixels, given by its size."""
    return spark.range(rows).select(F.col("id"), F.lit(caption).alias("caption"), F.lit(side).alias("width"), F.lit(side).alias("height"))


def class_folders(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """(path, name, class_id[, content]) of files in a folder for each class; ids in the order of the folders' names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("name"), *(["content"] if content else []))
    names = named.select("name").distinct()
    numbered = names.select("name", (F.row_number().over(Window.orderBy("name")) - 1).alias("class_id"))  # a row for each class
    return named.join(numbered, "name")


def whole_files(spark: SparkSession, path: str | list[str], suffix: str = "") -> DataFrame:
    """(file, text), a row for each file."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return rows.where(F.col("file").endswith(suffix)) if suffix else rows


def _parsed(c: Column, schema: str, strict: bool) -> Column:
    parsed = F.from_json(c, schema)
    return F.when(parsed.isNull() & c.isNotNull(), F.raise_error(F.lit("malformed JSON")).cast(schema)).otherwise(parsed) if strict else parsed


def json_folder(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(filename, classes) of a folder with a JSON file for each image; the image is the .jpg of that name. Absent classes are empty; malformed files end the job (strict) or are without classes."""
    rows = whole_files(spark, path, ".json")
    ok = F.try_parse_json("text").isNotNull()
    classes = F.coalesce(F.from_json("text", "classes array<string>")["classes"], F.array().cast("array<string>"))
    if strict:
        classes = F.when(ok, classes).otherwise(F.raise_error(F.concat(F.lit("malformed JSON in "), F.col("file"))).cast("array<string>"))
    return rows.select(F.replace("file", F.lit(".json"), F.lit(".jpg")).alias("filename"), classes.alias("classes"))


def caption_map(spark: SparkSession, path: str) -> DataFrame:
    """(filename, caption) of files that hold one object of captions by name."""
    return whole_files(spark, path).select(F.explode(F.from_json("text", "map<string,string>")).alias("filename", "caption"))


def vocabulary_entries(lists: DataFrame, entries: str = "entries") -> DataFrame:
    """(ord, concept, value) of a row with an array of maps from concept to value: a concept that comes again keeps its first place and takes its last value."""
    each = lists.select(F.posexplode(entries).alias("p", "m")).select("p", F.posexplode(F.map_entries("m")).alias("q", "e"))
    place = F.struct("p", "q")
    found = each.groupBy(F.col("e.key").alias("concept")).agg(F.min(place).alias("first"), F.max_by("e.value", place).alias("value"))
    return found.select(F.col("first.p").cast("long").alias("ord"), F.col("first.q").alias("sub"), "concept", "value")


def vocabulary_file(spark: SparkSession, path: str) -> DataFrame:
    """vocabulary_entries() of a JSON file: a list of objects that map a concept to its descriptions."""
    return vocabulary_entries(whole_files(spark, path).select(F.from_json("text", "array<map<string,array<string>>>").alias("entries")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(k, line) of one text file; an empty last line is none. The file is a list of tags or the like, and fits a row."""
    return whole_files(spark, path).select(F.posexplode(F.split(F.regexp_replace("text", r"\r?\n\z", ""), r"\r?\n")).alias("k", "line"))


def tag_table(tags: DataFrame, thresholds: DataFrame | None = None, default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """(k, tag, threshold) of numbered tags (k, line) and thresholds (k, line); absent or unreadable thresholds are the default."""
    named = tags.select("k", F.col("line").alias("tag"))
    if thresholds is None:
        return named.withColumn("threshold", F.lit(default))
    own = thresholds.select("k", F.expr("try_cast(trim(line) AS double)").alias("threshold"))
    return named.join(own, "k", "left").select("k", "tag", F.coalesce("threshold", F.lit(default)).alias("threshold"))


def annotations(rows: DataFrame, n_labels: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """rows (image_path, caption array, union_label_id, parse_label_id) with one caption, its parsed labels and multi-hot labels. Which caption is taken follows from seed, epoch and the path."""
    n = F.size("caption")
    at = (F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), "image_path"), F.greatest(n, F.lit(1))) + 1).cast("int")
    parsed = F.try_element_at("parse_label_id", at)
    return rows.select("image_path", F.try_element_at("caption", at).alias("text"), multi_hot(F.col("union_label_id"), n_labels).alias("image_tags"), multi_hot(parsed, n_labels).alias("text_tags"))


def annotation_files(spark: SparkSession, paths: list[str], n_labels: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """annotations() of JSON files, each a list, one after another."""
    schema = "image_path string, caption array<string>, union_label_id array<int>, parse_label_id array<array<int>>"
    return annotations(spark.read.schema(schema).option("multiLine", True).json(paths), n_labels, seed, epoch)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, built and written first if it isn't there (complete)."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def existing(spark: SparkSession, shards: DataFrame, folder: str, url: str = "url") -> DataFrame:
    """The shards whose file is in the folder (listed without being read)."""
    there = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("_name")).distinct()
    return shards.join(there, F.regexp_extract(url, r"([^/]*)$", 1) == F.col("_name"), "left_semi")


READERS: dict[str, Callable[..., DataFrame]] = {
    "csv": lambda spark, path, **o: read_pairs(spark, path, **({"sep": "\t"} | o)),
    "tar": lambda spark, path, **o: tars.read_samples(spark, path, **o),
    "synthetic": lambda spark, path, **o: synthetic(spark, **o),
    "json": lambda spark, path, **o: json_folder(spark, path, **o),
    "parquet": lambda spark, path, **o: spark.read.parquet(path),
}


def open_source(spark: SparkSession, path: str, kind: str = "auto", **options) -> DataFrame:
    """The source of a kind (csv, tar, synthetic, json, parquet), or by the path's ending; ValueError where that tells nothing."""
    if kind == "auto":
        ending = path.rstrip("/").rpartition(".")[2].lower()
        kind = {"csv": "csv", "tsv": "csv", "tar": "tar", "json": "json", "parquet": "parquet"}.get(ending, "")
    if kind not in READERS:
        raise ValueError(f"no reader for {path}")
    return READERS[kind](spark, path, **options)


def splits(spark: SparkSession, **sources: dict) -> dict[str, DataFrame]:
    """The named splits (train, val, ...) of open_source() arguments; those that are None are left out."""
    return {name: open_source(spark, **given) for name, given in sources.items() if given is not None}
