"""Tags and boxes of images from model outputs: thresholds, captions of tags, phrases, multi-hot labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import ends_with_stop, strip
from tessera.functions.vector import sigmoid

#: Threshold of a tag that has none of its own.
DEFAULT_THRESHOLD = 0.68


def chosen_tags(logits: DataFrame, tags: DataFrame, key: str, default: float = DEFAULT_THRESHOLD, delete: Iterable[int] = (), separator: str = " | ") -> DataFrame:
    """(key, tags): the tags whose probability is over their threshold, joined in the order of their numbers; '' where none is. logits: key, k, logit; tags: k, tag, threshold (null: default)."""
    own = logits.join(tags, "k").withColumn("_on", (sigmoid(F.col("logit")) > F.coalesce("threshold", F.lit(default))) & ~F.col("k").isin([*delete, -1]))
    names = F.array_sort(F.collect_list(F.when(F.col("_on"), F.struct("k", "tag"))))
    return own.groupBy(key).agg(F.array_join(F.transform(names, lambda x: x["tag"]), separator).alias("tags"))


def tag_caption(logits: DataFrame, tags: DataFrame, key: str, floor: float, most: int = 500) -> DataFrame:
    """(key, caption): the best tags by logit, as many as are over the probability `floor` (one at least, `most` at most), as a list that ends in a stop."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("logit")).alias("n"), "k", "tag")))
    own = logits.join(tags, "k").groupBy(key).agg(order.alias("_o"), F.greatest(F.lit(1), F.count_if(sigmoid(F.col("logit")) > floor)).cast("int").alias("_n"))
    return own.select(key, ends_with_stop(F.array_join(F.transform(F.slice("_o", F.lit(1), F.least("_n", F.lit(most))), lambda x: x["tag"]), " ,")).alias("caption"))


def candidates(caption: Column) -> Column:
    """The classes that a tag caption lists."""
    return F.transform(F.split(F.regexp_replace(caption, r"\.$", ""), " ,"), strip)


def kept_boxes(boxes: DataFrame, threshold: float, logits: str = "logits") -> DataFrame:
    """Boxes whose best token logit is over the threshold, with it as score."""
    return boxes.withColumn("score", F.array_max(logits)).where(F.col("score") > threshold)


def phrase_classes(boxes: DataFrame, phrase: str = "phrase", classes: str = "candidates", least: float = 0.0) -> DataFrame:
    """Boxes with label: the candidate class most like the phrase (shared words over all words, then edit similarity, then the name); boxes whose phrase shares no word with any are dropped."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\s+"))

    def match(c: Column) -> Column:
        both, every = F.size(F.array_intersect(words(c), words(F.col(phrase)))), F.size(F.array_union(words(c), words(F.col(phrase))))
        longest = F.greatest(F.length(c), F.length(F.col(phrase)), F.lit(1))
        return F.struct((-both / every).alias("a"), (F.levenshtein(F.lower(c), F.lower(F.col(phrase))) / longest).alias("b"), c.alias("c"))

    best = F.array_min(F.transform(classes, match))
    return boxes.withColumn("_best", best).where(-F.col("_best.a") > least).withColumn("label", F.col("_best.c")).drop("_best")


def multi_hot(ids: Column, n: int) -> Column:
    """An array of n zeros with ones at the ids (null: none); ids outside are left out."""
    own = F.coalesce(ids, F.array().cast("array<int>"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.array_contains(own, k).cast("int"))


def tag_numbers(rows: DataFrame, tags: DataFrame, tag: str = "tag") -> DataFrame:
    """rows with k, a row for each number that the tag has in the list (a tag may stand there more than once)."""
    return rows.join(tags.select(F.col("tag").alias(tag), "k"), tag)


def collected(boxes: DataFrame, image: str) -> DataFrame:
    """(image, boxes, labels, scales): all boxes of an image, its distinct labels and scales, sorted."""
    all_ = F.array_sort(F.collect_list(F.struct("scale", "idx", "x1", "y1", "x2", "y2", "score", "label")))
    return boxes.groupBy(image).agg(all_.alias("boxes"), F.array_sort(F.collect_set("label")).alias("labels"), F.array_sort(F.collect_set("scale")).alias("scales"))


def distinct_labels(lists: Column) -> Column:
    """The different labels of several lists, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(lists)))


def with_detections(samples: DataFrame, detections: DataFrame, name: str = "filename") -> DataFrame:
    """samples whose metadata gets the detection's fields (they replace fields of the same name); samples without detections keep theirs."""
    fields = [c for c in detections.columns if c != name]
    own = detections.select(F.col(name).alias("_name"), *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_there"))
    joined = samples.join(own, F.col(name) == F.col("_name"), "left")
    there = F.col("_there").isNotNull()
    new = [F.when(there, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in samples.columns else F.col(f"_{c}").alias(c) for c in fields]
    return joined.select(*[c for c in samples.columns if c not in fields], *new)
