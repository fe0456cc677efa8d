"""Boxes: overlap, corners, suppression, weighted fusion, the cross-class filter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CORNERS = ("x1", "y1", "x2", "y2")


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of (x1, y1, x2, y2) boxes; 0 where the union is empty."""
    width = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    height = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    both = width * height
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def corners(cx: Column, cy: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    """Centre and size to corners; the far corner derives from the near one."""
    x1, y1 = cx - w / 2, cy - h / 2
    return x1, y1, x1 + w, y1 + h


def overlap_filter(boxes: DataFrame, image: str = "image_id", threshold: float = 0.5) -> DataFrame:
    """Drops a box that a box of another label in its image overlaps by more than threshold with a higher score (or an equal one and a later idx). An equi-join on the image, then an anti-join."""
    side = lambda p: boxes.select(F.col(image).alias("_image"), *[F.col(c).alias(f"{p}{c}") for c in (*CORNERS, "score", "label", "idx")])
    a, b = side("a_"), side("b_")
    over = iou(tuple(F.col(f"a_{c}") for c in CORNERS), tuple(F.col(f"b_{c}") for c in CORNERS)) > threshold
    worse = (F.col("a_score") < F.col("b_score")) | ((F.col("a_score") == F.col("b_score")) & (F.col("a_idx") < F.col("b_idx")))
    lost = a.join(b, "_image").where((F.col("a_label") != F.col("b_label")) & worse & over).select("_image", F.col("a_idx").alias("idx")).distinct()
    return boxes.join(lost.withColumnRenamed("_image", image), [image, "idx"], "left_anti")


def _iou_one(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0.0) * max(h, 0.0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def _in_buckets(boxes: DataFrame, keys: list[str], one, schema: str) -> DataFrame:
    """Runs one(rows of a key, sorted by score and idx) for each key. Keys share a Python call by a hash bucket, since most keys have a few rows."""

    def bucket(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([*keys, "score", "idx"], ascending=[*[True] * len(keys), False, True], kind="stable").drop(columns="_bucket")
        code = part.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(part)]
        return one(part, list(zip(edges, edges[1:], strict=False)))

    parts = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 16
    return boxes.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(parts))).groupBy("_bucket").applyInPandas(bucket, schema)


def suppress(boxes: DataFrame, keys: list[str], threshold: float = 0.9) -> DataFrame:
    """Greedy suppression within the keys (image, scale), whatever the label: by score, then idx; a box that overlaps a kept one by more than threshold goes."""

    def one(part: pd.DataFrame, spans: list[tuple[int, int]]) -> pd.DataFrame:
        kept: list[int] = []
        corner = part[list(CORNERS)].to_numpy().tolist()
        for low, high in spans:
            own: list[int] = []
            for i in range(low, high):
                if all(_iou_one(corner[i], corner[j]) <= threshold for j in own):
                    own.append(i)
            kept += own
        return part.iloc[kept]

    names = ", ".join(f"{n} {k}" for n, k in boxes.dtypes)
    return _in_buckets(boxes, keys, one, names)


def fuse(boxes: DataFrame, image: str = "image_id", threshold: float = 0.3, models: int = 4, floor: float = 0.26) -> DataFrame:
    """Weighted box fusion by image and label: boxes of at least `floor`, by score, join the cluster whose fused box they overlap most (over threshold); coordinates
    are score-weighted means, the score is the mean times min(boxes, models) / models."""

    def one(part: pd.DataFrame, spans: list[tuple[int, int]]) -> pd.DataFrame:
        corner, scores = part[list(CORNERS)].to_numpy().tolist(), part["score"].tolist()
        images, labels, rows = part[image].tolist(), part["label"].tolist(), []
        for low, high in spans:
            groups: list[list] = []  # fused corners, weighted sums, sum of scores, boxes
            for box, score in zip(corner[low:high], scores[low:high], strict=True):
                best = max(range(len(groups)), key=lambda k: _iou_one(groups[k][0], box), default=-1)
                if best < 0 or _iou_one(groups[best][0], box) <= threshold:
                    groups.append([box, [score * v for v in box], score, 1])
                    continue
                g = groups[best]
                g[1] = [s + score * v for s, v in zip(g[1], box, strict=True)]
                g[2], g[3] = g[2] + score, g[3] + 1
                g[0] = [s / g[2] for s in g[1]]
            rows += [(images[low], labels[low], *g[0], g[2] / g[3] * min(g[3], models) / models, g[3]) for g in groups]
        return pd.DataFrame(rows, columns=[image, "label", *CORNERS, "score", "n_boxes"])

    kind = dict(boxes.dtypes)[image]
    schema = f"{image} {kind}, label string, x1 double, y1 double, x2 double, y2 double, score double, n_boxes long"
    return _in_buckets(boxes.where(F.col("score") >= floor), [image, "label"], one, schema)


def ensemble(boxes: DataFrame, image: str = "image_id", scales: int = 4, suppress_over: float = 0.9, fuse_over: float = 0.3, floor: float = 0.26, filter_over: float = 0.5) -> DataFrame:
    """(image, idx, label, corners, score, n_boxes): suppression within each scale, fusion over all scales, then the filter across labels. idx numbers an image's fused boxes by score."""
    fused = fuse(suppress(boxes, [image, "scale"], suppress_over), image, fuse_over, scales, floor)
    by = Window.partitionBy(image).orderBy(F.col("score").desc(), "label", *CORNERS)
    return overlap_filter(fused.withColumn("idx", F.row_number().over(by).cast("long")), image, filter_over)
