"""Detections, masks as pixel rows, and their overlap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import geometry as G


def large_enough(detections: DataFrame, min_area: int = 100) -> DataFrame:
    return detections.where(F.col("area") >= min_area)


def top_per_frame(detections: DataFrame, n: int, by: str = "score", keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """The ``n`` detections of largest ``by`` of each frame; ties by position."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by), "det_idx"))
    return detections.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def per_frame(detections: DataFrame) -> DataFrame:
    return detections.groupBy("frame_idx").agg(F.count("*").alias("n_masks"))


def statistics(detections: DataFrame) -> DataFrame:
    """One row: masks, pixels, mean area, range of scores."""
    return detections.agg(F.count("*").alias("n_masks"), F.sum("area").alias("pixels"), F.avg("area").alias("mean_area"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))


def consistent_depth(detections: DataFrame, pixels: DataFrame, depth: DataFrame, limit: float = 0.5) -> DataFrame:
    """Detections whose depths in the mask deviate (population) by ``limit`` at most; a mask
    without a positive depth stays."""
    spread = pixels.join(depth, ["frame_idx", "row", "col"]).where("z > 0").groupBy("frame_idx", "det_idx").agg(F.stddev_pop("z").alias("_s"))
    rows = detections.join(spread, ["frame_idx", "det_idx"], "left")
    return rows.where(F.coalesce("_s", F.lit(0.0)) <= limit).drop("_s")


def mask_boxes(pixels: DataFrame) -> DataFrame:
    """Tight boxes of masks, borders included: x by column, y by row."""
    return pixels.groupBy("frame_idx", "det_idx").agg(F.min("col").alias("x1"), F.min("row").alias("y1"), F.max("col").alias("x2"), F.max("row").alias("y2"), F.count("*").alias("area"))


def mask_overlap(pixels: DataFrame) -> DataFrame:
    """(frame_idx, a_idx, b_idx, shared, area_a, area_b, iou, containment) of masks that share
    pixels: an equi-join on pixels, so pairs without overlap cost nothing."""
    areas = pixels.groupBy("frame_idx", "det_idx").agg(F.count("*").alias("area"))
    a = pixels.select("frame_idx", "row", "col", F.col("det_idx").alias("a_idx"))
    b = pixels.select("frame_idx", "row", "col", F.col("det_idx").alias("b_idx"))
    shared = a.join(b, ["frame_idx", "row", "col"]).where("a_idx < b_idx").groupBy("frame_idx", "a_idx", "b_idx").agg(F.count("*").alias("shared"))
    rows = shared
    for n in "ab":
        rows = rows.join(areas.select("frame_idx", F.col("det_idx").alias(f"{n}_idx"), F.col("area").alias(f"area_{n}")), ["frame_idx", f"{n}_idx"])
    return rows.withColumn("iou", F.col("shared") / (F.col("area_a") + F.col("area_b") - F.col("shared"))).withColumn("containment", F.col("shared") / F.least("area_a", "area_b"))


_MERGED = "frame_idx long, det_idx int, score double, x1 int, y1 int, x2 int, y2 int, area long, members array<int>, pixels array<long>"


def merge_masks(pixels: DataFrame, scores: DataFrame, iou: float = 0.5, containment: float = 0.85) -> DataFrame:
    """Greedy union of overlapping masks, frame by frame.

    Masks go by score (ties by position). Each one not yet taken up grows by every later one
    that overlaps what it has become so far: iou, or either share of the other, above its
    limit. A union keeps the largest score and its first member's position. Output pixels are
    row * 2**32 + col. ``scores``: frame_idx, det_idx, score; masks without pixels stay, empty.
    """
    packed = pixels.groupBy("frame_idx", "det_idx").agg(F.collect_set(F.col("row").cast("long") * (1 << 32) + F.col("col")).alias("pixels"))
    rows = scores.select(F.col("frame_idx").cast("long"), F.col("det_idx").cast("int"), F.col("score").cast("double")).join(packed, ["frame_idx", "det_idx"], "left")

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "det_idx"], ascending=[False, True])
        masks = [frozenset() if p is None else frozenset(np.asarray(p).tolist()) for p in frame["pixels"]]
        names, points = frame["det_idx"].tolist(), frame["score"].tolist()
        free, out = list(range(len(masks))), []
        while free:
            seed, *later = free
            grown, members, best, free = set(masks[seed]), [names[seed]], points[seed], []
            for j in later:
                both = len(grown & masks[j])
                joined = len(grown) + len(masks[j]) - both
                if both and (both > iou * joined or both > containment * len(grown) or both > containment * len(masks[j])):
                    grown |= masks[j]
                    members.append(names[j])
                    best = max(best, points[j])
                else:
                    free.append(j)
            ys, xs = [p >> 32 for p in grown], [p & 0xFFFFFFFF for p in grown]
            box = (min(xs), min(ys), max(xs), max(ys)) if grown else (None,) * 4
            out.append((frame["frame_idx"].iloc[0], names[seed], best, *box, len(grown), members, sorted(grown)))
        made = pd.DataFrame(out, columns=[c.split()[0] for c in _MERGED.split(", ")])
        return made.astype({c: "Int32" for c in ("x1", "y1", "x2", "y2")})

    return rows.groupBy("frame_idx").applyInPandas(merge, _MERGED)


def fill_holes(pixels: DataFrame, height: int, width: int, smaller_than: int = 100) -> DataFrame:
    """Masks with their background areas (joined by edges) of fewer pixels filled, those at the
    image's border too. One task a mask, an image in memory."""
    schema = "frame_idx long, det_idx int, row int, col int"

    def fill(mask: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((height, width), dtype=bool)
        image[mask["row"], mask["col"]] = True
        seen = image.copy()
        for start in zip(*np.where(~image), strict=True):
            if seen[start]:
                continue
            seen[start] = True
            area, edge = [start], [start]
            while edge:
                y, x = edge.pop()
                for q in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                    if 0 <= q[0] < height and 0 <= q[1] < width and not seen[q]:
                        seen[q] = True
                        area.append(q)
                        edge.append(q)
            if len(area) < smaller_than:
                image[tuple(np.array(area).T)] = True
        rows, cols = np.where(image)
        return pd.DataFrame({"frame_idx": mask["frame_idx"].iloc[0], "det_idx": mask["det_idx"].iloc[0], "row": rows, "col": cols})

    own = pixels.select(F.col("frame_idx").cast("long"), F.col("det_idx").cast("int"), F.col("row").cast("int"), F.col("col").cast("int"))
    return own.groupBy("frame_idx", "det_idx").applyInPandas(fill, schema)


def similar_in_frame(detections: DataFrame, threshold: float = 0.7, keys: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """Pairs of a frame whose embeddings have a cosine above ``threshold``."""
    a = detections.select(*keys, F.col("det_idx").alias("a_idx"), F.col("embedding").alias("a_embedding"))
    b = detections.select(*keys, F.col("det_idx").alias("b_idx"), F.col("embedding").alias("b_embedding"))
    rows = a.join(b, list(keys)).where("a_idx < b_idx").withColumn("similarity", G.cosine(F.col("a_embedding"), F.col("b_embedding")))
    return rows.where(F.col("similarity") > threshold).drop("a_embedding", "b_embedding")


def masked_depth(pixels: DataFrame, depth: DataFrame) -> DataFrame:
    """Depth rows inside masks, by an equi-join on pixels; all others count as no depth."""
    return depth.join(pixels, ["frame_idx", "row", "col"])


