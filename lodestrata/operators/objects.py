"""Semantic objects: predicates, searches, boxes, confidences and statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import geometry as G


@dataclass(frozen=True)
class ConfirmConfig:
    min_observations: int = 2
    min_points: int = 100
    min_confidence: float = 0.0


def with_status(objects: DataFrame, status: str) -> DataFrame:
    return objects.where(F.col("status") == status)


def confirmed_tracks(tracks: DataFrame, min_observations: int = 2) -> DataFrame:
    return tracks.where(F.col("num_observations") >= min_observations)


def _or_zero(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) if name in df.columns else F.lit(0)


def confirmed(objects: DataFrame, config: ConfirmConfig = ConfirmConfig(), use_confidence: bool = True) -> DataFrame:
    """Objects seen often enough, with enough points and (unless switched off) sure enough.
    Nulls and columns that are missing count as 0."""
    rows = objects.where((_or_zero(objects, "num_observations") >= config.min_observations) & (_or_zero(objects, "num_points") >= config.min_points))
    return rows.where(_or_zero(objects, "confidence") >= config.min_confidence) if use_confidence else rows


def by_label(objects: DataFrame, label: str, partial: bool = True) -> DataFrame:
    """Objects whose label contains (or is) ``label`` in any case; null and empty labels never match."""
    own, asked = F.lower("label"), F.lower(F.lit(label))
    return objects.where((F.col("label") != "") & (F.contains(own, asked) if partial else own == asked))


def by_id(objects: DataFrame, object_id: int) -> DataFrame:
    return objects.where(F.col("object_id") == object_id).limit(1)


def brief(objects: DataFrame) -> DataFrame:
    return objects.select("object_id", "label", "bbox", "num_observations", "confidence")


def in_region(objects: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Objects whose centre lies in an axis-aligned region, borders included."""
    rows = objects
    for axis, a, b in zip(("cx", "cy", "cz"), low, high, strict=True):
        rows = rows.where(F.col(f"bbox.{axis}").between(a, b))
    return rows


def age(objects: DataFrame) -> DataFrame:
    return objects.withColumn("age", F.col("last_seen_frame") - F.col("first_seen_frame") + 1)


def by_embedding(objects: DataFrame, query: list[float], top_k: int = 5, threshold: float = 0.5) -> DataFrame:
    """The ``top_k`` objects of largest dot product with ``query`` of at least ``threshold``.
    Objects without an embedding are no answers; ties go to the smaller id."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    rows = objects.withColumn("similarity", G.dot(F.col("embedding"), asked)).where(F.col("similarity") >= threshold)
    return rows.orderBy(F.desc("similarity"), "object_id").limit(top_k)


def top_by(objects: DataFrame, measure: str, n: int) -> DataFrame:
    return objects.orderBy(F.desc(measure), "object_id").limit(n)


def bounding_boxes(points: DataFrame) -> DataFrame:
    """(object_id, bbox): the axis-aligned box of each object's points."""
    lows = [F.min(c).alias(f"{c}0") for c in "xyz"]
    highs = [F.max(c).alias(f"{c}1") for c in "xyz"]
    rows = points.groupBy("object_id").agg(*lows, *highs)
    centre = [((F.col(f"{c}0") + F.col(f"{c}1")) / 2).alias(f"c{c}") for c in "xyz"]
    size = [(F.col(f"{c}1") - F.col(f"{c}0")).alias(s) for c, s in zip("xyz", "whd", strict=True)]
    return rows.select("object_id", F.struct(*centre, *size).alias("bbox"))


def tracking_confidence(observations: Column) -> Column:
    return F.least(F.lit(1.0), observations / 10.0)


def finalise(observations: DataFrame, points: DataFrame, labels: DataFrame) -> DataFrame:
    """One row an object from its observations (object_id, frame_idx), points and labels
    (object_id, label, semantic_confidence): frames, counts, box and corners, confidences."""
    seen = observations.groupBy("object_id").agg(F.min("frame_idx").alias("first_seen_frame"), F.max("frame_idx").alias("last_seen_frame"), F.count("*").alias("num_observations"))
    sizes = points.groupBy("object_id").agg(F.count("*").alias("num_points"))
    rows = seen.join(sizes, "object_id", "left").join(bounding_boxes(points), "object_id", "left").join(labels, "object_id", "left")
    rows = rows.withColumns(
        {
            "num_points": F.coalesce("num_points", F.lit(0)),
            "label": F.coalesce("label", F.concat(F.lit("object_"), F.col("object_id").cast("string"))),
            "semantic_confidence": F.coalesce("semantic_confidence", F.lit(0.0)),
            "tracking_confidence": tracking_confidence(F.col("num_observations")),
            "corners": F.when(F.col("bbox").isNotNull(), G.corners(F.col("bbox"))),
        }
    )
    return rows.withColumn("confidence", (F.col("semantic_confidence") + F.col("tracking_confidence")) / 2)


def statistics(objects: DataFrame, config: ConfirmConfig = ConfirmConfig()) -> DataFrame:
    """One row of counts and means over objects; means of nothing are 0."""
    sure = (_or_zero(objects, "num_observations") >= config.min_observations) & (_or_zero(objects, "num_points") >= config.min_points) & (_or_zero(objects, "confidence") >= config.min_confidence)
    return objects.agg(
        F.count("*").alias("total_objects"),
        F.count_if(sure).alias("confirmed_objects"),
        F.count_if(F.col("status") == "active").alias("active_objects"),
        F.count_if(F.col("label") != "").alias("labelled_objects"),
        F.coalesce(F.avg("num_points"), F.lit(0.0)).alias("avg_points"),
        F.coalesce(F.avg("num_observations"), F.lit(0.0)).alias("avg_observations"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
    )


def search(rows: DataFrame, asked: DataFrame, n: int = 5, threshold: float = 0.0, places: int | None = None, blocks: int = 64) -> DataFrame:
    """(query_id, object_id, similarity, rank): for every query (query_id, embedding) its ``n`` most
    similar rows (object_id, embedding) at ``threshold`` or more; ties by id.

    Queries are dealt to ``blocks`` and every row is sent to each block that has some, an equi-join;
    each part keeps its own best ``n`` before the parts meet. ``places``: digits to round to.
    """
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    dealt = asked.select("query_id", F.col("embedding").alias("_asked"), block.alias("_block"))
    used = F.broadcast(dealt.select("_block").distinct())  # ``blocks`` rows at most
    sent = rows.select("object_id", "embedding").join(used).withColumn("_part", F.pmod(F.xxhash64("object_id"), F.lit(blocks)))
    spread = dealt.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    likeness = G.dot(F.col("embedding"), F.col("_asked"))
    found = sent.join(spread, ["_block", "_part"]).withColumn("similarity", likeness if places is None else F.round(likeness, places))
    found = found.where(F.col("similarity") >= threshold).select("query_id", "object_id", "similarity")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "object_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
