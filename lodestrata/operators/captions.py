"""Captions of objects: selection, caps, labels and their confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import language as L

_BY_TIME = ("frame_idx", "seq")


def long_enough(captions: DataFrame, min_length: int = 5) -> DataFrame:
    return captions.where(F.length("caption") >= min_length)


def sampled_frames(rows: DataFrame, interval: int = 5) -> DataFrame:
    return rows.where(F.col("frame_idx") % interval == 0)


def capped(captions: DataFrame, per_object: int = 5) -> DataFrame:
    """The first captions of each object, by frame and position."""
    rank = F.row_number().over(Window.partitionBy("object_id").orderBy(*_BY_TIME))
    return captions.withColumn("_rank", rank).where(F.col("_rank") <= per_object).drop("_rank")


def histories(captions: DataFrame) -> DataFrame:
    """(object_id, captions in order)."""
    return captions.groupBy("object_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(*_BY_TIME, "caption"))), lambda x: x["caption"]).alias("captions"))


def _longest() -> Column:
    """The longest caption, of equal ones the first."""
    return F.max_by("caption", F.struct(F.length("caption"), -F.col("frame_idx"), -F.col("seq")))


def short_labels(captions: DataFrame, n_words: int = 5) -> DataFrame:
    """(object_id, label): a single caption as it is, else the first words of the longest."""
    rows = captions.groupBy("object_id").agg(F.count("*").alias("n"), _longest().alias("caption"))
    return rows.select("object_id", F.when(F.col("n") > 1, L.first_words(F.col("caption"), n_words)).otherwise(F.col("caption")).alias("label"))


def full_labels(captions: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """(object_id, label, semantic_confidence): the longest caption, and the share of captions that
    contain one of its words (0.5 for a single caption). With ``objects``, those without captions
    are named by their id with confidence 0."""
    longest = captions.groupBy("object_id").agg(_longest().alias("label"), F.count("*").alias("n"))
    words = F.filter(F.split(F.lower("label"), r"(?U)\s+"), lambda w: w != "")
    told = captions.join(longest.select("object_id", "n", words.alias("words"), "label"), "object_id")
    says = F.exists("words", lambda w: F.contains(F.lower("caption"), w))
    rows = told.groupBy("object_id").agg(F.first("label").alias("label"), F.when(F.count("*") == 1, 0.5).otherwise(F.count_if(says) / F.count("*")).alias("semantic_confidence"))
    if objects is None:
        return rows
    return objects.select("object_id").distinct().join(rows, "object_id", "left").select(
        "object_id", F.coalesce("label", F.concat(F.lit("object_"), F.col("object_id").cast("string"))).alias("label"), F.coalesce("semantic_confidence", F.lit(0.0)).alias("semantic_confidence")
    )


def statistics(captions: DataFrame) -> DataFrame:
    """One row: objects with captions and with a label, captions, and captions an object."""
    each = captions.groupBy("object_id").agg(F.count("*").alias("n"), F.max(F.col("caption") != "").cast("int").alias("labelled"))
    return each.agg(
        F.count("*").alias("captioned_objects"),
        F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled_objects"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_captions"),
        F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_captions"),
    )


def without(captions: DataFrame, object_id: int) -> DataFrame:
    """All captions but those of one object."""
    return captions.where(~F.col("object_id").eqNullSafe(object_id))
