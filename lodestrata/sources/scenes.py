"""Objects and graphs as JSON documents, and arrays as .npy files; sources and sinks."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import geometry as G
from lodestrata.operators.objects import ConfirmConfig, confirmed, statistics

_BOX = "STRUCT<center: ARRAY<DOUBLE>, size: ARRAY<DOUBLE>>"
OBJECT_DOCUMENT = f"""object_id LONG, label STRING, status STRING, first_seen_frame INT, last_seen_frame INT, num_observations INT, num_points LONG,
 confidence DOUBLE, bounding_box_3d {_BOX}, bounding_box_3d_corners ARRAY<ARRAY<DOUBLE>>, point_cloud_points_path STRING, clip_features_path STRING"""
_KEYS = ("object_id", "label", "status", "first_seen_frame", "last_seen_frame", "num_observations", "num_points", "confidence")


def object_rows(objects: DataFrame) -> DataFrame:
    """Objects in the document's form: box as centre and size, corners, and null for what is missing."""
    box = F.col("bbox")
    shaped = F.when(box.isNotNull(), F.struct(F.array("bbox.cx", "bbox.cy", "bbox.cz").alias("center"), F.array("bbox.w", "bbox.h", "bbox.d").alias("size")))
    rest = [F.col(c) if c in objects.columns else F.lit(None).cast("string").alias(c) for c in (*_KEYS, "point_cloud_points_path", "clip_features_path")]
    return objects.select(*rest, shaped.alias("bounding_box_3d"), F.when(box.isNotNull(), G.corners(box)).alias("bounding_box_3d_corners"))


def _document(parts: list[DataFrame]) -> DataFrame:
    """One row of one-row parts."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row
    return out.select(F.to_json(F.struct(*out.columns), {"ignoreNullFields": "false"}).alias("value"))


def objects_document(objects: DataFrame, config: ConfirmConfig = ConfirmConfig()) -> DataFrame:
    """The document as one row ``value``: metadata, statistics and the confirmed objects.

    A JSON document is one value, so it is as large as the objects are; Parquet is the form for many.
    """
    kept = object_rows(confirmed(objects, config))
    total = objects.agg(F.count("*").alias("total_objects"))
    inner = kept.agg(F.sort_array(F.collect_list(F.struct(*kept.columns))).alias("objects"), F.count("*").alias("exported_objects"))
    meta = total.join(F.broadcast(inner.select("exported_objects")))  # one row
    meta = meta.select(F.struct("total_objects", "exported_objects", F.lit(config.min_observations).alias("min_observations"), F.lit(config.min_points).alias("min_points")).alias("metadata"))
    stats = statistics(objects, config)
    return _document([meta, stats.select(F.struct(*stats.columns).alias("statistics")), inner.select("objects")])


def write_objects(objects: DataFrame, path: str, config: ConfirmConfig = ConfirmConfig()) -> int:
    """Write the document to a folder and return the number of objects in it."""
    objects_document(objects, config).coalesce(1).write.mode("overwrite").text(path)
    return confirmed(objects, config).count()


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects of a document, with ``bbox`` as a struct; nulls stay null."""
    doc = spark.read.option("multiLine", True).schema(_objects_schema()).json(path)
    rows = doc.select(F.explode("objects").alias("o")).select("o.*")
    c, s = F.col("bounding_box_3d.center"), F.col("bounding_box_3d.size")
    box = F.struct(*[x[i].alias(n) for x, ns in ((c, ("cx", "cy", "cz")), (s, ("w", "h", "d"))) for i, n in enumerate(ns)])
    return rows.withColumn("bbox", F.when(F.col("bounding_box_3d").isNotNull(), box)).drop("bounding_box_3d")


def _objects_schema() -> str:
    fields = [f.strip().split(" ", 1) for f in OBJECT_DOCUMENT.replace(_BOX, "BOX").split(",")]
    inner = ", ".join(f"{n}: {_BOX if t == 'BOX' else t}" for n, t in fields)
    return f"objects ARRAY<STRUCT<{inner}>>"


def graph_document(objects: DataFrame, relations: DataFrame, components: DataFrame, include_objects: bool = True) -> DataFrame:
    """A graph as (section, at, value): the elements of its document, each as JSON. Sections are
    ``metadata`` (one element), ``relations``, ``components`` and, if asked, ``objects``; ``at`` orders
    those of one. A document is as large as its graph, so no row holds all of it; ``document_lines``
    makes one text of them.
    """
    counts = [d.agg(F.count("*").alias(n)) for d, n in ((objects, "num_nodes"), (relations, "num_edges"), (components.select("component_id").distinct(), "num_components"))]
    metadata = counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))  # one row each
    edges = relations.select("object_a_id", "object_b_id", "relation_type", "confidence")
    lists = components.groupBy("component_id").agg(F.sort_array(F.collect_list("object_id")).alias("object_ids"), F.count("*").alias("size"))
    sections = [("metadata", metadata, []), ("relations", edges, ["object_a_id", "object_b_id"]), ("components", lists, ["component_id"])]
    if include_objects:
        sections.append(("objects", object_rows(objects), ["object_id"]))
    out = None
    for name, rows, order in sections:
        at = F.array(*[F.col(c).cast("long") for c in order]).cast("array<long>")
        made = rows.select(F.lit(name).alias("section"), at.alias("at"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
        out = made if out is None else out.unionByName(made)
    return out


#: Sections of a graph's document after its metadata, in order.
_SECTIONS = ("relations", "components", "objects")


def document_lines(document: DataFrame, sections: tuple[str, ...] = _SECTIONS) -> DataFrame:
    """The lines of one JSON text, in one partition and in order: the metadata's fields, then each
    of ``sections`` as a list with an element on each line. One text is one task's to write; it
    streams through and is never held."""
    heads = document.sparkSession.createDataFrame([(s, k) for k, s in enumerate(sections, 1)], "section string, rank int")
    # of a section: its head, then its elements, the first without a comma, then its end
    last = len(sections)
    marks = heads.select("rank", F.lit(0).alias("part"), F.lit(None).cast("array<long>").alias("at"), F.concat(F.lit('"'), "section", F.lit('": [')).alias("value"))
    ends = heads.select("rank", F.lit(2).alias("part"), F.lit(None).cast("array<long>").alias("at"), F.when(F.col("rank") == last, "]}").otherwise("],").alias("value"))
    rank = F.coalesce(*[F.when(F.col("section") == s, F.lit(k)) for k, s in enumerate(("metadata", *sections))])
    rows = document.select(rank.alias("rank"), F.lit(1).alias("part"), "at", "value").where("rank IS NOT NULL").unionByName(marks).unionByName(ends)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for batch in batches:
            lines = []
            for rank, part, value in zip(batch["rank"], batch["part"], batch["value"], strict=True):
                if rank == 0:
                    value = value[:-1] + ("," if sections else "}")
                elif part == 1 and before == (rank, 1):
                    value = "," + value
                before = (rank, part)
                lines.append(value)
            yield pd.DataFrame({"value": lines})

    return rows.repartition(1).sortWithinPartitions("rank", "part", "at", "value").mapInPandas(run, "value string")


def write_graph(objects: DataFrame, relations: DataFrame, components: DataFrame, path: str, include_objects: bool = True) -> None:
    """Write the graph's document to a folder, as the lines of one file."""
    document = graph_document(objects, relations, components, include_objects)
    document_lines(document, _SECTIONS if include_objects else _SECTIONS[:-1]).write.mode("overwrite").text(path)


def to_dicts(objects: DataFrame) -> DataFrame:
    """Each object as one JSON string."""
    return objects.select("object_id", F.to_json(F.struct(*objects.columns), {"ignoreNullFields": "false"}).alias("value"))


def from_dicts(rows: DataFrame, schema: str) -> DataFrame:
    """Objects of their JSON strings (column ``value``), by a DDL schema; a field that a string
    lacks is null, and a string that is no JSON gives a row of nulls."""
    return rows.select(F.from_json("value", schema).alias("o")).select("o.*")


def read_npy(spark: SparkSession, path: str, names: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(path, index, names...) of two-dimensional .npy arrays of a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                rows = np.atleast_2d(np.load(io.BytesIO(r.content), allow_pickle=False)).astype(float)
                yield pd.DataFrame({"path": r.path, "index": np.arange(len(rows)), **{n: rows[:, k] for k, n in enumerate(names)}})

    return raw.mapInPandas(run, "path string, index long, " + ", ".join(f"{n} double" for n in names))


#: What is kept of an object as arrays, and the columns of each.
ARRAYS = {"points": ("x", "y", "z"), "colors": ("r", "g", "b"), "features": ("embedding",)}


def to_npy(points: DataFrame, kind: str = "points", folder: str = "") -> DataFrame:
    """(object_id, name, path, shape, content): each object's rows of a kind of array as the bytes of
    a .npy file, float32; features are vectors, one a row. Rows of an object make one file."""
    names = ARRAYS[kind]

    def run(cloud: pd.DataFrame) -> pd.DataFrame:
        array = np.stack([np.asarray(v, np.float32) for v in cloud[names[0]]]) if kind == "features" else cloud[list(names)].to_numpy(np.float32)
        out = io.BytesIO()
        np.save(out, array)
        k = int(cloud["object_id"].iloc[0])
        name = f"obj_{k:03d}_{kind}.npy"
        return pd.DataFrame({"object_id": [k], "name": [name], "path": [f"{folder}/{name}" if folder else name], "shape": [list(array.shape)], "content": [out.getvalue()]})

    return points.select("object_id", *names).dropna().groupBy("object_id").applyInPandas(run, "object_id long, name string, path string, shape array<int>, content binary")


def with_arrays(objects: DataFrame, files: dict[str, DataFrame]) -> DataFrame:
    """Objects with ``<kind>_path`` and ``<kind>_shape`` of their files; null where they have none."""
    for kind, rows in files.items():
        objects = objects.join(rows.select("object_id", F.col("path").alias(f"{kind}_path"), F.col("shape").alias(f"{kind}_shape")), "object_id", "left")
    return objects
