"""Queries on the graph of objects and relations."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.checkpoints import cut
from lodestrata.operators.objects import by_label


def get_relations(relations: DataFrame, object_id: int | None = None, relation_type: str | None = None, min_confidence: float = 0.0) -> DataFrame:
    """Edges that touch an object, are of a type and are sure enough; each condition is optional."""
    rows = relations.where(F.col("confidence") >= min_confidence)
    if object_id is not None:
        rows = rows.where((F.col("object_a_id") == object_id) | (F.col("object_b_id") == object_id))
    return rows if relation_type is None else rows.where(F.col("relation_type") == relation_type)


def neighbours(relations: DataFrame, object_id: int, relation_type: str | None = None) -> DataFrame:
    """Distinct other ends of an object's edges."""
    rows = get_relations(relations, object_id, relation_type)
    other = F.when(F.col("object_a_id") == object_id, F.col("object_b_id")).otherwise(F.col("object_a_id"))
    return rows.select(other.alias("object_id")).distinct()


def first_relations(relations: DataFrame, n: int) -> DataFrame:
    """The first ``n`` edges in the order in which they are found: by pair, then ``seq``."""
    return relations.orderBy(F.least("object_a_id", "object_b_id"), F.greatest("object_a_id", "object_b_id"), "seq").limit(n)


def relation_summary(relations: DataFrame) -> DataFrame:
    """Edges of each type and the sum of their confidences."""
    return relations.groupBy("relation_type").agg(F.count("*").alias("n"), F.sum("confidence").alias("confidence"))


def targets(objects: DataFrame, label: str, similar: DataFrame, partial: bool = True) -> DataFrame:
    """(object_id) of the objects that a label names or, where it names none, of ``similar``."""
    named = by_label(objects, label, partial).select("object_id")
    none = named.agg((F.count("*") == 0).alias("none"))  # one row
    return named.unionByName(similar.select("object_id").join(F.broadcast(none)).where("none").select("object_id"))


def related_objects(objects: DataFrame, relations: DataFrame, targets: DataFrame, relation_type: str | None = None, min_confidence: float = 0.5) -> DataFrame:
    """Objects that have an edge, either way, to one of ``targets`` (object_id); a semi-join."""
    rows = get_relations(relations, None, relation_type, min_confidence)
    both = rows.select(F.col("object_a_id").alias("target"), F.col("object_b_id").alias("object_id")).unionByName(rows.select(F.col("object_b_id").alias("target"), F.col("object_a_id").alias("object_id")))
    reached = both.join(targets.select(F.col("object_id").alias("target")), "target", "left_semi")
    return objects.join(reached.select("object_id"), "object_id", "left_semi")


def weights(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Undirected weights (a_id < b_id, weight): confidences of parallel edges add up; loops and
    edges to objects that are not ``nodes`` (object_id) are left out."""
    rows = relations.where("object_a_id <> object_b_id").select(F.least("object_a_id", "object_b_id").alias("a_id"), F.greatest("object_a_id", "object_b_id").alias("b_id"), "confidence")
    known = nodes.select("object_id").distinct()
    rows = rows.join(known.withColumnRenamed("object_id", "a_id"), "a_id", "left_semi").join(known.withColumnRenamed("object_id", "b_id"), "b_id", "left_semi")
    return rows.groupBy("a_id", "b_id").agg(F.sum("confidence").alias("weight"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(object_id, component_id: the least id in it), singletons included.

    Rounds of the neighbours' least label and a jump to the label's own label: the number of
    rounds follows the logarithm of the longest path. Only the count of changes is collected.
    """
    labels = cut(nodes.select("object_id", F.col("object_id").alias("component_id")).distinct())
    ends = edges.select("a_id", "b_id").unionByName(edges.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id")))
    ends = cut(ends.where("a_id <> b_id").distinct())
    while True:
        of_b = labels.select(F.col("object_id").alias("b_id"), "component_id")
        near = ends.join(of_b, "b_id").groupBy(F.col("a_id").alias("object_id")).agg(F.min("component_id").alias("near"))
        step = labels.join(near, "object_id", "left").withColumn("next", F.least("component_id", F.coalesce("near", "component_id")))
        jump = step.select(F.col("object_id").alias("next"), F.col("next").alias("far"))
        least = F.least("next", F.coalesce("far", "next"))
        moved = cut(step.join(jump, "next", "left").select("object_id", least.alias("component_id"), (least != F.col("component_id")).alias("changed")))
        labels = moved.select("object_id", "component_id")
        if moved.where("changed").isEmpty():
            return labels


def component_lists(components: DataFrame) -> DataFrame:
    return components.groupBy("component_id").agg(F.sort_array(F.collect_list("object_id")).alias("object_ids"), F.count("*").alias("size"))


def spanning_forest(nodes: DataFrame, edges: DataFrame, objective: str = "min", weight: str = "weight") -> DataFrame:
    """Edges (a_id, b_id, weight) of a spanning forest of least (or, ``max``, largest) weight.

    Boruvka's rounds: every component picks its best edge to another, the picked edges join
    components. Equal weights are ordered by the edge's ids, so the choice has no cycles. The
    rounds are at most log2 of the objects; no component is gathered in a task.
    """
    if objective not in ("min", "max"):
        raise ValueError("objective is min or max")
    signed = F.col(weight) if objective == "min" else -F.col(weight)
    rest = cut(edges.where(F.col(weight) > 0).select("a_id", "b_id", F.col(weight).alias("weight"), F.struct(signed.alias("w"), F.col("a_id").alias("a"), F.col("b_id").alias("b")).alias("rank")))
    labels = nodes.select("object_id", F.col("object_id").alias("component_id")).distinct()
    chosen: list[DataFrame] = []
    while True:
        a = labels.select(F.col("object_id").alias("a_id"), F.col("component_id").alias("ca"))
        b = labels.select(F.col("object_id").alias("b_id"), F.col("component_id").alias("cb"))
        rest = cut(rest.select("a_id", "b_id", "weight", "rank").join(a, "a_id").join(b, "b_id").where("ca <> cb"))
        if rest.isEmpty():
            break
        ends = rest.select(F.col("ca").alias("c"), F.col("cb").alias("up"), "rank", "weight").unionByName(rest.select(F.col("cb").alias("c"), F.col("ca").alias("up"), "rank", "weight"))
        best = cut(ends.groupBy("c").agg(F.min_by(F.struct("up", F.col("rank.a").alias("a_id"), F.col("rank.b").alias("b_id"), "weight"), "rank").alias("e")).select("c", "e.*"))
        chosen.append(best.select("a_id", "b_id", "weight").distinct())
        # every component hangs on the other end of its edge; of two that chose each other the less is the root
        back = best.select(F.col("c").alias("up"), F.col("up").alias("up_up"))
        hung = best.join(back, "up").select("c", F.when((F.col("up_up") == F.col("c")) & (F.col("c") < F.col("up")), F.col("c")).otherwise(F.col("up")).alias("up"))
        while True:
            hung = cut(hung)
            further = hung.join(hung.select(F.col("c").alias("up"), F.col("up").alias("top")), "up").select("c", "up", "top")
            if further.where("top <> up").isEmpty():
                break
            hung = further.select("c", F.col("top").alias("up"))
        labels = cut(labels.join(hung.withColumnRenamed("c", "component_id"), "component_id", "left").select("object_id", F.coalesce("up", "component_id").alias("component_id")))
    return _union(chosen) if chosen else edges.select("a_id", "b_id", F.col(weight).alias("weight")).where("false")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scene_forests(objects: DataFrame, edges: DataFrame, scene: str = "scene_id", objective: str = "min") -> DataFrame:
    """The spanning forest of every scene: one task a scene, for scenes of bounded size.

    ``edges``: scene, a_id, b_id, weight.
    """
    sign = 1 if objective == "min" else -1

    def kruskal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows.weight > 0]
        rows = rows.assign(key=rows.weight * sign).sort_values(["key", "a_id", "b_id"])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        keep = []
        for a, b in zip(rows.a_id, rows.b_id, strict=True):
            ra, rb = root(a), root(b)
            keep.append(ra != rb)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        return rows[keep][[scene, "a_id", "b_id", "weight"]]

    kind = dict(edges.dtypes)[scene]
    return edges.select(scene, "a_id", "b_id", "weight").groupBy(scene).applyInPandas(kruskal, f"{scene} {kind}, a_id long, b_id long, weight double")


def graph_statistics(objects: DataFrame, relations: DataFrame, components: DataFrame) -> DataFrame:
    """One row: num_nodes, num_edges, num_components."""
    n, e, c = (d.agg(F.count("*").alias(k)) for d, k in ((objects, "num_nodes"), (relations, "num_edges"), (components.select("component_id").distinct(), "num_components")))
    return n.join(e).join(c)


def example_pairs(relations: DataFrame, per_type: int = 2, types: tuple[str, ...] = ("on", "in", "near"), method: str = "visual") -> DataFrame:
    """The first few relations of each type by ``seq`` that a method has made."""
    rank = F.row_number().over(Window.partitionBy("relation_type").orderBy("seq", "object_a_id", "object_b_id"))
    rows = relations.where(F.col("relation_type").isin(*types) & (F.col("metadata")["method"] == method))
    return rows.withColumn("rank", rank).where(F.col("rank") <= per_type)


