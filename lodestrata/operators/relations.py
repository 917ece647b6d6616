"""Typed spatial relations between objects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import geometry as G
from lodestrata.functions import language as L

_EDGE = "array<struct<relation_type:string,confidence:double,metadata:map<string,string>,swapped:boolean>>"


@dataclass(frozen=True)
class RelationConfig:
    """Thresholds of the geometric predicates, in metres and shares."""

    on_tolerance: float = 0.05
    on_ratio: float = 0.3
    in_ratio: float = 0.8
    near_distance: float = 0.5
    direction_least: float = 0.3
    overlap_threshold: float = 0.01


def _edge(relation: Column | str, confidence: Column, metadata: tuple[str, str] | None, swapped: bool) -> Column:
    relation = F.lit(relation) if isinstance(relation, str) else relation
    notes = F.create_map(*[F.lit(x) for x in metadata]) if metadata else F.lit(None).cast("map<string,string>")
    return F.when(confidence.isNotNull(), F.struct(relation.alias("relation_type"), confidence.alias("confidence"), notes.alias("metadata"), F.lit(swapped).alias("swapped")))


def pair_relations(pairs: DataFrame, config: RelationConfig = RelationConfig()) -> DataFrame:
    """All geometric edges of candidate pairs, at most six a pair, in a fixed order ``seq``:
    on (a, b), on (b, a), in (a, b), in (b, a), near, direction.

    ``pairs``: a_id, b_id, a_box, b_box. Pairs with a null box have no edges. Edges that turn
    the pair around have its ids swapped.
    """
    a, b = F.col("a_box"), F.col("b_box")
    way = G.direction(a, b, config.direction_least)
    edges = [
        _edge("on", G.on_confidence(a, b, config.on_tolerance, config.on_ratio), ("direction", "a_on_b"), False),
        _edge("on", G.on_confidence(b, a, config.on_tolerance, config.on_ratio), ("direction", "b_on_a"), True),
        _edge("in", G.in_confidence(a, b, config.in_ratio), ("direction", "a_in_b"), False),
        _edge("in", G.in_confidence(b, a, config.in_ratio), ("direction", "b_in_a"), True),
        _edge("near", G.near_confidence(a, b, config.near_distance), ("symmetric", "true"), False),
        _edge(way["relation"], way["confidence"], None, False),
    ]
    rows = pairs.where(a.isNotNull() & b.isNotNull()).select("a_id", "b_id", F.posexplode(F.filter(F.array(*edges), lambda e: e.isNotNull())).alias("seq", "e"))
    return rows.select(
        F.when(F.col("e.swapped"), F.col("b_id")).otherwise(F.col("a_id")).alias("object_a_id"),
        F.when(F.col("e.swapped"), F.col("a_id")).otherwise(F.col("b_id")).alias("object_b_id"),
        "e.relation_type",
        "e.confidence",
        "e.metadata",
        F.col("seq").cast("long").alias("seq"),
    )


def _with_boxes(pairs: DataFrame, objects: DataFrame, columns: tuple[str, ...] = ("bbox",)) -> DataFrame:
    def side(n: str) -> DataFrame:
        return objects.select(F.col("object_id").alias(f"{n}_id"), *[F.col(c).alias(f"{n}_{'box' if c == 'bbox' else c}") for c in columns])

    return pairs.join(side("a"), "a_id").join(side("b"), "b_id")


def compute_relations(objects: DataFrame, overlap: DataFrame, config: RelationConfig = RelationConfig()) -> DataFrame:
    """Edges of the pairs whose clouds overlap by ``overlap_threshold`` or more in a direction.

    ``overlap``: a_id, b_id, ratio (sparse). Pairs are ordered, a before b.
    """
    enough = overlap.where((F.col("ratio") >= config.overlap_threshold) & (F.col("a_id") != F.col("b_id")))
    pairs = enough.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).distinct()
    return pair_relations(_with_boxes(pairs, objects), config)


def scene_pairs(objects: DataFrame, scene: str = "scene_id", columns: tuple[str, ...] = ("label", "bbox")) -> DataFrame:
    """All pairs a before b of objects of one scene, an equi-join: a scene is a bounded set."""

    def side(n: str) -> DataFrame:
        return objects.select(F.col(scene), F.col("object_id").alias(f"{n}_id"), *[F.col(c).alias(f"{n}_{'box' if c == 'bbox' else c}") for c in columns])

    return side("a").join(side("b"), scene).where("a_id < b_id")


def decided(a: Column, b: Column, a_label: Column, b_label: Column, whole_words: bool = False) -> Column:
    """{relation, confidence} by the decision list over boxes and labels; the first rule counts."""
    a_label, b_label = F.coalesce(a_label, F.lit("object")), F.coalesce(b_label, F.lit("object"))
    dx, dy, dz = (a[c] - b[c] for c in ("cx", "cy", "cz"))
    across = F.sqrt(dx * dx + dy * dy)
    apart = G.centre_distance(a, b)
    gap = (a["cz"] - a["d"] / 2) - (b["cz"] + b["d"] / 2)
    shared = G.xy_iou(a, b)
    closeness = 0.6 + 0.2 * F.least(F.lit(1.0), 1 / (across + 0.1))

    def out(name: str, confidence: Column | float) -> Column:
        confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
        return F.struct(F.lit(name).alias("relation"), confidence.alias("confidence"))

    sideways = (F.abs(dx) > F.abs(dy)) & (F.abs(dx) > 0.3)
    along = ~sideways & (F.abs(dy) > 0.3)
    return (
        F.when((gap > -0.1) & (gap < 0.15) & (shared > 0.2) & L.plausible_on(a_label, b_label, whole_words), out("on", 0.8 + 0.1 * F.least(shared, F.lit(1.0))))
        .when(G.contained(a, b) & L.plausible_in(a_label, b_label, whole_words), out("in", 0.7 + 0.2 * G.containment_ratio(a, b)))
        .when((dz > 0.15) & (across < 1), out("above", closeness))
        .when((dz < -0.15) & (across < 1), out("below", closeness))
        .when(apart < 0.5, out("near", 0.7 - 0.3 * apart / 0.5))
        .when(apart < 1, out("near", 0.5 - 0.2 * apart))
        .when(sideways & (dx > 0), out("right_of", 0.5))
        .when(sideways, out("left_of", 0.5))
        .when(along & (dy > 0), out("front_of", 0.5))
        .when(along, out("behind", 0.5))
        .otherwise(out("none", 0.1))
    )


def reasoned_relations(objects: DataFrame, scene: str = "scene_id", min_confidence: float = 0.5, whole_words: bool = False) -> DataFrame:
    """One relation a pair of a scene by the decision list; none and unsure ones are dropped."""
    pairs = scene_pairs(objects, scene).where("a_box IS NOT NULL AND b_box IS NOT NULL")
    found = pairs.withColumn("r", decided(F.col("a_box"), F.col("b_box"), F.col("a_label"), F.col("b_label"), whole_words))
    rows = found.select(scene, F.col("a_id").alias("object_a_id"), F.col("b_id").alias("object_b_id"), F.col("r.relation").alias("relation_type"), F.col("r.confidence").alias("confidence"))
    return confident(rows, min_confidence)


def confident(relations: DataFrame, min_confidence: float) -> DataFrame:
    return relations.where((F.col("confidence") >= min_confidence) & (F.col("relation_type") != "none"))


def common_frames(objects: DataFrame, scene: str = "scene_id") -> DataFrame:
    """For pairs of a scene seen at the same time: the overlap of their frames and its midpoint."""
    pairs = scene_pairs(objects, scene, ("first_seen_frame", "last_seen_frame"))
    first, last = F.greatest("a_first_seen_frame", "b_first_seen_frame"), F.least("a_last_seen_frame", "b_last_seen_frame")
    rows = pairs.where(first <= last)
    return rows.select(scene, "a_id", "b_id", first.alias("first_frame"), last.alias("last_frame"), F.expr("(greatest(a_first_seen_frame, b_first_seen_frame) + least(a_last_seen_frame, b_last_seen_frame)) div 2").alias("frame_idx"))


def visual_relations(objects: DataFrame, answers: DataFrame, scene: str = "scene_id", min_confidence: float = 0.5) -> DataFrame:
    """Relations by a model's answers on pairs at their common frame; pairs without an answer fall
    back to the decision list. ``answers``: a_id, b_id, answer (null: the model failed)."""
    frames = common_frames(objects, scene).select("a_id", "b_id", "frame_idx")
    pairs = scene_pairs(objects, scene).where("a_box IS NOT NULL AND b_box IS NOT NULL").join(frames, ["a_id", "b_id"], "left").join(answers.select("a_id", "b_id", "answer"), ["a_id", "b_id"], "left")
    seen = F.col("answer").isNotNull() & F.col("frame_idx").isNotNull()
    said = L.parsed_answer(F.col("answer"))
    ruled = decided(F.col("a_box"), F.col("b_box"), F.col("a_label"), F.col("b_label"))
    rows = pairs.select(
        scene,
        F.col("a_id").alias("object_a_id"),
        F.col("b_id").alias("object_b_id"),
        F.when(seen, said).otherwise(ruled["relation"]).alias("relation_type"),
        F.when(seen, L.answer_confidence(said)).otherwise(ruled["confidence"]).alias("confidence"),
        F.when(seen, "visual").otherwise("rules").alias("method"),
        "frame_idx",
    )
    return confident(rows, min_confidence)


def relate(objects: DataFrame, method: str = "geometric", overlap: DataFrame | None = None, answers: DataFrame | None = None, config: RelationConfig = RelationConfig(), min_confidence: float | None = None) -> DataFrame:
    """Edges by exactly one method: geometric (needs ``overlap``), rules, or visual (needs ``answers``)."""
    if method == "geometric":
        if overlap is None:
            raise ValueError("the geometric method needs overlap ratios")
        found = compute_relations(objects, overlap, config)
        return found if min_confidence is None else confident(found, min_confidence)
    if method == "rules":
        return reasoned_relations(objects, min_confidence=0.5 if min_confidence is None else min_confidence)
    if method == "visual":
        if answers is None:
            raise ValueError("the visual method needs a model's answers")
        return visual_relations(objects, answers, min_confidence=0.5 if min_confidence is None else min_confidence)
    raise ValueError(f"unknown method {method!r}")
