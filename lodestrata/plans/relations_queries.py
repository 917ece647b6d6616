"""Queries on spatial relations and the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import language as L
from lodestrata.operators import graph as GR
from lodestrata.operators import relations as R
from lodestrata.operators.objects import by_label, confirmed
from lodestrata.plans.common import Views, query, r6

_SIDES = ", ".join(f"{s}.{c} {o} {s}.{n} / 2 AS {s}{c[1]}{k}" for s in "ab" for c, n in (("cx", "w"), ("cy", "h"), ("cz", "d")) for o, k in (("-", 0), ("+", 1)))
_SHARED = ", ".join(f"least(a{c}1, b{c}1) - greatest(a{c}0, b{c}0) AS s{c}" for c in "xyz")
_COLUMNS = ", ".join(f"{s}.{c} AS {s}_{c}" for s in "ab" for c in ("cx", "cy", "cz", "w", "h", "d", "label", "first_seen_frame", "last_seen_frame"))
CLOUD_PAIRS = f"""pairs AS (
  SELECT *, {_SHARED} FROM (
    SELECT a.scene_id, a.object_id AS a_id, b.object_id AS b_id, {_COLUMNS}, {_SIDES}
    FROM (SELECT DISTINCT least(a_id, b_id) AS x, greatest(a_id, b_id) AS y FROM overlap WHERE ratio >= 0.01) o JOIN v_objects a ON a.object_id = o.x JOIN v_objects b ON b.object_id = o.y))"""
PAIRS = f"""pairs AS (
  SELECT *, {_SHARED} FROM (
    SELECT a.scene_id, a.object_id AS a_id, b.object_id AS b_id, {_COLUMNS}, {_SIDES}
    FROM v_objects a JOIN v_objects b ON a.scene_id = b.scene_id AND a.object_id < b.object_id))"""


def _on(a: str, b: str) -> str:
    share = f"CASE WHEN {a}_w * {a}_h = 0 THEN 0 ELSE sx * sy / ({a}_w * {a}_h) END"
    gap = f"abs({a}z0 - {b}z1)"
    return f"CASE WHEN {gap} <= 0.05 AND sx > 0 AND sy > 0 AND {share} >= 0.3 THEN (1 - least({gap} / 0.05, 1) + least({share} / 0.3, 1)) / 2 END"


def _in(a: str, b: str) -> str:
    inside = " AND ".join(f"{a}{c}0 >= {b}{c}0 AND {a}{c}1 <= {b}{c}1" for c in "xyz")
    share = f"CASE WHEN {a}_w * {a}_h * {a}_d = 0 THEN 0 ELSE sx * sy * sz / ({a}_w * {a}_h * {a}_d) END"
    return f"CASE WHEN {inside} THEN 1.0 WHEN sx > 0 AND sy > 0 AND sz > 0 AND {share} >= 0.8 THEN {share} END"


_APART = "sqrt((a_cx - b_cx) ** 2 + (a_cy - b_cy) ** 2 + (a_cz - b_cz) ** 2)"
_MOST = "greatest(abs(a_cx - b_cx), abs(a_cy - b_cy), abs(a_cz - b_cz))"
_WAY = f"""CASE WHEN abs(a_cx - b_cx) = {_MOST} THEN CASE WHEN a_cx - b_cx > 0 THEN 'right_of' ELSE 'left_of' END
 WHEN abs(a_cy - b_cy) = {_MOST} THEN CASE WHEN a_cy - b_cy > 0 THEN 'front_of' ELSE 'behind' END
 WHEN a_cz - b_cz > 0 THEN 'above' ELSE 'below' END"""
EDGES = f"""edges AS (
  SELECT * FROM (
    SELECT scene_id, a_id AS object_a_id, b_id AS object_b_id, 'on' AS relation_type, {_on("a", "b")} AS confidence FROM pairs UNION ALL
    SELECT scene_id, b_id, a_id, 'on', {_on("b", "a")} FROM pairs UNION ALL
    SELECT scene_id, a_id, b_id, 'in', {_in("a", "b")} FROM pairs UNION ALL
    SELECT scene_id, b_id, a_id, 'in', {_in("b", "a")} FROM pairs UNION ALL
    SELECT scene_id, a_id, b_id, 'near', CASE WHEN {_APART} <= 0.5 THEN 1 - {_APART} / 0.5 END FROM pairs UNION ALL
    SELECT scene_id, a_id, b_id, {_WAY}, CASE WHEN {_MOST} >= 0.3 THEN least({_MOST} / 0.3, 1) END FROM pairs)
  WHERE confidence IS NOT NULL)"""


def edges_of(v: Views) -> DataFrame:
    """All geometric edges between objects of a scene."""
    return R.pair_relations(R.scene_pairs(v.objects))


@query("geometric_relations", f"WITH {PAIRS}, {EDGES} SELECT object_a_id, object_b_id, relation_type, round(confidence, 5) AS confidence FROM edges")
def geometric_relations(v: Views) -> DataFrame:
    return edges_of(v).select("object_a_id", "object_b_id", "relation_type", F.round("confidence", 5).alias("confidence"))


@query("relation_summary", f"WITH {PAIRS}, {EDGES} SELECT relation_type, count(*) AS n, round(sum(confidence), 3) AS confidence FROM edges GROUP BY relation_type")
def relation_summary(v: Views) -> DataFrame:
    return GR.relation_summary(edges_of(v)).withColumn("confidence", F.round("confidence", 3))


@query("relations_of_object", f"WITH {PAIRS}, {EDGES} SELECT object_a_id, object_b_id, relation_type FROM edges WHERE (object_a_id = 45 OR object_b_id = 45) AND confidence >= 0.25")
def relations_of_object(v: Views) -> DataFrame:
    return GR.get_relations(edges_of(v), object_id=45, min_confidence=0.25).select("object_a_id", "object_b_id", "relation_type")


@query("relations_by_type", f"WITH {PAIRS}, {EDGES} SELECT object_a_id, object_b_id, round(confidence, 5) AS confidence FROM edges WHERE relation_type = 'on' AND confidence >= 0.5")
def relations_by_type(v: Views) -> DataFrame:
    return GR.get_relations(edges_of(v), relation_type="on", min_confidence=0.5).select("object_a_id", "object_b_id", F.round("confidence", 5).alias("confidence"))


@query("neighbours", f"WITH {PAIRS}, {EDGES} SELECT DISTINCT CASE WHEN object_a_id = 45 THEN object_b_id ELSE object_a_id END AS object_id FROM edges WHERE relation_type = 'near' AND (object_a_id = 45 OR object_b_id = 45)")
def neighbours(v: Views) -> DataFrame:
    return GR.neighbours(edges_of(v), 45, "near")


@query(
    "related_objects",
    f"""WITH {PAIRS}, {EDGES}, targets AS (SELECT object_id FROM v_objects WHERE label <> '' AND contains(lower(label), 'table')),
 sure AS (SELECT * FROM edges WHERE relation_type = 'near' AND confidence >= 0.5)
SELECT object_id, label FROM v_objects WHERE object_id IN (
  SELECT object_b_id FROM sure WHERE object_a_id IN (SELECT object_id FROM targets) UNION SELECT object_a_id FROM sure WHERE object_b_id IN (SELECT object_id FROM targets))""",
)
def related_objects(v: Views) -> DataFrame:
    objects = v.objects
    return GR.related_objects(objects, edges_of(v), by_label(objects, "table"), "near").select("object_id", "label")


_MOVABLE, _SURFACE, _HOLDER, _HELD = (f"[{', '.join(repr(w) for w in words)}]" for words in (L.MOVABLE, L.SURFACES, L.CONTAINERS, L.CONTAINED))


def _says(label: str, words: str) -> str:
    return f"len(list_filter({words}, lambda w: contains(lower(trim({label})), w))) > 0"


_IOU = "(greatest(0, sx) * greatest(0, sy)) / (a_w * a_h + b_w * b_h - greatest(0, sx) * greatest(0, sy))"
_ACROSS = "sqrt((a_cx - b_cx) ** 2 + (a_cy - b_cy) ** 2)"
_SLACK = " AND ".join(f"a{c}0 >= b{c}0 - 0.05 AND a{c}1 <= b{c}1 + 0.05" for c in "xyz")
_CLOSE = f"0.6 + 0.2 * least(1, 1 / ({_ACROSS} + 0.1))"
_SIDE = "abs(a_cx - b_cx) > abs(a_cy - b_cy) AND abs(a_cx - b_cx) > 0.3"
_RULES = (
    (f"az0 - bz1 > -0.1 AND az0 - bz1 < 0.15 AND {_IOU} > 0.2 AND {_says('a_label', _MOVABLE)} AND {_says('b_label', _SURFACE)}", "'on'", f"0.8 + 0.1 * least({_IOU}, 1)"),
    (f"{_SLACK} AND {_says('b_label', _HOLDER)} AND ({_says('a_label', _HELD)} OR lower(trim(a_label)) <> lower(trim(b_label)))", "'in'", "0.7 + 0.2 * greatest(0, sx) * greatest(0, sy) * greatest(0, sz) / (a_w * a_h * a_d)"),
    (f"a_cz - b_cz > 0.15 AND {_ACROSS} < 1", "'above'", _CLOSE),
    (f"a_cz - b_cz < -0.15 AND {_ACROSS} < 1", "'below'", _CLOSE),
    (f"{_APART} < 0.5", "'near'", f"0.7 - 0.3 * {_APART} / 0.5"),
    (f"{_APART} < 1", "'near'", f"0.5 - 0.2 * {_APART}"),
    (_SIDE, "CASE WHEN a_cx > b_cx THEN 'right_of' ELSE 'left_of' END", "0.5"),
    (f"NOT ({_SIDE}) AND abs(a_cy - b_cy) > 0.3", "CASE WHEN a_cy > b_cy THEN 'front_of' ELSE 'behind' END", "0.5"),
)
_NAME = "CASE " + " ".join(f"WHEN {w} THEN {n}" for w, n, _ in _RULES) + " ELSE 'none' END"
_SURE = "CASE " + " ".join(f"WHEN {w} THEN {c}" for w, _, c in _RULES) + " ELSE 0.1 END"


@query(
    "reasoned_relations",
    f"WITH {PAIRS} SELECT * FROM (SELECT scene_id, a_id AS object_a_id, b_id AS object_b_id, {_NAME} AS relation_type, round({_SURE}, 5) AS confidence FROM pairs) WHERE relation_type <> 'none' AND confidence >= 0.5",
)
def reasoned_relations(v: Views) -> DataFrame:
    rows = R.reasoned_relations(v.objects)
    return rows.select("scene_id", "object_a_id", "object_b_id", "relation_type", F.round("confidence", 5).alias("confidence"))


_FIRST, _LAST = "greatest(a_first_seen_frame, b_first_seen_frame)", "least(a_last_seen_frame, b_last_seen_frame)"


@query("common_frames", f"WITH {PAIRS} SELECT scene_id, a_id, b_id, {_FIRST} AS first_frame, {_LAST} AS last_frame, CAST(({_FIRST} + {_LAST}) // 2 AS BIGINT) AS frame_idx FROM pairs WHERE {_FIRST} <= {_LAST}")
def common_frames(v: Views) -> DataFrame:
    return R.common_frames(v.objects)


@query(
    "graph_weights",
    f"""WITH {PAIRS}, {EDGES} SELECT least(object_a_id, object_b_id) AS a_id, greatest(object_a_id, object_b_id) AS b_id, round(sum(confidence), 4) AS weight
 FROM edges WHERE object_a_id IN (SELECT object_id FROM v_objects WHERE num_observations >= 2 AND num_points >= 100) AND object_b_id IN (SELECT object_id FROM v_objects WHERE num_observations >= 2 AND num_points >= 100) GROUP BY ALL""",
)
def graph_weights(v: Views) -> DataFrame:
    return GR.weights(edges_of(v), confirmed(v.objects)).select("a_id", "b_id", F.round("weight", 4).alias("weight"))


@query(
    "connected_components",
    f"""WITH RECURSIVE {{head}}{PAIRS}, {EDGES},
 near AS (SELECT object_a_id AS u, object_b_id AS v FROM edges WHERE relation_type = 'on' UNION SELECT object_b_id, object_a_id FROM edges WHERE relation_type = 'on'),
 reach(object_id, root) AS (SELECT object_id, object_id FROM v_objects UNION SELECT near.v, reach.root FROM reach JOIN near ON near.u = reach.object_id)
 SELECT object_id, min(root) AS component_id FROM reach GROUP BY object_id""",
)
def connected_components(v: Views) -> DataFrame:
    on = GR.get_relations(edges_of(v), relation_type="on").select(F.col("object_a_id").alias("a_id"), F.col("object_b_id").alias("b_id"))
    return GR.connected_components(v.objects, on)


@query("spanning_forest")
def spanning_forest(v: Views) -> DataFrame:
    weights = GR.weights(edges_of(v), v.objects)
    return GR.spanning_forest(v.objects, weights).select("a_id", "b_id", r6("weight"))


@query("spanning_forest_by_scene")
def spanning_forest_by_scene(v: Views) -> DataFrame:
    scene = v.objects.select(F.col("object_id").alias("a_id"), "scene_id")
    weights = GR.weights(edges_of(v), v.objects).join(scene, "a_id")
    return GR.scene_forests(v.objects, weights)


@query(
    "component_lists",
    f"""WITH RECURSIVE {{head}}{PAIRS}, {EDGES},
 near AS (SELECT object_a_id AS u, object_b_id AS v FROM edges WHERE relation_type = 'on' UNION SELECT object_b_id, object_a_id FROM edges WHERE relation_type = 'on'),
 reach(object_id, root) AS (SELECT object_id, object_id FROM v_objects UNION SELECT near.v, reach.root FROM reach JOIN near ON near.u = reach.object_id),
 labels AS (SELECT object_id, min(root) AS component_id FROM reach GROUP BY object_id)
 SELECT component_id, array_to_string(list(object_id ORDER BY object_id), ',') AS object_ids, count(*) AS size FROM labels GROUP BY component_id""",
)
def component_lists(v: Views) -> DataFrame:
    rows = GR.component_lists(connected_components(v))
    return rows.select("component_id", F.array_join(F.col("object_ids").cast("array<string>"), ",").alias("object_ids"), "size")
