"""Queries on tracks, distance fields, sinks and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import geometry as G
from lodestrata.functions import language as L
from lodestrata.operators import graph as GR
from lodestrata.operators import masks as M
from lodestrata.operators import projection as P
from lodestrata.operators import providers, tsdf
from lodestrata.operators import relations as R
from lodestrata.operators import tracking as T
from lodestrata.operators.checkpoints import cut
from lodestrata.plans.common import Views, query, r6
from lodestrata.plans.relations_queries import _NAME, _SURE, EDGES, PAIRS, edges_of
from lodestrata.sources import scenes


def _observed(v: Views) -> DataFrame:
    """Detections that carry the object that they show."""
    return v.detections


_FRAMES = "frames AS (SELECT scene_id, frame_idx, row_number() OVER (PARTITION BY scene_id ORDER BY frame_idx) AS k FROM (SELECT DISTINCT scene_id, frame_idx FROM v_detections))"


@query(
    "track_summary",
    f"""WITH {_FRAMES}, seen AS (SELECT scene_id, object_id, min(frame_idx) AS first_seen_frame, max(frame_idx) AS last_seen_frame, count(*) AS num_observations FROM v_detections GROUP BY ALL),
 gap AS (SELECT s.*, least(10, (SELECT max(k) FROM frames x WHERE x.scene_id = s.scene_id) - f.k) AS num_missing_frames FROM seen s JOIN frames f ON f.scene_id = s.scene_id AND f.frame_idx = s.last_seen_frame)
SELECT *, CASE WHEN num_missing_frames >= 10 THEN 'inactive' WHEN num_missing_frames > 0 THEN 'missing' ELSE 'active' END AS status FROM gap""",
)
def track_summary(v: Views) -> DataFrame:
    rows = _observed(v)
    return T.summarise(rows, rows)


@query(
    "status_by_frame",
    f"""WITH {_FRAMES}, born AS (SELECT scene_id, object_id, min(frame_idx) AS first FROM v_detections GROUP BY ALL),
 grid AS (SELECT b.scene_id, b.object_id, f.frame_idx, f.k, EXISTS (SELECT 1 FROM v_detections d WHERE d.scene_id = b.scene_id AND d.object_id = b.object_id AND d.frame_idx = f.frame_idx) AS seen FROM born b JOIN frames f ON f.scene_id = b.scene_id AND f.frame_idx >= b.first),
 gaps AS (SELECT scene_id, object_id, frame_idx, k - max(CASE WHEN seen THEN k END) OVER (PARTITION BY scene_id, object_id ORDER BY frame_idx) AS misses FROM grid)
, told AS (SELECT g.*, CASE WHEN misses >= 10 THEN 'inactive' WHEN misses > 0 THEN 'missing' ELSE 'active' END AS status, f.k - misses AS seen_k FROM gaps g JOIN frames f USING (scene_id, frame_idx))
SELECT t.scene_id, object_id, f.frame_idx AS seen_frame, status, min(t.frame_idx) AS from_frame, max(t.frame_idx) AS to_frame FROM told t JOIN frames f ON f.scene_id = t.scene_id AND f.k = seen_k GROUP BY ALL""",
)
def status_by_frame(v: Views) -> DataFrame:
    rows = _observed(v)
    return T.status_intervals(rows, rows)


@query("seen_at_frame", "SELECT scene_id, object_id, arg_max(frame_idx, (frame_idx, det_idx)) AS frame_idx, arg_max(det_idx, (frame_idx, det_idx)) AS det_idx FROM v_detections WHERE frame_idx <= 100 GROUP BY ALL")
def seen_at_frame(v: Views) -> DataFrame:
    return T.seen_at(_observed(v), 100).select("scene_id", "object_id", "frame_idx", "det_idx")


def embedded(v: Views) -> DataFrame:
    """Detections with the embedding of their user, the user's number modulo the table's count."""
    e = v.table("embeddings").select(F.col("vec_id").alias("_u"), "embedding")
    d = _observed(v).withColumn("_u", F.pmod(F.col("object_id"), F.lit(e.count())))
    return d.join(e.hint("merge"), "_u", "left")


def tracked(v: Views, **options: object) -> DataFrame:
    """Tracks of detections with embeddings by user, so that objects can be found again."""
    return T.track(embedded(v), _observed(v), T.TrackerConfig(**options))


@query("tracker_snapshot")
def tracker_snapshot(v: Views) -> DataFrame:
    return tracked(v).withColumn("similarity", F.round("similarity", 6))


@query("tracker_sequential")
def tracker_sequential(v: Views) -> DataFrame:
    return tracked(v, matching="sequential", one_to_one=True).withColumn("similarity", F.round("similarity", 6))


@query("tracker_statistics")
def tracker_statistics(v: Views) -> DataFrame:
    rows = tracked(v)
    return T.statistics(rows, T.summarise(rows, _observed(v)))


@query(
    "ema_embeddings",
    """WITH RECURSIVE r AS (SELECT CAST(label AS VARCHAR) AS scene_id, vec_id % 7 AS object_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label, vec_id % 7 ORDER BY vec_id) AS k FROM embeddings),
 m AS (SELECT scene_id, object_id, k, e AS v FROM r WHERE k = 1
  UNION ALL SELECT scene_id, object_id, k, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) FROM (
   SELECT r.scene_id, r.object_id, r.k, list_transform(list_zip(r.e, m.v), lambda p: 0.7e0 * p[1] + 0.3e0 * p[2]) AS u FROM m JOIN r ON r.scene_id = m.scene_id AND r.object_id = m.object_id AND r.k = m.k + 1) t)
SELECT scene_id, object_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(v[1], 5) AS first FROM m WHERE k = (SELECT max(k) FROM r WHERE r.scene_id = m.scene_id AND r.object_id = m.object_id)""",
)
def ema_embeddings(v: Views) -> DataFrame:
    e = v.table("embeddings").selectExpr("CAST(label AS STRING) AS scene_id", "vec_id % 7 AS object_id", "CAST(vec_id AS INT) AS frame_idx", "0 AS det_idx", "embedding")
    rows = T.ema_embeddings(e)
    return rows.select("scene_id", "object_id", F.round(G.norm(F.col("embedding")), 6).alias("norm"), F.round(F.col("embedding")[0], 5).alias("first"))


@query(
    "quaternions",
    """WITH p AS (SELECT event_id, CAST(event_id % 360 AS DOUBLE) * pi() / 180 AS t FROM events)
SELECT event_id, round(CASE WHEN 1 + 2 * cos(t) > 0 THEN sin(t) / sqrt(2 + 2 * cos(t)) ELSE sqrt(2 - 2 * cos(t)) / 2 END, 5) AS qz,
 round(CASE WHEN 1 + 2 * cos(t) > 0 THEN sqrt(2 + 2 * cos(t)) / 2 ELSE 2 * sin(t) / (2 * sqrt(2 - 2 * cos(t))) END, 5) AS qw FROM p""",
)
def quaternions(v: Views) -> DataFrame:
    t = (F.col("event_id") % 360).cast("double") * F.pi() / 180
    zero, one = F.lit(0.0), F.lit(1.0)
    pose = F.array(F.cos(t), -F.sin(t), zero, zero, F.sin(t), F.cos(t), zero, zero, zero, zero, one, zero, zero, zero, zero, one)
    return v.table("events").select("event_id", pose.alias("pose")).select("event_id", F.round(G.quaternion(F.col("pose"))["z"], 5).alias("qz"), F.round(G.quaternion(F.col("pose"))["w"], 5).alias("qw"))


@query(
    "camera_trajectory",
    """SELECT event_type AS scene_id, event_id AS frame_idx, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS start_x, value AS end_x FROM events""",
)
def camera_trajectory(v: Views) -> DataFrame:
    zero = F.lit(0.0)
    pose = F.array(*[F.col("value") if i == 3 else zero for i in range(16)])
    rows = T.trajectory(v.table("events").select(F.col("event_type").alias("scene_id"), F.col("event_id").alias("frame_idx"), pose.alias("pose")))
    return rows.select("scene_id", "frame_idx", F.col("start.x").alias("start_x"), F.col("end.x").alias("end_x"))


_WORDS = "string_split_regex(lower(trim(a)), '[^a-z]+')"


@query(
    "parsed_answers",
    f"""WITH q AS (SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN 'On top of it' WHEN 1 THEN 'on.' WHEN 2 THEN 'under it' WHEN 3 THEN 'in' WHEN 4 THEN 'it is inside' WHEN 5 THEN 'next to' WHEN 6 THEN 'one of them'
   WHEN 7 THEN 'to the left' WHEN 8 THEN 'in front' WHEN 9 THEN 'Behind' ELSE '' END AS a FROM part)
SELECT p_partkey, CASE WHEN contains(lower(a), 'on top of') OR list_filter({_WORDS}, lambda w: w <> '')[1] = 'on' THEN 'on' WHEN list_contains({_WORDS}, 'under') THEN 'below'
 WHEN list_has_any({_WORDS}, ['in', 'inside']) THEN 'in' WHEN contains(lower(a), 'next to') THEN 'near' WHEN list_contains({_WORDS}, 'left') THEN 'left_of' WHEN list_contains({_WORDS}, 'front') THEN 'front_of'
 WHEN list_contains({_WORDS}, 'behind') THEN 'behind' ELSE 'none' END AS relation FROM q""",
)
def parsed_answers(v: Views) -> DataFrame:
    answers = ["On top of it", "on.", "under it", "in", "it is inside", "next to", "one of them", "to the left", "in front", "Behind", ""]
    answer = F.array(*[F.lit(a) for a in answers])[(F.col("p_partkey") % 11).cast("int")]
    return v.table("part").select("p_partkey", L.parsed_answer(answer).alias("relation"))


@query("tsdf_field")
def tsdf_field(v: Views) -> DataFrame:
    depth = v.depth
    unit = F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)])
    frames = depth.select("frame_idx").distinct().select("frame_idx", *[F.lit(x).alias(n) for n, x in (("fx", 6.0), ("fy", 6.0), ("cx", 4.5), ("cy", 4.5))], unit.alias("pose"))
    field = tsdf.integrate(depth, frames, 0.2, 0.4, 10.0, 16, 16)
    return field.select("vx", "vy", "vz", r6("sdf"), "weight")


@query("tsdf_surface")
def tsdf_surface(v: Views) -> DataFrame:
    return tsdf.surface_points(tsdf_field(v), 0.2).select(r6("x"), r6("y"), r6("z"))


@query(
    "objects_document",
    """SELECT count(*) AS total, count(*) FILTER (num_observations >= 2 AND num_points >= 100) AS exported, min(object_id) FILTER (num_observations >= 2 AND num_points >= 100) AS first_id,
 count(*) FILTER (status = 'active') AS active FROM v_objects""",
)
def objects_document(v: Views) -> DataFrame:
    paths = {"total": "$.metadata.total_objects", "exported": "$.metadata.exported_objects", "first_id": "$.objects[0].object_id", "active": "$.statistics.active_objects"}
    return scenes.objects_document(v.objects).select(*[F.get_json_object("value", p).cast("long").alias(n) for n, p in paths.items()])


@query(
    "graph_document",
    f"""WITH RECURSIVE {{head}}{PAIRS}, {EDGES}, sure AS (SELECT * FROM edges WHERE relation_type = 'on' AND confidence >= 0.5),
 near AS (SELECT object_a_id AS u, object_b_id AS v FROM sure UNION SELECT object_b_id, object_a_id FROM sure),
 reach(object_id, root) AS (SELECT object_id, object_id FROM v_objects UNION SELECT near.v, reach.root FROM reach JOIN near ON near.u = reach.object_id)
 SELECT (SELECT count(*) FROM v_objects) AS num_nodes, (SELECT count(*) FROM sure) AS num_edges, count(DISTINCT least_root) AS num_components FROM (SELECT object_id, min(root) AS least_root FROM reach GROUP BY object_id)""",
)
def graph_document(v: Views) -> DataFrame:
    on = cut(GR.get_relations(edges_of(v), relation_type="on", min_confidence=0.5))  # read several times
    parts = GR.connected_components(v.objects, on.select(F.col("object_a_id").alias("a_id"), F.col("object_b_id").alias("b_id")))
    doc = scenes.graph_document(v.objects, on, parts)
    # read back from the elements of the document: those that are JSON with the field that names them
    named = {"num_nodes": ("objects", "object_id"), "num_edges": ("relations", "relation_type"), "num_components": ("components", "component_id")}
    return doc.agg(*[F.count_if((F.col("section") == s) & F.get_json_object("value", f"$.{k}").isNotNull()).alias(n) for n, (s, k) in named.items()])


@query("object_rows_as_json", "SELECT object_id, label FROM v_objects")
def object_rows_as_json(v: Views) -> DataFrame:
    rows = scenes.to_dicts(v.objects)
    return rows.select("object_id", F.get_json_object("value", "$.label").alias("label"))


@query("embedded_labels")
def embedded_labels(v: Views) -> DataFrame:
    rows = providers.embed(v.objects.select("object_id", "label"), "hashed-words", "label")
    return providers.text_query(rows, "hashed-words", "table red widget", 5, 0.2).select("object_id", r6("similarity"))


@query("tsdf_mesh")
def tsdf_mesh(v: Views) -> DataFrame:
    return tsdf.mesh_statistics(tsdf.mesh(tsdf_field(v), 0.2)).select("num_triangles", r6("area"), r6("box_volume"))


@query("unmatched_tracks", "SELECT DISTINCT scene_id, object_id FROM v_detections d WHERE NOT EXISTS (SELECT 1 FROM v_detections e WHERE e.scene_id = d.scene_id AND e.object_id = d.object_id AND e.frame_idx BETWEEN 100 AND 150)")
def unmatched_tracks(v: Views) -> DataFrame:
    return T.unmatched(_observed(v), _observed(v).where("frame_idx BETWEEN 100 AND 150"))


@query(
    "example_pairs",
    f"""WITH {PAIRS}, {EDGES}, numbered AS (SELECT *, row_number() OVER (PARTITION BY relation_type ORDER BY object_a_id, object_b_id) AS rank FROM edges WHERE relation_type IN ('on', 'in', 'near'))
SELECT relation_type, object_a_id, object_b_id, CAST(rank AS INT) AS rank FROM numbered WHERE rank <= 2""",
)
def example_pairs(v: Views) -> DataFrame:
    rows = edges_of(v).withColumn("seq", F.lit(0)).withColumn("metadata", F.create_map(F.lit("method"), F.lit("visual")))
    return GR.example_pairs(rows).select("relation_type", "object_a_id", "object_b_id", "rank")


@query(
    "visual_relations",
    f"""WITH {PAIRS}, said AS (SELECT scene_id, a_id, b_id, b_id = a_id + 1 AND a_id % 3 > 0 AND greatest(a_first_seen_frame, b_first_seen_frame) <= least(a_last_seen_frame, b_last_seen_frame) AS seen, {_NAME} AS rule, {_SURE} AS sure FROM pairs)
SELECT * FROM (SELECT a_id AS object_a_id, b_id AS object_b_id, CASE WHEN seen THEN 'near' ELSE rule END AS relation_type, round(CASE WHEN seen THEN 0.85 ELSE sure END, 6) AS confidence, CASE WHEN seen THEN 'visual' ELSE 'rules' END AS method FROM said)
 WHERE relation_type <> 'none' AND confidence >= 0.5""",
)
def visual_relations(v: Views) -> DataFrame:
    answers = v.objects.select(F.col("object_id").alias("a_id"), (F.col("object_id") + 1).alias("b_id"), F.when(F.col("object_id") % 3 > 0, F.lit("next to")).alias("answer"))
    return R.relate(v.objects, "visual", answers=answers).select("object_a_id", "object_b_id", "relation_type", r6("confidence"), "method")


@query("embedding_projection")
def embedding_projection(v: Views) -> DataFrame:
    rows = v.table("embeddings").select("vec_id", "embedding")
    return P.principal(rows, "embedding", 2).where("projected IS NOT NULL").select("vec_id", *[F.round(F.abs(F.col("projected")[k]), 4).alias(f"p{k}") for k in range(2)])


@query(
    "filled_masks",
    """WITH edge AS (SELECT frame_idx, det_idx, min(row) AS y1, max(row) AS y2, min(col) AS x1, max(col) AS x2 FROM v_mask_pixels GROUP BY ALL),
 sized AS (SELECT *, (y2 - y1 + 1) * (x2 - x1 + 1) AS whole, greatest(0, y2 - y1 - 1) * greatest(0, x2 - x1 - 1) AS hole FROM edge)
SELECT frame_idx, det_idx, CAST(CASE WHEN hole < 5 THEN whole ELSE whole - hole END AS BIGINT) AS area FROM sized""",
)
def filled_masks(v: Views) -> DataFrame:
    """The outlines of the rectangles: a hole of fewer than five pixels is filled, a larger one is not."""
    pixels = v.mask_pixels
    edge = pixels.groupBy("frame_idx", "det_idx").agg(F.min("row").alias("y1"), F.max("row").alias("y2"), F.min("col").alias("x1"), F.max("col").alias("x2"))
    outline = pixels.join(edge, ["frame_idx", "det_idx"]).where("row IN (y1, y2) OR col IN (x1, x2)").select("frame_idx", "det_idx", "row", "col")
    return M.fill_holes(outline, 16, 16, 5).groupBy("frame_idx", "det_idx").agg(F.count("*").alias("area"))
