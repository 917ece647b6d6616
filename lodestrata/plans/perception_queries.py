"""Queries on detections, masks and point clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import geometry as G
from lodestrata.operators import clouds as C
from lodestrata.operators import masks as M
from lodestrata.operators import relations as R
from lodestrata.plans.common import Views, query, r6
from lodestrata.plans.relations_queries import CLOUD_PAIRS, EDGES


@query("large_masks", "SELECT scene_id, frame_idx, det_idx, area FROM v_detections WHERE area >= 100")
def large_masks(v: Views) -> DataFrame:
    return M.large_enough(v.detections).select("scene_id", "frame_idx", "det_idx", "area")


@query("top_masks_by_score", "SELECT frame_idx, det_idx, score FROM (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY score DESC, det_idx) AS k FROM v_detections) WHERE k <= 5")
def top_masks_by_score(v: Views) -> DataFrame:
    return M.top_per_frame(v.detections, 5).select("frame_idx", "det_idx", "score")


@query("top_masks_by_area", "SELECT frame_idx, det_idx, area FROM (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY area DESC, det_idx) AS k FROM v_detections) WHERE k <= 5")
def top_masks_by_area(v: Views) -> DataFrame:
    return M.top_per_frame(v.detections, 5, "area").select("frame_idx", "det_idx", "area")


@query("masks_per_frame", "SELECT frame_idx, count(*) AS n_masks FROM v_detections GROUP BY frame_idx")
def masks_per_frame(v: Views) -> DataFrame:
    return M.per_frame(v.detections)


@query("mask_statistics", "SELECT count(*) AS n_masks, CAST(sum(area) AS BIGINT) AS pixels, round(avg(area), 6) AS mean_area, min(score) AS min_score, max(score) AS max_score FROM v_detections")
def mask_statistics(v: Views) -> DataFrame:
    return M.statistics(v.detections).select("n_masks", "pixels", r6("mean_area"), "min_score", "max_score")


@query("mask_boxes", "SELECT frame_idx, det_idx, min(col) AS x1, min(row) AS y1, max(col) AS x2, max(row) AS y2, count(*) AS area FROM v_mask_pixels GROUP BY frame_idx, det_idx")
def mask_boxes(v: Views) -> DataFrame:
    return M.mask_boxes(v.mask_pixels)


@query(
    "mask_overlap",
    """WITH areas AS (SELECT frame_idx, det_idx, count(*) AS area FROM v_mask_pixels GROUP BY ALL),
 shared AS (SELECT a.frame_idx, a.det_idx AS a_idx, b.det_idx AS b_idx, count(*) AS shared FROM v_mask_pixels a JOIN v_mask_pixels b ON a.frame_idx = b.frame_idx AND a.row = b.row AND a.col = b.col AND a.det_idx < b.det_idx GROUP BY ALL)
SELECT s.frame_idx, a_idx, b_idx, shared, round(shared / (a.area + b.area - shared), 6) AS iou, round(shared / least(a.area, b.area), 6) AS containment
FROM shared s JOIN areas a ON a.frame_idx = s.frame_idx AND a.det_idx = a_idx JOIN areas b ON b.frame_idx = s.frame_idx AND b.det_idx = b_idx""",
)
def mask_overlap(v: Views) -> DataFrame:
    return M.mask_overlap(v.mask_pixels).select("frame_idx", "a_idx", "b_idx", "shared", r6("iou"), r6("containment"))


@query("merged_masks")
def merged_masks(v: Views) -> DataFrame:
    pixels = v.mask_pixels
    scores = pixels.groupBy("frame_idx", "det_idx").agg(F.count("*").cast("double").alias("score"))
    return M.merge_masks(pixels, scores).drop("pixels", "members")


@query(
    "depth_consistent_masks",
    """WITH spread AS (SELECT frame_idx, det_idx, stddev_pop(z) AS s FROM v_mask_pixels JOIN v_depth USING (frame_idx, row, col) WHERE z > 0 GROUP BY ALL)
SELECT frame_idx, det_idx FROM (SELECT DISTINCT frame_idx, det_idx FROM v_mask_pixels) LEFT JOIN spread USING (frame_idx, det_idx) WHERE coalesce(s, 0) <= 0.9""",
)
def depth_consistent_masks(v: Views) -> DataFrame:
    masks = v.mask_pixels
    return M.consistent_depth(masks.select("frame_idx", "det_idx").distinct(), masks, v.depth, 0.9)


@query(
    "masked_points",
    """SELECT frame_idx, det_idx, round((col - 4.5) * z / 6, 6) AS x, round((row - 4.5) * z / 6, 6) AS y, z FROM v_mask_pixels JOIN v_depth USING (frame_idx, row, col) WHERE z > 0 AND z < 3""",
)
def masked_points(v: Views) -> DataFrame:
    rows = M.masked_depth(v.mask_pixels, v.depth).where("z > 0 AND z < 3")
    p = G.backproject(F.col("col"), F.col("row"), F.col("z"), *(F.lit(x) for x in (6.0, 6.0, 4.5, 4.5)))
    return rows.select("frame_idx", "det_idx", r6(p["x"], "x"), r6(p["y"], "y"), "z")


@query(
    "world_points",
    """WITH cam AS (SELECT frame_idx, row, col, (col - 4.5) * z / 6 AS x, (row - 4.5) * z / 6 AS y, z, frame_idx * 0.1 AS t FROM v_depth WHERE z > 0 AND z < 4)
SELECT frame_idx, round(cos(t) * x - sin(t) * y + frame_idx, 4) AS x, round(sin(t) * x + cos(t) * y - 1, 4) AS y, round(z + 0.5, 4) AS z FROM cam""",
)
def world_points(v: Views) -> DataFrame:
    t = F.col("frame_idx") * 0.1
    numbers = (F.cos(t), -F.sin(t), F.lit(0.0), F.col("frame_idx").cast("double"), F.sin(t), F.cos(t), F.lit(0.0), F.lit(-1.0), *(F.lit(x) for x in (0.0, 0.0, 1.0, 0.5, 0.0, 0.0, 0.0, 1.0)))
    frames = v.depth.select("frame_idx").distinct().select("frame_idx", *[F.lit(x).alias(n) for n, x in (("fx", 6.0), ("fy", 6.0), ("cx", 4.5), ("cy", 4.5))], F.array(*numbers).alias("pose"))
    return C.from_depth(v.depth, frames, 4.0).select("frame_idx", *[F.round(a, 4).alias(a) for a in "xyz"])


@query(
    "similar_detections",
    """WITH d AS (SELECT CAST(floor(vec_id / 10) AS BIGINT) AS frame_idx, CAST(vec_id % 10 AS INT) AS det_idx, embedding FROM embeddings)
SELECT * FROM (SELECT a.frame_idx, a.det_idx AS a_idx, b.det_idx AS b_idx, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS similarity
 FROM d a JOIN d b ON a.frame_idx = b.frame_idx AND a.det_idx < b.det_idx WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.2)""",
)
def similar_detections(v: Views) -> DataFrame:
    rows = v.table("embeddings").selectExpr("CAST(floor(vec_id / 10) AS BIGINT) AS frame_idx", "CAST(vec_id % 10 AS INT) AS det_idx", "embedding")
    return M.similar_in_frame(rows, 0.2).withColumn("similarity", F.round("similarity", 4))


_MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in "xyzrgb")


@query("voxels", f"SELECT object_id, CAST(floor(x / 0.5) AS BIGINT) AS vx, CAST(floor(y / 0.5) AS BIGINT) AS vy, CAST(floor(z / 0.5) AS BIGINT) AS vz, {_MEANS}, count(*) AS n FROM v_points GROUP BY 1, 2, 3, 4")
def voxels(v: Views) -> DataFrame:
    return C.voxels(v.points, 0.5).select("object_id", "vx", "vy", "vz", *[r6(c) for c in "xyzrgb"], "n")


_EXTENT = "count(*) AS num_points, round(max(x) - min(x), 6) AS size_x, round(max(y) - min(y), 6) AS size_y, round(max(z) - min(z), 6) AS size_z, round((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)), 5) AS volume"


@query("cloud_statistics", f"SELECT object_id, {_EXTENT} FROM v_points GROUP BY object_id")
def cloud_statistics(v: Views) -> DataFrame:
    return C.statistics(v.points).select("object_id", "num_points", r6("size_x"), r6("size_y"), r6("size_z"), F.round("volume", 5).alias("volume"))


@query("scene_cloud_statistics", f"SELECT {_EXTENT} FROM v_points")
def scene_cloud_statistics(v: Views) -> DataFrame:
    return C.statistics(v.points, ()).select("num_points", r6("size_x"), r6("size_y"), r6("size_z"), F.round("volume", 5).alias("volume"))


@query("gated_clouds", "SELECT object_id, count(*) AS n FROM v_points GROUP BY object_id HAVING count(*) >= 30")
def gated_clouds(v: Views) -> DataFrame:
    return C.gated(v.points, 30).groupBy("object_id").agg(F.count("*").alias("n"))


_OVERLAP = """near AS (
  SELECT a.object_id AS a_id, b.object_id AS b_id, count(DISTINCT b.id) AS n
  FROM p b JOIN (SELECT *, unnest([-1, 0, 1]) AS d FROM p) a ON CAST(floor(b.x / 0.025) AS BIGINT) = CAST(floor(a.x / 0.025) AS BIGINT) + a.d AND a.object_id <> b.object_id
   AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 < 0.025 * 0.025 GROUP BY ALL),
 overlap AS (SELECT a_id, b_id, n / (SELECT count(*) FROM p WHERE p.object_id = b_id) AS ratio FROM near)"""


@query("cloud_overlap", f"WITH p AS (SELECT *, row_number() OVER () AS id FROM v_points), {_OVERLAP} SELECT a_id, b_id, round(ratio, 6) AS ratio FROM overlap")
def cloud_overlap(v: Views) -> DataFrame:
    return C.overlap(v.points).select("a_id", "b_id", r6("ratio"))


@query(
    "overlap_relations",
    f"WITH p AS (SELECT *, row_number() OVER () AS id FROM v_points), {_OVERLAP}, {CLOUD_PAIRS}, {EDGES} SELECT object_a_id, object_b_id, relation_type, round(confidence, 5) AS confidence FROM edges",
)
def overlap_relations(v: Views) -> DataFrame:
    found = R.compute_relations(v.objects, C.overlap(v.points))
    return found.select("object_a_id", "object_b_id", "relation_type", F.round("confidence", 5).alias("confidence"))


@query(
    "clean_clouds",
    """WITH p AS (SELECT *, row_number() OVER () AS id FROM v_points),
 apart AS (SELECT a.object_id, a.id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS k FROM p a JOIN p b ON a.object_id = b.object_id),
 own AS (SELECT object_id, id, avg(d) AS m FROM apart WHERE k <= 5 GROUP BY ALL),
 cloud AS (SELECT object_id, count(*) AS n, avg(m) + coalesce(stddev_samp(m), 0) AS top FROM own GROUP BY object_id)
SELECT object_id, count(*) AS num_points FROM own JOIN cloud USING (object_id) WHERE n < 2 OR m <= top + 1e-9 GROUP BY object_id""",
)
def clean_clouds(v: Views) -> DataFrame:
    rows = C.without_outliers(v.points.select("object_id", "x", "y", "z"), 5, 1.0 + 1e-9)
    return rows.groupBy("object_id").agg(F.count("*").alias("num_points"))


@query("cloud_normals")
def cloud_normals(v: Views) -> DataFrame:
    return C.with_normals(v.points.select("object_id", "x", "y", "z"), 50.0, 8).select("object_id", *[r6(c) for c in ("nx", "ny", "nz")])


@query(
    "box_iou",
    """SELECT scene_id, a.frame_idx, a.det_idx AS a_idx, b.det_idx AS b_idx, round(s / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - s), 6) AS iou FROM (
 SELECT a.scene_id, a, b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS s
 FROM v_detections a JOIN v_detections b ON a.scene_id = b.scene_id AND a.frame_idx = b.frame_idx AND a.det_idx < b.det_idx) WHERE s > 0""",
)
def box_iou(v: Views) -> DataFrame:
    d = v.detections
    a, b = (d.select("scene_id", "frame_idx", F.col("det_idx").alias(f"{n}_idx"), F.col("bbox").alias(n)) for n in "ab")
    rows = a.join(b, ["scene_id", "frame_idx"]).where("a_idx < b_idx").withColumn("iou", G.box_iou(F.col("a"), F.col("b"))).where("iou > 0")
    return rows.select("scene_id", "frame_idx", "a_idx", "b_idx", r6("iou"))


@query("crop_boxes", "SELECT scene_id, frame_idx, det_idx, greatest(0, x1 - 6) AS x1, greatest(0, y1 - 6) AS y1, least(48, x2 + 6) AS x2, least(44, y2 + 6) AS y2 FROM v_detections")
def crop_boxes(v: Views) -> DataFrame:
    return v.detections.withColumn("c", G.crop_box(F.col("bbox"), 6.0, F.lit(48), F.lit(44))).select("scene_id", "frame_idx", "det_idx", "c.*")
