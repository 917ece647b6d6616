"""Queries that compose operators or use their options."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import geometry as G
from lodestrata.functions import language as L
from lodestrata.operators import clouds as C
from lodestrata.operators import graph as GR
from lodestrata.operators import objects as O
from lodestrata.operators import relations as R
from lodestrata.operators import tsdf
from lodestrata.plans.common import Views, query
from lodestrata.plans.relations_queries import _NAME, _SURE, EDGES, PAIRS, edges_of
from lodestrata.sources import scenes


@query(
    "related_by_similarity",
    f"""WITH {PAIRS}, {EDGES}, alike AS (SELECT e.vec_id AS object_id, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 4) AS s FROM embeddings e, embeddings q WHERE q.vec_id = 0),
 targets AS (SELECT object_id FROM alike ORDER BY s DESC, object_id LIMIT 5), sure AS (SELECT * FROM edges WHERE relation_type = 'near' AND confidence >= 0.5)
SELECT object_id FROM v_objects WHERE object_id IN (
  SELECT object_b_id FROM sure WHERE object_a_id IN (SELECT object_id FROM targets) UNION SELECT object_a_id FROM sure WHERE object_b_id IN (SELECT object_id FROM targets))""",
)
def related_by_similarity(v: Views) -> DataFrame:
    """No label names a sofa, so the five objects most similar to the first vector stand in for it."""
    rows = v.table("embeddings").select(F.col("vec_id").alias("object_id"), "embedding")
    similar = O.search(rows, rows.where("object_id = 0").withColumnRenamed("object_id", "query_id"), 5, -1.0, places=4)
    objects = v.objects
    return GR.related_objects(objects, edges_of(v), GR.targets(objects, "sofa", similar), "near").select("object_id")


@query("targets_by_label", "SELECT object_id FROM v_objects WHERE label <> '' AND contains(lower(label), 'lamp')")
def targets_by_label(v: Views) -> DataFrame:
    return GR.targets(v.objects, "Lamp", v.objects.select("object_id"))


@query(
    "first_relations",
    f"""WITH {PAIRS}, {EDGES} SELECT * FROM (SELECT least(object_a_id, object_b_id) AS low_id, greatest(object_a_id, object_b_id) AS high_id, count(*) AS n FROM edges GROUP BY ALL) ORDER BY low_id, high_id LIMIT 3""",
)
def first_relations(v: Views) -> DataFrame:
    """The pairs of the first edges, up to the third pair."""
    rows = GR.first_relations(edges_of(v), 18).groupBy(F.least("object_a_id", "object_b_id").alias("low_id"), F.greatest("object_a_id", "object_b_id").alias("high_id"))
    pairs = rows.agg(F.lit(1)).select("low_id", "high_id").orderBy("low_id", "high_id").limit(3)
    counted = edges_of(v).groupBy(F.least("object_a_id", "object_b_id").alias("low_id"), F.greatest("object_a_id", "object_b_id").alias("high_id")).agg(F.count("*").alias("n"))
    return counted.join(pairs, ["low_id", "high_id"])


@query("cloud_by_id", "SELECT x, y, z FROM v_points WHERE object_id = 45 AND (SELECT count(*) FROM v_points WHERE object_id = 45) >= 10")
def cloud_by_id(v: Views) -> DataFrame:
    return C.gated(v.points, 10, 45).select("x", "y", "z")


@query("cloud_by_id_too_small", "SELECT x, y, z FROM v_points WHERE false")
def cloud_by_id_too_small(v: Views) -> DataFrame:
    return C.gated(v.points, 1_000_000, 45).select("x", "y", "z")


@query(
    "clean_gated_clouds",
    """WITH p AS (SELECT *, row_number() OVER () AS id FROM v_points WHERE object_id IN (SELECT object_id FROM v_points GROUP BY object_id HAVING count(*) >= 30)),
 apart AS (SELECT a.object_id, a.id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS k FROM p a JOIN p b ON a.object_id = b.object_id),
 own AS (SELECT object_id, id, avg(d) AS m FROM apart WHERE k <= 20 GROUP BY ALL),
 cloud AS (SELECT object_id, avg(m) + 2 * stddev_samp(m) AS top FROM own GROUP BY object_id)
SELECT object_id, count(*) AS num_points FROM own JOIN cloud USING (object_id) WHERE m <= top + 1e-9 GROUP BY object_id""",
)
def clean_gated_clouds(v: Views) -> DataFrame:
    rows = C.without_outliers(C.gated(v.points, 30).select("object_id", "x", "y", "z"), 20, 2.0 + 1e-9)
    return rows.groupBy("object_id").agg(F.count("*").alias("num_points"))


@query(
    "merged_clouds",
    """SELECT object_id, CAST(floor(x / 0.5) AS BIGINT) AS vx, CAST(floor(y / 0.5) AS BIGINT) AS vy, CAST(floor(z / 0.5) AS BIGINT) AS vz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM v_points GROUP BY 1, 2, 3, 4""",
)
def merged_clouds(v: Views) -> DataFrame:
    """Two halves of the points, each downsampled on its own, merged into the cloud of all."""
    halves = [C.voxels(v.points.where(f"hash(x) % 2 {sign} 0"), 0.5) for sign in ("=", "<>")]
    return C.accumulate(halves, 0.5).select("object_id", "vx", "vy", "vz", *[F.round(c, 6).alias(c) for c in "xyz"], F.col("n").cast("long").alias("n"))


@query(
    "relation_notes",
    f"""WITH {PAIRS}, {EDGES} SELECT relation_type, CASE WHEN relation_type IN ('on', 'in') THEN CASE WHEN object_a_id < object_b_id THEN 'a_' || relation_type || '_b' ELSE 'b_' || relation_type || '_a' END END AS direction,
 CASE WHEN relation_type = 'near' THEN 'true' END AS symmetric, count(*) AS n FROM edges GROUP BY ALL""",
)
def relation_notes(v: Views) -> DataFrame:
    rows = edges_of(v).select("relation_type", F.col("metadata")["direction"].alias("direction"), F.col("metadata")["symmetric"].alias("symmetric"))
    return rows.groupBy("relation_type", "direction", "symmetric").agg(F.count("*").alias("n"))


@query("whole_pixel_crops", "SELECT scene_id, frame_idx, det_idx, CAST(trunc(greatest(0, x1 - 6.5)) AS INT) AS x1, CAST(trunc(greatest(0, y1 - 6.5)) AS INT) AS y1, CAST(trunc(least(48, x2 + 6.5)) AS INT) AS x2, CAST(trunc(least(44, y2 + 6.5)) AS INT) AS y2 FROM v_detections")
def whole_pixel_crops(v: Views) -> DataFrame:
    return v.detections.withColumn("c", G.crop_box(F.col("bbox"), 6.5, F.lit(48), F.lit(44), whole_pixels=True)).select("scene_id", "frame_idx", "det_idx", "c.*")


@query(
    "relation_names",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'on' WHEN 1 THEN 'below' WHEN 2 THEN 'left_of' WHEN 3 THEN 'none' WHEN 4 THEN 'none' ELSE 'near' END AS relation FROM part""",
)
def relation_names(v: Views) -> DataFrame:
    names = F.array(*[F.lit(n) for n in (" ON", "under", "Left_Of ", "upon", None, "near")])
    return v.table("part").select("p_partkey", L.relation_of(F.get(names, (F.col("p_partkey") % 6).cast("int"))).alias("relation"))


@query(
    "relate_by_rules",
    f"WITH {PAIRS} SELECT * FROM (SELECT a_id AS object_a_id, b_id AS object_b_id, {_NAME} AS relation_type FROM pairs WHERE {_SURE} >= 0.7) WHERE relation_type <> 'none'",
)
def relate_by_rules(v: Views) -> DataFrame:
    return R.relate(v.objects, "rules", min_confidence=0.7).select("object_a_id", "object_b_id", "relation_type")


@query("object_colours", "SELECT count(*) AS n, 0 AS outside FROM v_objects")
def object_colours(v: Views) -> DataFrame:
    """Every object's colour is the same whenever it is asked for and lies in 0..1."""
    rows = v.objects.select(G.colour_of(F.col("object_id")).alias("c"), G.colour_of(F.col("object_id") + 0).alias("d"))
    odd = (F.col("c") != F.col("d")) | ~F.col("c.r").between(0, 1) | ~F.col("c.g").between(0, 1) | ~F.col("c.b").between(0, 1)
    return rows.agg(F.count("*").alias("n"), F.count_if(odd).cast("int").alias("outside"))


@query(
    "dense_voxels",
    """WITH cells AS (SELECT object_id, CAST(floor(x / 4) AS BIGINT) AS vx, CAST(floor(y / 4) AS BIGINT) AS vy, CAST(floor(z / 4) AS BIGINT) AS vz, count(*) AS n FROM v_points GROUP BY ALL),
 least AS (SELECT object_id, quantile_cont(n, 0.25) AS q FROM cells GROUP BY object_id)
SELECT object_id, vx, vy, vz, n FROM cells JOIN least USING (object_id) WHERE n >= q""",
)
def dense_voxels(v: Views) -> DataFrame:
    """Cells with at least as many points as the lowest quarter of their object's."""
    return C.dense(C.voxels(v.points, 4.0), 0.25).select("object_id", "vx", "vy", "vz", F.col("n").cast("long").alias("n"))


@query("objects_from_json", "SELECT object_id, label, status, num_observations, num_points, round(confidence, 6) AS confidence, round(cx, 6) AS cx, round(d, 6) AS d FROM v_objects")
def objects_from_json(v: Views) -> DataFrame:
    """Objects written as JSON and read again."""
    schema = "object_id long, label string, status string, num_observations int, num_points long, confidence double, bbox STRUCT<cx: DOUBLE, d: DOUBLE>"
    rows = scenes.from_dicts(scenes.to_dicts(v.objects), schema)
    return rows.select("object_id", "label", "status", "num_observations", "num_points", F.round("confidence", 6).alias("confidence"), F.round("bbox.cx", 6).alias("cx"), F.round("bbox.d", 6).alias("d"))


@query("array_shapes", "SELECT object_id, 'clouds/obj_' || CASE WHEN object_id < 1000 THEN lpad(CAST(object_id AS VARCHAR), 3, '0') ELSE CAST(object_id AS VARCHAR) END || '_colors.npy' AS path, CAST(count(*) AS INT) AS n, 3 AS width FROM v_points GROUP BY object_id")
def array_shapes(v: Views) -> DataFrame:
    """The files of the objects' colours."""
    return scenes.to_npy(v.points, "colors", "clouds").select("object_id", "path", F.col("shape")[0].alias("n"), F.col("shape")[1].alias("width"))


@query("object_meshes")
def object_meshes(v: Views) -> DataFrame:
    """A mesh for each mask number, out of the depth that its masks cover."""
    depth = v.mask_pixels.join(v.depth, ["frame_idx", "row", "col"])
    unit = F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)])
    frames = depth.select("frame_idx").distinct().select("frame_idx", *[F.lit(x).alias(n) for n, x in (("fx", 6.0), ("fy", 6.0), ("cx", 4.5), ("cy", 4.5))], unit.alias("pose"))
    keys = ("det_idx",)
    field = tsdf.integrate(depth, frames, 0.2, 0.4, 10.0, 16, 16, keys)
    return tsdf.mesh_statistics(tsdf.mesh(field, 0.2, keys), keys).select("det_idx", "num_triangles", F.round("area", 6).alias("area"), F.round("box_volume", 6).alias("box_volume"))
