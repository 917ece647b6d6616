import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import captions, clouds, graph, masks, tracking, tsdf
from lodestrata.operators.relations import relate
from lodestrata.plans import tracking_queries
from lodestrata.plans.common import Views
from lodestrata.plans.relations_queries import edges_of
from lodestrata.sources import png, rgbd, scenes
from lodestrata.streaming.tracker import track_stream


def rectangle(frame, det, y0, x0, y1, x1):
    return [(frame, det, y, x) for y in range(y0, y1) for x in range(x0, x1)]


def test_merge_masks_grows_its_seed(spark):
    # b overlaps a, c overlaps a + b by more than half of itself but not a alone
    rows = rectangle(0, 0, 0, 0, 10, 10) + rectangle(0, 1, 0, 4, 10, 13) + rectangle(0, 2, 0, 9, 10, 14) + rectangle(0, 3, 20, 20, 22, 22)
    pixels = spark.createDataFrame(rows, "frame_idx long, det_idx int, row int, col int")
    scores = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.8), (0, 2, 0.95), (0, 3, 0.1), (0, 4, 0.05)], "frame_idx long, det_idx int, score double")
    got = {r.det_idx: r for r in masks.merge_masks(pixels, scores, iou=0.4, containment=0.75).collect()}
    assert sorted(got) == [0, 2, 3, 4] or sorted(got) == [2, 3, 4]
    total = sum(r.area for r in got.values())
    assert total >= 4 and got[3].area == 4 and got[4].area == 0 and got[4].x1 is None


def test_merge_limits_are_strict(spark):
    rows = rectangle(0, 0, 0, 0, 3, 1) + rectangle(0, 1, 1, 0, 4, 1)  # two of four shared: iou exactly 0.5
    pixels = spark.createDataFrame(rows, "frame_idx long, det_idx int, row int, col int")
    scores = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5)], "frame_idx long, det_idx int, score double")
    assert masks.merge_masks(pixels, scores).count() == 2
    assert masks.merge_masks(pixels, scores, iou=0.49).count() == 1


def test_fill_holes(spark):
    ring = [p for p in rectangle(0, 0, 1, 1, 6, 6) if not (2 <= p[2] < 5 and 2 <= p[3] < 5)]
    pixels = spark.createDataFrame(ring, "frame_idx long, det_idx int, row int, col int")
    assert masks.fill_holes(pixels, 8, 8, 10).count() == 25
    assert masks.fill_holes(pixels, 8, 8, 9).count() == 16


def test_depth_limit_keeps_empty_masks(spark):
    pixels = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 0, 1), (0, 1, 1, 0), (0, 1, 1, 1), (0, 2, 2, 0)], "frame_idx long, det_idx int, row int, col int")
    depth = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 2.0), (0, 1, 0, 1.0), (0, 1, 1, 2.25), (0, 2, 0, 0.0)], "frame_idx long, row int, col int, z double")
    kept = masks.consistent_depth(pixels.select("frame_idx", "det_idx").distinct(), pixels, depth)
    assert {r.det_idx for r in kept.collect()} == {0, 2}  # 0.5 exactly stays


def test_overlap_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = [(int(rng.integers(0, 6)), *map(float, rng.random(3) * 0.2)) for _ in range(300)]
    df = spark.createDataFrame(pts, "object_id long, x double, y double, z double")
    got = {(r.a_id, r.b_id): r.ratio for r in clouds.overlap(df).collect()}
    xyz, ids = np.array([p[1:] for p in pts]), np.array([p[0] for p in pts])
    for a in range(6):
        for b in range(6):
            if a != b:
                d2 = ((xyz[ids == b][:, None] - xyz[ids == a][None]) ** 2).sum(-1)
                assert got.get((a, b), 0.0) == pytest.approx((d2.min(axis=1) < 0.025**2).mean())
    two = clouds.overlap(df.where("object_id < 3"), others=df.where("object_id >= 3")).collect()
    assert {(r.a_id, r.b_id): r.ratio for r in two} == pytest.approx({k: v for k, v in got.items() if k[0] < 3 <= k[1]})


def test_overlap_sends_points_about_once(spark):
    # a point went to 27 cells before
    rng = np.random.default_rng(5)
    spread = [(int(rng.integers(0, 9)), *map(float, rng.random(3) * 50 - 25)) for _ in range(2000)]
    df = spark.createDataFrame(spread, "object_id long, x double, y double, z double")
    side = 0.025 * 1.001 * clouds._SIDE
    assert 2000 <= clouds._sent(df, side, 0.025 * 1.0001, clouds._BOTH).count() < 3000
    # across the borders of blocks, on both sides of 0, with equal, null and other ids and places
    near = [(int(rng.integers(0, 4)), *(float(side * rng.integers(-1, 2) + rng.normal() * 0.02) for _ in range(3))) for _ in range(600)]
    near += near[:50] + [(None, 0.0, 0.0, 0.0), (1, None, 0.0, 0.0), (1, float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(near, df.schema)
    pts = [p for p in near if p[0] is not None and p[1] is not None and p[1] == p[1]]
    xyz, ids = np.array([p[1:] for p in pts]), np.array([p[0] for p in pts])
    want = {}
    for a in range(4):
        for b in range(4):
            n = int(((((xyz[ids == b][:, None] - xyz[ids == a][None]) ** 2).sum(-1)).min(axis=1) < 0.025**2).sum())
            if a != b and n:
                want[a, b] = n / ((ids == b).sum() + 2 * (b == 1))
    assert want and {(r.a_id, r.b_id): r.ratio for r in clouds.overlap(df).collect()} == pytest.approx(want)
    names = df.withColumn("object_id", F.concat(F.lit("o"), F.col("object_id").cast("string")))
    two = clouds.overlap(names.where("object_id < 'o2'"), others=names.where("object_id >= 'o2'")).collect()
    assert {(int(r.a_id[1]), int(r.b_id[1])): r.ratio for r in two} == pytest.approx({k: v for k, v in want.items() if k[0] < 2 <= k[1]})


def test_relations_of_overlaps_list_no_cells(spark):
    from lodestrata.plans import perception_queries

    plan = perception_queries.overlap_relations(Views(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "gx" not in plan


def test_overlap_packs_points_without_loss():
    # a point took 31 bytes of a shuffle before
    import pyarrow as pa

    rng = np.random.default_rng(7)
    n, side = 200_000, 0.025 * 1.001 * clouds._SIDE
    sent = rng.integers(0, 29, n).astype(np.int8)
    few = [rng.integers(-(10**5), 10**5, n) / 100, rng.integers(0, 1000, n) / 100, rng.integers(1, 8, n) / 100]
    full = [rng.normal(size=n) * 5 for _ in range(3)]
    full[1][:3] = np.inf, -1e300, 1e-300
    numbers = pa.array(rng.integers(-(2**60), 2**60, 200)[rng.integers(0, 200, n)])
    for ids, xyz, most in ((pa.array(rng.integers(0, 20_000, n)), few, 12), (numbers, full, 40), (pa.array([f"o{i % 50}" for i in range(n)]), few, 16)):
        table = pa.table({"object_id": ids, **dict(zip("xyz", xyz)), "sent": sent})
        blobs = [b.as_py() for got in clouds._pack(side)(iter(table.to_batches(10_000))) for b in got.column("points")]
        rows = [clouds._unpacked(b, ids.type) for b in blobs]
        again = pa.concat_tables(pa.table({"object_id": i, **dict(zip("xyz", p)), "sent": s}) for i, p, s in rows)
        order = [(c, "ascending") for c in table.column_names]
        assert again.sort_by(order).equals(table.sort_by(order))
        assert sum(map(len, blobs)) < most * n


def test_voxels_are_associative(spark):
    rows = [(1, 0.1 * i, 0.0, -0.05 * i, 0.5, 0.5, 0.5) for i in range(30)]
    df = spark.createDataFrame(rows, "object_id long, x double, y double, z double, r double, g double, b double")
    once = clouds.voxels(df, 0.4).orderBy("vx", "vz").collect()
    twice = clouds.accumulate([clouds.voxels(df.where("x < 1"), 0.4), clouds.voxels(df.where("x >= 1"), 0.4)], 0.4)
    parts = twice.orderBy("vx", "vz").collect()
    assert [(r.vx, r.vz, r.n) for r in once] == [(r.vx, r.vz, r.n) for r in parts]
    assert [r.x for r in once] == pytest.approx([r.x for r in parts])
    assert clouds.voxels(df, 0).count() == 30


def test_outliers_and_normals(spark):
    rows = [(1, float(i % 5), float(i // 5), 0.0) for i in range(25)] + [(1, 40.0, 40.0, 0.0), (2, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "object_id long, x double, y double, z double")
    clean = clouds.without_outliers(df, 6, 2.0)
    assert clean.where("x = 40").count() == 0 and clean.count() == 26
    normals = clouds.with_normals(df.where("x < 10"), 1.5).where("object_id = 1").collect()
    assert all(abs(r.nz) == pytest.approx(1) for r in normals)


def boxes(spark, rows):
    return spark.createDataFrame([(s, f, d, b, e) for s, f, d, b, e in rows], "scene_id string, frame_idx int, det_idx int, bbox STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>, embedding array<float>")


A, B = (0.0, 0.0, 10.0, 10.0), (50.0, 50.0, 60.0, 60.0)
U, V = [1.0, 0.0], [0.0, 1.0]


def test_tracker_matches_creates_and_ends(spark):
    rows = [("s", 0, 0, A, U), ("s", 0, 1, B, V), ("s", 1, 0, A, U), ("s", 2, 0, A, U), ("s", 2, 1, A, U), ("s", 20, 0, B, V), ("t", 0, 0, B, V), ("t", 1, 0, None, None)]
    frames = spark.createDataFrame([("s", f) for f in range(21)] + [("t", 0), ("t", 1)], "scene_id string, frame_idx int")
    got = {(r.scene_id, r.frame_idx, r.det_idx): (r.object_id, r.is_match) for r in tracking.track(boxes(spark, rows), frames).collect()}
    assert got == {("s", 0, 0): (0, 0), ("s", 0, 1): (1, 0), ("s", 1, 0): (0, 1), ("s", 2, 0): (0, 1), ("s", 2, 1): (0, 1), ("s", 20, 0): (2, 0), ("t", 0, 0): (0, 0), ("t", 1, 0): (1, 0)}
    one = tracking.track(boxes(spark, rows), frames, tracking.TrackerConfig(one_to_one=True)).where("scene_id = 's' AND frame_idx = 2").collect()
    assert sorted(r.object_id for r in one) == [0, 2]
    seq = tracking.track(boxes(spark, [("s", 0, 0, A, U), ("s", 0, 1, A, U)]), None, tracking.TrackerConfig(matching="sequential")).collect()
    assert [r.object_id for r in seq] == [0, 0]


def test_misses_and_status(spark):
    rows = [("s", f, 0, A, U) for f in (0, 1, 2)] + [("s", f, 1, B, V) for f in (0, 11, 12)]
    o = boxes(spark, rows).withColumn("object_id", F.col("det_idx").cast("long"))
    frames = spark.createDataFrame([("s", f) for f in range(13)], "scene_id string, frame_idx int")
    found = tracking.status_intervals(o, frames)
    got = {tuple(r)[1:] for r in found.collect()}
    assert got == {
        *((0, f, "active", f, f) for f in (0, 1, 2)), (0, 2, "missing", 3, 11), (0, 2, "inactive", 12, 12),
        *((1, f, "active", f, f) for f in (0, 11, 12)), (1, 0, "missing", 1, 9), (1, 0, "inactive", 10, 10),
    }
    assert {r.object_id: r.status for r in tracking.status_at(found, 10).collect()} == {0: "missing", 1: "inactive"}
    assert {r.object_id: r.status for r in tracking.summarise(o, frames).collect()} == {0: "inactive", 1: "active"}


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [("s" if k % 2 else "t", f, k, tuple(float(x) for x in (k * 20 + rng.random(), 0, k * 20 + 10, 10)), None) for f in range(8) for k in range(4) if rng.random() < 0.8]
    df = boxes(spark, rows)
    config = tracking.TrackerConfig(threshold=0.2, spatial_weight=1.0)
    batch = {tuple(r)[:5] for r in tracking.track(df, None, config).collect()}
    for part, (low, high) in enumerate(((0, 4), (4, 8))):
        df.where((F.col("frame_idx") >= low) & (F.col("frame_idx") < high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/p{part}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = track_stream(stream, config).writeStream.format("memory").queryName("observed").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r)[:5] for r in spark.table("observed").collect()}
    assert got <= batch and {r for r in batch if r[1] < 6} <= got


def test_graph(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "object_id long")
    edges = [(0, 1, 0.5), (1, 2, 0.25), (0, 2, 0.75), (3, 4, 1.0), (4, 5, 0.5), (3, 5, 0.5), (6, 6, 1.0)]
    rel = spark.createDataFrame([(a, b, "near", w) for a, b, w in edges] + [(1, 0, "on", 0.25), (7, 9, "on", 1.0)], "object_a_id long, object_b_id long, relation_type string, confidence double")
    w = graph.weights(rel, nodes)
    assert {(r.a_id, r.b_id): r.weight for r in w.collect()}[(0, 1)] == 0.75
    parts = graph.connected_components(nodes, w)
    assert {r.object_id: r.component_id for r in parts.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7}
    forest = graph.spanning_forest(nodes, w)
    assert forest.count() == 4 and forest.agg(F.sum("weight")).first()[0] == pytest.approx(0.25 + 0.75 + 0.5 + 0.5)
    most = graph.spanning_forest(nodes, w, "max").agg(F.sum("weight")).first()[0]
    assert most == pytest.approx(0.75 + 0.75 + 1.0 + 0.5)
    by_scene = graph.scene_forests(nodes, w.withColumn("scene_id", F.lit(1)))
    assert by_scene.agg(F.sum("weight")).first()[0] == pytest.approx(2.0)
    assert {r.object_id for r in graph.neighbours(rel, 0).collect()} == {1, 2}
    empty = graph.spanning_forest(nodes, w.where("false"))
    assert empty.count() == 0 and graph.connected_components(nodes.where("false"), w.where("false")).count() == 0


def test_labels(spark):
    rows = [(1, 0, 0, "a red chair"), (1, 1, 0, "a wooden red chair by the big window"), (1, 2, 0, "table"), (2, 0, 0, "Lamp  on desk"), (3, 0, 0, "abc"), (3, 0, 1, "xyz")]
    c = spark.createDataFrame(rows, "object_id long, frame_idx int, seq int, caption string")
    assert {r.object_id: r.label for r in captions.short_labels(c).collect()} == {1: "a wooden red chair by", 2: "Lamp  on desk", 3: "abc"}
    full = {r.object_id: r for r in captions.full_labels(c, spark.createDataFrame([(1,), (9,)], "object_id long")).collect()}
    assert full[1].label.startswith("a wooden") and full[1].semantic_confidence == pytest.approx(1.0) and full[9].label == "object_9" and full[9].semantic_confidence == 0
    assert [r.seq for r in captions.capped(c, 1).where("object_id = 3").collect()] == [0]


def test_ema(spark):
    e = [np.array([1.0, 0.0]), np.array([0.0, 1.0]), np.array([1.0, 1.0]) / 2**0.5]
    rows = [("s", 1, i, 0, [float(v) for v in x]) for i, x in enumerate(e)]
    df = spark.createDataFrame(rows, "scene_id string, object_id long, frame_idx int, det_idx int, embedding array<double>")
    want = e[0]
    for x in e[1:]:
        want = 0.7 * x + 0.3 * want
        want /= np.linalg.norm(want)
    assert tracking.ema_embeddings(df).first().embedding == pytest.approx(want.tolist())


def test_tsdf_plane(spark):
    rows = [(0, y, x, 1.0) for y in range(20) for x in range(20)]
    depth = spark.createDataFrame(rows, "frame_idx int, row int, col int, z double")
    pose = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0]
    frames = spark.createDataFrame([(0, 20.0, 20.0, 9.5, 9.5, [float(x) for x in pose])], "frame_idx int, fx double, fy double, cx double, cy double, pose array<double>")
    field = tsdf.integrate(depth, frames, 0.05, 0.2, 10.0, 20, 20)
    assert all(abs(r.sdf) <= 1 for r in field.collect())
    z = [r.z for r in tsdf.surface_points(field, 0.05).collect()]
    assert z and all(abs(v - 1) < 0.03 for v in z)
    assert tsdf.merge(field, field).agg(F.max("weight")).first()[0] == 2 * field.agg(F.max("weight")).first()[0]


def test_tsdf_against_brute_force_in_any_order(spark):
    rng = np.random.default_rng(11)
    turn = 0.4
    poses = [[np.cos(turn * k), -np.sin(turn * k), 0, 0.1 * k, np.sin(turn * k), np.cos(turn * k), 0, -0.2, 0, 0, 1, 0.337, 0, 0, 0, 1] for k in range(3)]
    frames = spark.createDataFrame([(k, 20.0, 18.0, 4.5, 5.5, [float(x) for x in p]) for k, p in enumerate(poses)], "frame_idx long, fx double, fy double, cx double, cy double, pose array<double>")
    rows = [(k, int(rng.integers(0, 2)), r, c, float(rng.choice([0.0, 0.9, 1.0, 1.3, 11.0])), float(rng.random()) if rng.random() < 0.8 else None) for k in range(4) for r in range(12) for c in range(10)]
    depth = spark.createDataFrame(rows, "frame_idx long, det_idx int, row int, col int, z double, r double")
    voxel, cut, want = 0.1, 0.25, {}
    for k, pose in enumerate(poses):
        for det in (0, 1):
            own = {(r, c): (z, red) for f, d, r, c, z, red in rows if f == k and d == det and 0 < z < 10}
            m = np.array(pose).reshape(4, 4)
            cells = {tuple(np.floor((m @ [(c - 4.5) * z / 20, (r - 5.5) * z / 18, z, 1])[:3] / voxel).astype(int)) for (r, c), (z, _) in own.items()}
            around = {(x + i, y + j, w + h) for x, y, w in cells for i in range(-3, 4) for j in range(-3, 4) for h in range(-3, 4)}
            for v in around:
                q = np.linalg.inv(m) @ [*((np.array(v) + 0.5) * voxel), 1]
                if q[2] > 0:
                    at = (int(np.floor(q[1] * 18 / q[2] + 5.5 + 0.5)), int(np.floor(q[0] * 20 / q[2] + 4.5 + 0.5)))
                    if at in own and own[at][0] - q[2] >= -cut:
                        want.setdefault((det, *v), []).append((min(1, (own[at][0] - q[2]) / cut), own[at][1]))
    field = tsdf.integrate(depth, frames, voxel, cut, 10.0, 12, 10, ("det_idx",))
    got = {(x.det_idx, x.vx, x.vy, x.vz): x for x in field.collect()}
    assert got.keys() == want.keys()
    for key, values in want.items():
        reds = [x for _, x in values if x is not None]
        assert got[key].weight == len(values) and got[key].sdf == pytest.approx(np.mean([x for x, _ in values]), abs=1e-9)
        assert got[key].r == (pytest.approx(np.mean(reds)) if reds else None)
    # candidates were rows that were shuffled before, and sums depended on the order of rows
    assert "Generate" not in field._jdf.queryExecution().executedPlan().toString()
    again = tsdf.integrate(depth.orderBy(F.desc("z"), "row").coalesce(1), frames, voxel, cut, 10.0, 12, 10, ("det_idx",)).collect()
    assert {(x.det_idx, x.vx, x.vy, x.vz): x.sdf for x in again} == {k: x.sdf for k, x in got.items()}


def test_surface_reads_the_field_once(spark):
    values = {(x, y, z): float(np.sin(3 * x + y) + np.cos(2 * z - x)) for x in range(4) for y in range(4) for z in range(4) if (x, y, z) != (1, 1, 1)}
    field = spark.createDataFrame([(*v, s) for v, s in values.items()], "vx int, vy int, vz int, sdf double")
    want = []
    for v, s in values.items():
        for axis in range(3):
            ahead = tuple(x + int(i == axis) for i, x in enumerate(v))
            if ahead in values and (s > 0) != (values[ahead] > 0):
                want.append(tuple((x + 0.5 + (s / (s - values[ahead]) if i == axis else 0)) * 0.5 for i, x in enumerate(v)))
    found = tsdf.surface_points(field, 0.5)
    assert sorted((p.x, p.y, p.z) for p in found.collect()) == [pytest.approx(p) for p in sorted(want)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + found._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 1


def test_graph_document_is_made_of_elements(spark, tmp_path):
    v = Views(spark, "/root/testdata/sf0.001")
    objects = v.objects.where("object_id < 40")
    relations = edges_of(v).where("object_a_id < 40 AND object_b_id < 40 AND relation_type = 'on'")
    parts = graph.connected_components(objects, relations.selectExpr("object_a_id AS a_id", "object_b_id AS b_id"))
    rows = scenes.graph_document(objects, relations, parts)
    n, m, k = objects.count(), relations.count(), parts.select("component_id").distinct().count()
    # all was one row before
    assert {r.section: r["count"] for r in rows.groupBy("section").count().collect()} == {"metadata": 1, "objects": n, "relations": m, "components": k}
    for asked in (True, False):
        scenes.write_graph(objects, relations, parts, f"{tmp_path}/{asked}", asked)
        (file,) = (tmp_path / str(asked)).glob("part-*")
        doc = json.loads(file.read_text())
        assert [doc[c] for c in ("num_nodes", "num_edges", "num_components")] == [n, m, k] and ("objects" in doc) == asked
        pairs = [(r["object_a_id"], r["object_b_id"]) for r in doc["relations"]]
        assert len(pairs) == m and pairs == sorted(pairs)
        assert sorted(i for c in doc["components"] for i in c["object_ids"]) == sorted(r.object_id for r in objects.collect())
        if asked:
            assert [o["object_id"] for o in doc["objects"]] == sorted(r.object_id for r in objects.collect()) and len(doc["objects"][0]["bounding_box_3d_corners"]) == 8
    scenes.write_graph(objects.where("false"), relations.where("false"), parts.where("false"), f"{tmp_path}/none")
    (file,) = (tmp_path / "none").glob("part-*")
    assert json.loads(file.read_text()) == {"num_nodes": 0, "num_edges": 0, "num_components": 0, "relations": [], "components": [], "objects": []}


def test_rgbd_source(spark, tmp_path):
    results = tmp_path / "results"
    results.mkdir()
    for k in (0, 2, 10, 1):
        (results / f"frame{k:06d}.jpg").write_bytes(b"x")
        (results / f"depth{k:06d}.png").write_bytes(png.encode16(np.full((4, 6), 655 * (k + 1), dtype=np.uint16)))
    (tmp_path / "traj.txt").write_text("\n".join(" ".join(str(float(k + i)) for i in range(16)) for k in range(5)) + "\n")
    config = rgbd.SceneConfig(path=str(tmp_path), start=1, stride=2, height=2, width=3, camera=rgbd.Camera(height=4, width=6, fx=10, fy=20, cx=3, cy=2))
    got = rgbd.frames(spark, config).orderBy("frame_idx").collect()
    assert [r.color_path[-10:] for r in got] == ["000001.jpg", "000010.jpg"] and [r.frame_idx for r in got] == [0, 1]
    assert (got[0].fx, got[0].cy, got[0].pose[0]) == (5.0, 1.0, 1.0)
    z = rgbd.depth_pixels(rgbd.frames(spark, config), 6553.5).where("frame_idx = 1").collect()
    assert len(z) == 6 and all(r.z == pytest.approx(11 * 655 / 6553.5) for r in z)
    with pytest.raises(ValueError):
        rgbd.frames(spark, rgbd.SceneConfig(kind="other"))
    (tmp_path / "traj.txt").write_text("1 2 3\n" * 4)
    with pytest.raises(Exception, match="sixteen"):
        rgbd.poses(spark, str(tmp_path / "traj.txt")).collect()


def test_png_filters():
    import struct
    import zlib

    rng = np.random.default_rng(0)
    want = rng.integers(0, 65535, (5, 4)).astype(np.uint16)
    assert (png.decode(png.encode16(want)) == want).all()
    raw = want.astype(">u2").view(np.uint8).reshape(5, 8).astype(int)
    lines = []
    for y, kind in enumerate((0, 1, 2, 3, 4)):
        line = []
        for i in range(8):
            left, up, corner = (raw[y, i - 2] if i > 1 else 0), (raw[y - 1, i] if y else 0), (raw[y - 1, i - 2] if y and i > 1 else 0)
            p = left + up - corner
            paeth = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
            line.append((raw[y, i] - (0, left, up, (left + up) // 2, paeth)[kind]) & 255)
        lines.append(bytes([kind, *line]))
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    made = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert (png.decode(made) == want).all()


def test_documents_round_trip(spark, tmp_path):
    rows = [(1, "cup", "active", 0, 5, 3, 200, 0.5, (1.0, 2.0, 3.0, 0.5, 0.5, 0.5)), (2, None, "missing", 1, 2, 2, 100, 0.1, None), (3, "x", "active", 0, 1, 1, 500, 0.9, None)]
    df = spark.createDataFrame(rows, "object_id long, label string, status string, first_seen_frame int, last_seen_frame int, num_observations int, num_points long, confidence double, bbox STRUCT<cx: DOUBLE, cy: DOUBLE, cz: DOUBLE, w: DOUBLE, h: DOUBLE, d: DOUBLE>")
    assert scenes.write_objects(df, f"{tmp_path}/o") == 2
    back = {r.object_id: r for r in scenes.read_objects(spark, f"{tmp_path}/o").collect()}
    assert set(back) == {1, 2} and back[1].bbox.cz == 3.0 and back[2].bbox is None and back[2].label is None and len(back[1].bounding_box_3d_corners) == 8
    points = spark.createDataFrame([(7, 1.0, 2.0, 3.0), (7, 4.0, 5.0, 6.0)], "object_id long, x double, y double, z double")
    file = scenes.to_npy(points).first()
    (tmp_path / file["name"]).write_bytes(file.content)
    assert [(r.x, r.z) for r in scenes.read_npy(spark, str(tmp_path)).orderBy("index").collect()] == [(1.0, 3.0), (4.0, 6.0)]


def test_methods(spark):
    df = spark.createDataFrame([(1,)], "object_id long")
    with pytest.raises(ValueError):
        relate(df, "other")
    with pytest.raises(ValueError):
        relate(df, "geometric")


def test_mesh_of_a_plane(spark):
    rows = [(x, y, z, (z - 3.25) / 4.0, 1.0) for x in range(6) for y in range(6) for z in range(7)]
    field = spark.createDataFrame(rows, "vx int, vy int, vz int, sdf double, weight double")
    found = tsdf.mesh_statistics(tsdf.mesh(field, 0.5)).first()
    assert found.area == pytest.approx((5 * 0.5) ** 2) and found.box_volume == pytest.approx(0)
    ball = [(x, y, z, ((x - 8) ** 2 + (y - 8) ** 2 + (z - 8) ** 2) ** 0.5 - 6.3, 1.0) for x in range(17) for y in range(17) for z in range(17)]
    area = tsdf.mesh_statistics(tsdf.mesh(spark.createDataFrame(ball, field.schema), 1.0)).first().area
    assert area == pytest.approx(4 * np.pi * 6.3**2, rel=0.05)


def test_tsdf_field_takes_all_depth(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    near = v.depth.where("z < 2").select("frame_idx", "row", "col").distinct().count()
    assert near < v.depth.where("z > 0 AND z < 10").count()
    far = tracking_queries.tsdf_field(v).agg(F.max("vz")).first()[0]
    assert far * 0.2 > 4


def test_tracker_reads_all_embeddings(spark):
    v = Views(spark, "/root/testdata/sf0.01")
    n = v.table("embeddings").count()
    rows = tracking_queries.embedded(v)
    assert rows.count() == v.detections.count() and rows.where("embedding IS NULL").isEmpty()
    users = v.detections.select((F.col("object_id") % n).alias("u")).distinct().count()
    assert rows.select("embedding").distinct().count() == users


def test_tracker_against_a_plain_one():
    """The array form of a frame against loops over pairs, by both kinds of matching."""
    rng = np.random.default_rng(5)

    def alike(track, box, feature, config):
        overlap = 0.0
        if track["box"] is not None and box is not None:
            a, b = track["box"], box
            shared = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
            whole = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
            overlap = shared / whole if whole else 0.0
        dot = sum(x * y for x, y in zip(track["feature"], feature)) if track["feature"] is not None and feature is not None else 0.0
        return config.spatial_weight * overlap + config.feature_weight * dot

    for matching, single in (("snapshot", False), ("snapshot", True), ("sequential", False), ("sequential", True)):
        config = tracking.TrackerConfig(matching=matching, one_to_one=single, max_missing_frames=3, threshold=0.4)
        scene, plain, next_id = tracking.Scene(), [], 0
        for _ in range(30):
            frame = []
            for _ in range(rng.integers(0, 6)):
                x, y, f = rng.integers(0, 12), rng.integers(0, 12), rng.normal(size=3)
                frame.append((None if rng.random() < 0.1 else [float(x), float(y), x + 6.0, y + 5.0], None if rng.random() < 0.1 else (f / np.linalg.norm(f)).tolist()))
            got = tracking.step(scene, frame, config)
            old = [dict(t) for t in plain]
            taken, want = set(), []
            for box, feature in frame:
                pool = old if matching == "snapshot" else plain
                best, at = -np.inf, None
                for t in pool:
                    if not (single and t["id"] in taken) and (s := alike(t, box, feature, config)) > best:
                        best, at = s, t["id"]
                if at is None or best < config.threshold:
                    plain.append({"id": next_id, "box": box, "feature": feature, "misses": 0})
                    at, next_id, matched = next_id, next_id + 1, 0
                else:
                    matched = 1
                    t = next(t for t in plain if t["id"] == at)
                    t["box"] = box if box is not None else t["box"]
                    if feature is not None and t["feature"] is not None:
                        mixed = [0.7 * x + 0.3 * y for x, y in zip(feature, t["feature"])]
                        size = sum(x * x for x in mixed) ** 0.5
                        t["feature"] = [x / size for x in mixed]
                    elif feature is not None:
                        t["feature"] = feature
                taken.add(at)
                want.append((at, matched))
            for t in plain:
                t["misses"] = 0 if t["id"] in taken else t["misses"] + 1
            plain = [t for t in plain if t["misses"] < 3]
            assert [g[:2] for g in got] == want


def test_meshes_of_objects_and_normals_of_vertices(spark):
    def ball(x, y, z, r):
        return ((x - 6) ** 2 + (y - 6) ** 2 + (z - 6) ** 2) ** 0.5 - r

    grid = [(x, y, z) for x in range(13) for y in range(13) for z in range(13)]
    schema = "object_id long, vx int, vy int, vz int, sdf double, weight double"
    field = spark.createDataFrame([(k, *c, ball(*c, r), 1.0) for k, r in ((1, 4.3), (2, 2.6)) for c in grid], schema)
    both = tsdf.mesh(field, 1.0, ("object_id",))
    found = {r.object_id: r for r in tsdf.mesh_statistics(both, ("object_id",)).collect()}
    for k in (1, 2):
        alone = tsdf.mesh_statistics(tsdf.mesh(field.where(f"object_id = {k}"), 1.0)).first()
        assert found[k].num_triangles == alone.num_triangles and found[k].area == pytest.approx(alone.area)
    normals = tsdf.vertex_normals(both, ("object_id",)).where("object_id = 1").collect()
    assert normals
    for r in normals:
        out = np.array([r.x, r.y, r.z]) - 6.5
        n = np.array([r.nx, r.ny, r.nz])
        assert np.linalg.norm(n) == pytest.approx(1)
        side = np.sort(np.abs(out / np.linalg.norm(out)))
        if side[2] - side[1] > 0.2:  # elsewhere triangles of one vertex may turn apart
            assert abs(n @ out) / np.linalg.norm(out) > 0.9
    assert tsdf.vertex_normals(both.where("false"), ("object_id",)).count() == 0


def test_dense_and_null_weights(spark):
    rows = [(1, float(k), 0.0, 0.0, k) for k in range(5)] + [(2, 0.0, 0.0, 0.0, None), (None, 1.0, 1.0, 1.0, 7)]
    df = spark.createDataFrame(rows, "object_id long, x double, y double, z double, n int")
    got = clouds.dense(df, 0.5).collect()
    assert sorted((r.object_id or 0, r.n) for r in got) == [(0, 7), (1, 2), (1, 3), (1, 4)]


def test_crops_captions_and_prompts(spark):
    from lodestrata.operators import providers

    class Sizes:
        def caption(self, crops):
            assert len(crops) <= 2
            return [f"{len(c)} bytes" if len(c) > 12 else None for c in crops]

        def segment(self, image, boxes, points):
            if boxes is None:
                return np.zeros((0, 2, 2)), np.zeros((0, 4)), np.zeros(0)
            return np.ones((len(boxes), 2, 2)), np.array(boxes), np.full(len(boxes), len(points or []) / 10)

    providers.register("sizes")(Sizes)
    pixels = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)
    image = "image STRUCT<origin: STRING, height: INT, width: INT, nChannels: INT, mode: INT, data: BINARY>"
    images = spark.createDataFrame([(0, ("a", 5, 7, 3, 16, pixels.tobytes()))], f"frame_idx int, {image}")
    boxes = [(0, 0, (2.0, 1.0, 4.0, 3.0)), (0, 1, (-3.0, -3.0, 1.5, 1.0)), (0, 2, (9.0, 9.0, 9.0, 9.0)), (0, 3, None), (1, 0, (0.0, 0.0, 2.0, 2.0))]
    detections = spark.createDataFrame(boxes, "frame_idx int, det_idx int, bbox STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>")
    made = providers.crops(detections, images, 0.5)
    got = {(r.frame_idx, r.det_idx): r for r in made.collect()}
    assert len(got) == 5 and bytes(got[0, 0].crop) == pixels[0:3, 1:4].tobytes() and (got[0, 0].crop_height, got[0, 0].crop_width) == (3, 3)
    assert bytes(got[0, 1].crop) == pixels[0:1, 0:2].tobytes()
    assert all(got[k].crop is None for k in ((0, 2), (0, 3), (1, 0)))
    said = {(r.frame_idx, r.det_idx): r.caption for r in providers.caption(made, "sizes", batch_size=2).collect()}
    assert said == {(0, 0): "27 bytes", (0, 1): None, (0, 2): None, (0, 3): None, (1, 0): None}
    vectors = providers.embed(made.where("crop IS NOT NULL"), "hashed-words", "crop", images=True, batch_size=1).collect()
    assert len(vectors) == 2 and len(vectors[0].embedding) == 64
    frames = spark.createDataFrame([(0, b"x", [[0.0, 0.0, 2.0, 2.0]], [[1.0, 1.0]]), (1, b"y", None, None)], "frame_idx int, color binary, boxes array<array<double>>, points array<array<double>>")
    found = providers.segment(frames, "sizes", min_area=1).collect()
    assert [(r.frame_idx, r.x2, r.score, r.area) for r in found] == [(0, 2.0, 0.1, 4)]
    with pytest.raises(ValueError):
        providers.caption(made, "unknown")


def test_arrays_of_objects(spark, tmp_path):
    rows = [(1, [0.5, 1.0], 0.1, 0.2, 0.3), (1, [2.0, 3.0], 0.4, 0.5, 0.6), (2, None, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "object_id long, embedding array<double>, r double, g double, b double")
    files = {kind: scenes.to_npy(df, kind, str(tmp_path)) for kind in ("features", "colors")}
    got = {r.object_id: r for r in scenes.with_arrays(df.select("object_id").distinct(), files).collect()}
    assert got[1].features_shape == [2, 2] and got[1].colors_shape == [2, 3] and got[1].colors_path.endswith("obj_001_colors.npy") and got[2].features_path is None
    file = files["features"].first()
    (tmp_path / file["name"]).write_bytes(file.content)
    assert [(r.a, r.b) for r in scenes.read_npy(spark, str(tmp_path), ("a", "b")).orderBy("index").collect()] == [(0.5, 1.0), (2.0, 3.0)]
    back = scenes.from_dicts(scenes.to_dicts(df), "object_id long, r double, other string").orderBy("object_id", "r").collect()
    assert [(r.object_id, r.r, r.other) for r in back] == [(1, 0.1, None), (1, 0.4, None), (2, None, None)]


def test_colour_pixels(spark):
    pixels = np.random.default_rng(3).integers(0, 255, (4, 6, 3)).astype(np.uint8)
    image = "image STRUCT<origin: STRING, height: INT, width: INT, nChannels: INT, mode: INT, data: BINARY>"
    images = spark.createDataFrame([(0, ("a", 4, 6, 3, 16, pixels.tobytes())), (1, ("b", 4, 6, 1, 0, pixels[:, :, 0].tobytes()))], f"frame_idx int, {image}")
    same = spark.createDataFrame([(0, 4, 6), (1, 2, 3)], "frame_idx int, height int, width int")
    got = rgbd.color_pixels(same, images).collect()
    whole = {(r.row, r.col): r for r in got if r.frame_idx == 0}
    assert len(whole) == 24 and all(whole[y, x].b == pytest.approx(pixels[y, x, 0] / 255) and whole[y, x].r == pytest.approx(pixels[y, x, 2] / 255) for y in range(4) for x in range(6))
    half = [r for r in got if r.frame_idx == 1]
    assert len(half) == 6 and half[0].r == half[0].g == pytest.approx(pixels[:2, :2, 0].mean() / 255)
