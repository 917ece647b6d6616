import math

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import geometry as G
from lodestrata.functions import language as L
from lodestrata.operators.relations import decided

BOX = "STRUCT<cx: DOUBLE, cy: DOUBLE, cz: DOUBLE, w: DOUBLE, h: DOUBLE, d: DOUBLE>"


def floats(box):
    return tuple(float(x) for x in box)


def pair(spark, a, b, expression):
    df = spark.createDataFrame([(floats(a), floats(b))], f"a {BOX}, b {BOX}")
    return df.select(expression(F.col("a"), F.col("b")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "a, b, expected",
    [
        ((0, 0, 1.0, 1, 1, 1), (0, 0, 0, 1, 1, 1), 1.0),  # stands flat on it
        ((0, 0, 1.03125, 1, 1, 1), (0, 0, 0, 1, 1, 1), 0.6875),  # a gap of 0.03125
        ((0, 0, 1.1, 1, 1, 1), (0, 0, 0, 1, 1, 1), None),  # too high
        ((1, 0, 1.0, 1, 1, 1), (0, 0, 0, 1, 1, 1), None),  # edges touch only
        ((0.75, 0, 1.0, 1, 1, 1), (0, 0, 0, 1, 1, 1), None),  # a quarter above
    ],
)
def test_on(spark, a, b, expected):
    assert pair(spark, a, b, G.on_confidence) == pytest.approx(expected) if expected is not None else pair(spark, a, b, G.on_confidence) is None


def test_in(spark):
    assert pair(spark, (0, 0, 0, 1, 1, 1), (0, 0, 0, 1, 1, 1), G.in_confidence) == 1.0
    assert pair(spark, (0, 0, 0, 0, 0, 0), (0, 0, 0, 1, 1, 1), G.in_confidence) == 1.0
    assert pair(spark, (0.125, 0, 0, 1, 1, 1), (0, 0, 0, 1, 1, 1), G.in_confidence) == pytest.approx(0.875)
    assert pair(spark, (0.5, 0, 0, 1, 1, 1), (0, 0, 0, 1, 1, 1), G.in_confidence) is None


def test_near_and_direction(spark):
    at = lambda *c: (*c, 1, 1, 1)
    assert pair(spark, at(0.5, 0, 0), at(0, 0, 0), G.near_confidence) == 0.0
    assert pair(spark, at(0.51, 0, 0), at(0, 0, 0), G.near_confidence) is None
    assert pair(spark, at(1, 1, 0), at(0, 0, 0), G.direction).relation == "right_of"  # a tie goes to x
    assert pair(spark, at(0, -1, 0.5), at(0, 0, 0), G.direction).relation == "behind"
    assert pair(spark, at(0, 0, -0.5), at(0, 0, 0), G.direction).relation == "below"
    assert pair(spark, at(0.2, 0, 0), at(0, 0, 0), G.direction) is None


@pytest.mark.parametrize(
    "a, a_label, b, b_label, expected",
    [
        ((0, 0, 1, 1, 1, 1), "Red Cup", (0, 0, 0, 1, 1, 1), "table", ("on", 0.9)),
        ((0, 0, 0, 0.5, 0.5, 0.5), "pen", (0, 0, 0, 1, 1, 1), "box", ("in", 0.9)),
        ((0, 0, 1, 1, 1, 1), "wall", (0, 0, 0, 1, 1, 1), "wall", ("above", 0.8)),
        ((0, 0, -1, 1, 1, 1), "wall", (0, 0, 0, 1, 1, 1), "wall", ("below", 0.8)),
        ((0.25, 0, 0, 1, 1, 1), None, (0, 0, 0, 1, 1, 1), None, ("near", 0.55)),
        ((0.75, 0, 0, 1, 1, 1), "a", (0, 0, 0, 1, 1, 1), "b", ("near", 0.35)),
        ((2, 0, 0, 1, 1, 1), "a", (0, 0, 0, 1, 1, 1), "b", ("right_of", 0.5)),
        ((-2, 1, 0, 1, 1, 1), "a", (0, 0, 0, 1, 1, 1), "b", ("left_of", 0.5)),
        ((1, 2, 0, 1, 1, 1), "a", (0, 0, 0, 1, 1, 1), "b", ("front_of", 0.5)),
        ((0, 0, 3, 1, 1, 1), "a", (2, 2, 0, 1, 1, 1), "b", ("behind", 0.5)),
    ],
)
def test_decision_list(spark, a, a_label, b, b_label, expected):
    df = spark.createDataFrame([(floats(a), floats(b), a_label, b_label)], f"a {BOX}, b {BOX}, al string, bl string")
    got = df.select(decided(F.col("a"), F.col("b"), F.col("al"), F.col("bl")).alias("r")).first().r
    assert (got.relation, pytest.approx(got.confidence)) == expected


def test_boxes_and_poses(spark):
    row = spark.range(1).select(
        G.box_iou(F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("x1", "y1", "x2", "y2"), (0, 0, 2, 2))]), F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("x1", "y1", "x2", "y2"), (1, 0, 3, 2))])).alias("iou"),
        G.box_iou(F.struct(*[F.lit(1.0).alias(n) for n in ("x1", "y1", "x2", "y2")]), F.struct(*[F.lit(1.0).alias(n) for n in ("x1", "y1", "x2", "y2")])).alias("none"),
    ).first()
    assert row.iou == pytest.approx(1 / 3) and row["none"] == 0
    t = 2.5
    pose = [math.cos(t), 0.0, math.sin(t), 3.0, 0.0, 1.0, 0.0, -1.0, -math.sin(t), 0.0, math.cos(t), 2.0, 0.0, 0.0, 0.0, 1.0]
    df = spark.createDataFrame([(pose,)], "pose array<double>")
    point = F.struct(F.lit(0.3).alias("x"), F.lit(-0.2).alias("y"), F.lit(1.5).alias("z"))
    got = df.select(G.quaternion(F.col("pose")).alias("q"), G.transform(G.transform(point, F.col("pose")), G.inverse_pose(F.col("pose"))).alias("p")).first()
    assert [got.q.x, got.q.y, got.q.z, got.q.w] == pytest.approx([0, math.sin(t / 2), 0, math.cos(t / 2)])
    assert [got.p.x, got.p.y, got.p.z] == pytest.approx([0.3, -0.2, 1.5])


def test_answers(spark):
    rows = [("on top of", "on"), ("On.", "on"), ("under", "below"), ("inside", "in"), ("in", "in"), ("next to", "near"), ("beside", "near"), ("above", "above"), ("left", "left_of"), ("none", "none"), ("", "none"), ("one", "none"), (None, "none")]
    df = spark.createDataFrame(rows, "answer string, expected string")
    assert df.where(L.parsed_answer(F.col("answer")) != F.col("expected")).collect() == []
