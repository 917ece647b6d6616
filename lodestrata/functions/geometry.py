"""Column expressions on boxes, points, poses and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; null if either side is."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalised(a: Column) -> Column:
    """``a`` scaled to length 1; a zero vector stays."""
    size = norm(a)
    return F.transform(a, lambda x: F.when(size > 0, x / size).otherwise(x.cast("double")))


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes {x1, y1, x2, y2}; 0 where the union has no area."""
    width = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    height = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    shared = width * height
    whole = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - shared
    return F.coalesce(F.try_divide(shared, whole), F.lit(0.0))


def _side(box: Column, axis: int, sign: int) -> Column:
    centre, size = (("cx", "w"), ("cy", "h"), ("cz", "d"))[axis]
    return box[centre] + sign * box[size] / 2


def _overlap(a: Column, b: Column, axis: int) -> Column:
    """Length shared on an axis; negative where they are apart."""
    return F.least(_side(a, axis, 1), _side(b, axis, 1)) - F.greatest(_side(a, axis, -1), _side(b, axis, -1))


def on_confidence(a: Column, b: Column, tolerance: float = 0.05, ratio: float = 0.3) -> Column:
    """How surely a lies on b, or null: a's bottom near b's top and enough of a above b."""
    gap = F.abs(_side(a, 2, -1) - _side(b, 2, 1))
    x, y = _overlap(a, b, 0), _overlap(a, b, 1)
    share = F.coalesce(F.try_divide(x * y, a["w"] * a["h"]), F.lit(0.0))
    holds = (gap <= tolerance) & (x > 0) & (y > 0) & (share >= ratio)
    return F.when(holds, (1 - F.least(gap / tolerance, F.lit(1.0)) + F.least(share / ratio, F.lit(1.0))) / 2)


def in_confidence(a: Column, b: Column, ratio: float = 0.8) -> Column:
    """1 where a lies within b; else the share of a's volume in b if it is enough; else null."""
    within = None
    for axis in range(3):
        here = (_side(a, axis, -1) >= _side(b, axis, -1)) & (_side(a, axis, 1) <= _side(b, axis, 1))
        within = here if within is None else within & here
    x, y, z = (_overlap(a, b, k) for k in range(3))
    share = F.coalesce(F.try_divide(x * y * z, a["w"] * a["h"] * a["d"]), F.lit(0.0))
    return F.when(within, 1.0).when((x > 0) & (y > 0) & (z > 0) & (share >= ratio), share)


def centre_distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["cx"] - b["cx"]) ** 2 + (a["cy"] - b["cy"]) ** 2 + (a["cz"] - b["cz"]) ** 2)


def near_confidence(a: Column, b: Column, distance: float = 0.5) -> Column:
    """1 at the same centre, falling to 0 at ``distance``, null beyond."""
    apart = centre_distance(a, b)
    return F.when(apart <= distance, 1 - apart / distance)


def direction(a: Column, b: Column, least: float = 0.3) -> Column:
    """{relation, confidence} of a seen from b along the axis of the largest offset, or null.

    Of equal offsets the first axis counts; an offset below ``least`` is no direction.
    """
    x, y, z = a["cx"] - b["cx"], a["cy"] - b["cy"], a["cz"] - b["cz"]
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    most = F.greatest(ax, ay, az)
    name = (
        F.when(ax == most, F.when(x > 0, "right_of").otherwise("left_of"))
        .when(ay == most, F.when(y > 0, "front_of").otherwise("behind"))
        .otherwise(F.when(z > 0, "above").otherwise("below"))
    )
    return F.when(most >= least, F.struct(name.alias("relation"), F.least(most / least, F.lit(1.0)).alias("confidence")))


def xy_iou(a: Column, b: Column) -> Column:
    """Intersection over union of the boxes' footprints; 0 without area."""
    shared = F.greatest(F.lit(0.0), _overlap(a, b, 0)) * F.greatest(F.lit(0.0), _overlap(a, b, 1))
    return F.coalesce(F.try_divide(shared, a["w"] * a["h"] + b["w"] * b["h"] - shared), F.lit(0.0))


def contained(a: Column, b: Column, slack: float = 0.05) -> Column:
    holds = None
    for axis in range(3):
        here = (_side(a, axis, -1) >= _side(b, axis, -1) - slack) & (_side(a, axis, 1) <= _side(b, axis, 1) + slack)
        holds = here if holds is None else holds & here
    return holds


def containment_ratio(a: Column, b: Column) -> Column:
    """The share of a's volume inside b; 0 without volume."""
    shared = None
    for axis in range(3):
        here = F.greatest(F.lit(0.0), _overlap(a, b, axis))
        shared = here if shared is None else shared * here
    volume = a["w"] * a["h"] * a["d"]
    return F.when(volume > 0, shared / volume).otherwise(0.0)


def corners(box: Column) -> Column:
    """The eight corners [x, y, z]: bottom ring from the least corner on, then the top ring."""
    ring = ((-1, -1), (1, -1), (1, 1), (-1, 1))
    return F.array(*[F.array(_side(box, 0, x), _side(box, 1, y), _side(box, 2, z)) for z in (-1, 1) for x, y in ring])


def backproject(u: Column, v: Column, z: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """The camera-space point {x, y, z} of a pixel (column u, row v) at depth z."""
    return F.struct(((u - cx) * z / fx).alias("x"), ((v - cy) * z / fy).alias("y"), z.cast("double").alias("z"))


def transform(p: Column, pose: Column) -> Column:
    """{x, y, z} after a rigid transform given as 16 row-major numbers."""
    rows = [pose[4 * r] * p["x"] + pose[4 * r + 1] * p["y"] + pose[4 * r + 2] * p["z"] + pose[4 * r + 3] for r in range(3)]
    return F.struct(*[c.alias(n) for c, n in zip(rows, "xyz", strict=True)])


def inverse_pose(pose: Column) -> Column:
    """The inverse of a rigid transform: transposed rotation, turned-back translation."""
    r = [[pose[4 * i + j] for j in range(3)] for i in range(3)]
    t = [pose[4 * i + 3] for i in range(3)]
    out = []
    for i in range(3):
        out += [r[j][i] for j in range(3)] + [-(r[0][i] * t[0] + r[1][i] * t[1] + r[2][i] * t[2])]
    return F.array(*out, *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])


def quaternion(pose: Column) -> Column:
    """{x, y, z, w} of a pose's rotation, from the largest of the trace and the diagonal."""
    m = [[pose[4 * i + j] for j in range(3)] for i in range(3)]
    trace = m[0][0] + m[1][1] + m[2][2]

    def made(x: Column, y: Column, z: Column, w: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"), z.alias("z"), w.alias("w"))

    def largest(i: int) -> Column:
        """The case in which diagonal entry i dominates."""
        j, k = (i + 1) % 3, (i + 2) % 3
        root = 2 * F.sqrt(1 + m[i][i] - m[j][j] - m[k][k])
        part = {i: root / 4, j: (m[i][j] + m[j][i]) / root, k: (m[i][k] + m[k][i]) / root}
        return made(part[0], part[1], part[2], (m[k][j] - m[j][k]) / root)

    root = 2 * F.sqrt(trace + 1)
    whole = made((m[2][1] - m[1][2]) / root, (m[0][2] - m[2][0]) / root, (m[1][0] - m[0][1]) / root, root / 4)
    return F.when(trace > 0, whole).when((m[0][0] > m[1][1]) & (m[0][0] > m[2][2]), largest(0)).when(m[1][1] > m[2][2], largest(1)).otherwise(largest(2))


def crop_box(box: Column, padding: float, width: Column, height: Column, whole_pixels: bool = False) -> Column:
    """The box grown by ``padding`` and clipped to the image, cut to whole pixels if asked."""
    sides = {
        "x1": F.greatest(F.lit(0.0), box["x1"] - padding),
        "y1": F.greatest(F.lit(0.0), box["y1"] - padding),
        "x2": F.least(width.cast("double"), box["x2"] + padding),
        "y2": F.least(height.cast("double"), box["y2"] + padding),
    }
    return F.struct(*[(c.cast("int") if whole_pixels else c).alias(n) for n, c in sides.items()])


def scaled_intrinsics(k: Column, width: Column, height: Column, to_width: int | None, to_height: int | None) -> Column:
    """{fx, fy, cx, cy} after a resize of the image; unchanged unless both sides are given."""
    sx = to_width / width if to_width and to_height else F.lit(1.0)
    sy = to_height / height if to_width and to_height else F.lit(1.0)
    return F.struct((k["fx"] * sx).alias("fx"), (k["fy"] * sy).alias("fy"), (k["cx"] * sx).alias("cx"), (k["cy"] * sy).alias("cy"))


def colour_of(object_id: Column) -> Column:
    """A stable colour {r, g, b} in 0..1 from a hash of the id."""
    h = F.xxhash64(object_id)
    return F.struct(*[(F.pmod(F.shiftright(h, 16 * k), F.lit(1 << 16)) / 65535.0).alias(n) for k, n in enumerate("rgb")])
