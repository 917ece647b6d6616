"""Truncated signed distance fields as keyed voxel rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CELL = ("vx", "vy", "vz")


def _whole(x: np.ndarray) -> np.ndarray:
    """Rounded to whole numbers, halves away from zero."""
    t = np.trunc(x)
    return t + np.copysign((np.abs(x - t) >= 0.5).astype(float), x)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values in order (np.unique hashes, which is slower for so many new values)."""
    x = np.sort(x, axis=None)
    return x[np.append(True, x[1:] != x[:-1])]


def _seen(camera: tuple, group: np.ndarray, row: np.ndarray, col: np.ndarray, z: np.ndarray, voxel: float, truncation: float, height: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the pixel, voxel as three columns, signed distance) of all voxels of one frame that
    take something; ``group`` parts its pixels into fields."""
    fx, fy, cx, cy, p = camera
    here = (col - cx) * z / fx, (row - cy) * z / fy, z
    cells = np.stack([np.floor((p[4 * k] * here[0] + p[4 * k + 1] * here[1] + p[4 * k + 2] * here[2] + p[4 * k + 3]) / voxel) for k in range(3)]).astype(np.int64)
    reach = int(-(-truncation // voxel))
    low = cells.min(axis=1) - reach
    bits = [int(n).bit_length() for n in cells.max(axis=1) + reach - low]
    shift = [bits[1] + bits[2], bits[2], 0]
    if int(group.max()).bit_length() + sum(bits) > 62:
        raise ValueError("the points of a frame are too far apart for the size of a voxel")
    code = group << sum(bits)
    for k in range(3):
        code = code | (cells[k] - low[k]) << shift[k]
    code = _distinct(code)
    for k in (2, 1, 0):
        code = _distinct(code[:, None] + (np.arange(-reach, reach + 1) << shift[k]))
    v = [(code >> shift[k] & (1 << bits[k]) - 1) + low[k] for k in range(3)]
    # the inverse of the pose: turned rotation, turned-back translation
    c = [(x + 0.5) * voxel for x in v]
    q = [p[j] * c[0] + p[4 + j] * c[1] + p[8 + j] * c[2] - (p[j] * p[3] + p[4 + j] * p[7] + p[8 + j] * p[11]) for j in range(3)]
    ahead = np.flatnonzero(q[2] > 0)
    own = q[2][ahead]
    at_col, at_row = _whole(q[0][ahead] * fx / own + cx), _whole(q[1][ahead] * fy / own + cy)
    inside = (at_col >= 0) & (at_col < width) & (at_row >= 0) & (at_row < height)
    ahead, own = ahead[inside], own[inside]
    asked = ((code[ahead] >> sum(bits)) * height + at_row[inside].astype(np.int64)) * width + at_col[inside].astype(np.int64)
    pixel = (group * height + row) * width + col
    pixel[(row < 0) | (row >= height) | (col < 0) | (col >= width)] = -1  # no voxel asks for these
    order = np.argsort(pixel, kind="stable")
    first = np.searchsorted(pixel[order], asked)
    times = np.searchsorted(pixel[order], asked, side="right") - first
    found = np.repeat(np.arange(len(asked)), times)
    place = order[np.arange(len(found)) - np.repeat(np.cumsum(times) - times, times) + first[found]]
    d = z[place] - own[found]
    near = d >= -truncation
    return place[near], np.stack([x[ahead[found[near]]] for x in v], axis=1), d[near]


#: Distances are added up in whole units, so that sums, and signs next to 0, are the same in any order.
_UNIT = 1 << 36
#: Rows of partial sums that a task holds before it adds up those of a voxel, and before it hands them on.
_HELD, _SUMS = 1 << 20, 1 << 19


def _partial(voxel: float, truncation: float, height: int, width: int, keys: tuple[str, ...], colours: list[str]):
    """Sums by key and voxel of rows of one frame after another, a frame's camera first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame, camera, held = None, None, []
        seen, rows, known = [], 0, pa.table({k: [] for k in keys})

        def of_frame() -> None:
            """The voxels of the frame that is complete."""
            nonlocal rows, known
            table = pa.Table.from_batches(held)
            column = {n: table.column(n).to_numpy().astype(t) for n, t in (("row", np.int64), ("col", np.int64), ("z", float))}
            group, base = np.zeros(len(table), dtype=np.int64), len(known)
            if keys:
                own = table.select(keys).append_column("_n", pa.array(np.arange(len(table)))).group_by(list(keys)).aggregate([("_n", "list")])
                lists = own.column("_n_list").combine_chunks()
                group[lists.flatten().to_numpy()] = np.repeat(np.arange(len(own)), np.diff(lists.offsets.to_numpy()))
                own = own.select(keys)
                known = pa.concat_tables([known, own]) if base else own
            place, cell, d = _seen(camera, group, column["row"], column["col"], column["z"], voxel, truncation, height, width)
            sums = [np.rint(np.minimum(1.0, d / truncation) * _UNIT).astype(np.int64), np.ones(len(d), dtype=np.int64)]
            for c in colours:
                value = table.column(c).cast(pa.float64()).combine_chunks()
                sums += [value.fill_null(0.0).to_numpy()[place], value.is_valid().to_numpy(zero_copy_only=False)[place].astype(float)]
            seen.append((group[place] + base, cell, *sums))
            rows += len(d)

        def added() -> None:
            """Sums of equal voxels as one row."""
            nonlocal seen, rows, known
            group, cell, *sums = (np.concatenate([x[k] for x in seen]) for k in range(len(seen[0])))
            if keys and len(known):
                # equal keys of several frames are one
                named = known.append_column("_n", pa.array(np.arange(len(known)))).group_by(list(keys)).aggregate([("_n", "list")])
                lists = named.column("_n_list").combine_chunks()
                one = np.zeros(len(known), dtype=np.int64)
                one[lists.flatten().to_numpy()] = np.repeat(np.arange(len(named)), np.diff(lists.offsets.to_numpy()))
                group, known = one[group], named.select(keys)
            if len(group):
                low = cell.min(axis=0)
                bits = [int(n).bit_length() for n in cell.max(axis=0) - low]
                if int(group.max()).bit_length() + sum(bits) > 62:
                    _, code = np.unique(np.column_stack([group, cell]), axis=0, return_inverse=True)
                else:
                    code = ((group << bits[0] | cell[:, 0] - low[0]) << bits[1] | cell[:, 1] - low[1]) << bits[2] | cell[:, 2] - low[2]
                order = np.argsort(code)
                start = np.flatnonzero(np.append(True, code[order][1:] != code[order][:-1]))
                sums = [np.add.reduceat(x[order], start) for x in sums]
                group, cell = group[order[start]], cell[order[start]]
            seen, rows = [(group, cell, *sums)], len(group)

        def given() -> pa.RecordBatch:
            group, cell, *sums = seen[0]
            columns = [known.column(k).combine_chunks().take(pa.array(group)) for k in keys] + [pa.array(cell[:, k].astype(np.int32)) for k in range(3)] + [pa.array(x) for x in sums]
            return pa.RecordBatch.from_arrays(columns, [*keys, *_CELL, *[f"s{k}" for k in range(len(sums))]])

        for got in batches:
            frames = got.column("frame_idx").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(frames[1:] != frames[:-1]) + 1).tolist(), len(got)]
            for at, end in zip(cuts, cuts[1:], strict=False):
                if at == end:
                    continue
                part = got.slice(at, end - at)
                if frames[at] != frame:
                    if held and camera is not None:
                        of_frame()
                    frame, camera, held = frames[at], None, []
                    if rows > _HELD:
                        added()
                        if rows > _SUMS:
                            yield given()
                            seen, rows, known = [], 0, pa.table({k: [] for k in keys})
                if part.column("pose")[0].is_valid:
                    if camera is not None or (len(part) > 1 and part.column("pose")[1].is_valid):
                        raise ValueError("a frame has more than one camera")
                    camera = tuple(float(part.column(c)[0].as_py()) for c in ("fx", "fy", "cx", "cy")) + (part.column("pose")[0].as_py(),)
                    part = part.slice(1)
                if len(part):
                    held.append(part)
        if held and camera is not None:
            of_frame()
        if seen:
            added()
            yield given()

    return run


def integrate(depth: DataFrame, frames: DataFrame, voxel: float = 0.01, truncation: float = 0.04, max_depth: float = 10.0, height: int = 680, width: int = 1200, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, vx, vy, vz, sdf, weight [, r, g, b]) from depth pixels and the frames' cameras and poses.

    ``keys`` are columns of ``depth`` (object_id, det_idx) that each get a field of their own.

    Candidates are the voxels around surface points within the truncation; each is projected into
    the frame that proposed it and takes depth minus its own distance, cut to the truncation.
    Voxels farther behind the surface than that take nothing. Means over frames; ``weight``
    counts them, so fields of separate batches merge by weighted means.

    A frame's pixels meet its camera in one task, which finds its candidates as sorted codes and
    hands on sums by voxel: candidates, many times the pixels, are never shuffled. They are in
    memory for one frame at a time.
    """
    colours = [c for c in ("r", "g", "b") if c in depth.columns]
    rows = depth.where((F.col("z") > 0) & (F.col("z") < max_depth)).dropna(subset=[*keys, "row", "col"]).select("frame_idx", *keys, "row", "col", F.col("z").cast("double").alias("z"), *colours)
    kinds = dict(rows.dtypes)
    cameras = frames.select(F.col("frame_idx").cast(kinds["frame_idx"]), *[F.lit(None).cast(kinds[c]).alias(c) for c in rows.columns[1:]], *[F.col(c).cast("double").alias(c) for c in ("fx", "fy", "cx", "cy")], F.col("pose").cast("array<double>"))
    both = rows.withColumns({c: F.lit(None).cast("double") for c in ("fx", "fy", "cx", "cy")} | {"pose": F.lit(None).cast("array<double>")}).unionByName(cameras).where("frame_idx IS NOT NULL")
    sorted_ = both.repartition("frame_idx").sortWithinPartitions("frame_idx", F.col("z").isNotNull())  # cameras first
    n = 2 + 2 * len(colours)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], *[f"{c} int" for c in _CELL], *[f"s{k} {'double' if k > 1 else 'long'}" for k in range(n)]])
    sums = sorted_.mapInArrow(_partial(voxel, truncation, height, width, keys, colours), schema)
    total = sums.groupBy(*keys, *_CELL).agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(n)])
    means = [F.try_divide(F.col(f"s{2 * k + 2}"), F.col(f"s{2 * k + 3}")).alias(c) for k, c in enumerate(colours)]
    return total.select(*keys, *_CELL, (F.col("s0") / F.lit(_UNIT) / F.col("s1")).alias("sdf"), F.col("s1").cast("double").alias("weight"), *means)


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two fields on the same grid as one, by weighted means."""
    means = [c for c in ("sdf", "r", "g", "b") if c in a.columns and c in b.columns]
    both = a.select(*_CELL, "weight", *means).unionByName(b.select(*_CELL, "weight", *means))
    return both.groupBy(*_CELL).agg(*[(F.sum(F.col(c) * F.col("weight")) / F.sum("weight")).alias(c) for c in means], F.sum("weight").alias("weight"))


def surface_points(field: DataFrame, voxel: float = 0.01) -> DataFrame:
    """Points where the field changes sign between a voxel and its next one on an axis, by linear
    interpolation between their centres."""
    steps = [(0, 0, 0), *[tuple(int(k == axis) for k in range(3)) for axis in range(3)]]
    around = F.explode(F.array(*[F.struct(*[(F.col(c) - o).alias(c) for c, o in zip(_CELL, step, strict=True)], F.lit(k).alias("k")) for k, step in enumerate(steps)]))
    met = field.select(around.alias("q"), "sdf").groupBy(*[F.col(f"q.{c}").alias(c) for c in _CELL]).agg(*[F.max(F.when(F.col("q.k") == k, F.col("sdf"))).alias(f"s{k}") for k in range(4)])
    own = F.col("s0")
    made = []
    for axis in range(3):
        ahead = F.col(f"s{axis + 1}")
        share = own / (own - ahead)
        place = F.struct(*[((F.col(c) + 0.5 + (share if i == axis else F.lit(0.0))) * voxel).alias(a) for i, (c, a) in enumerate(zip(_CELL, "xyz", strict=True))])
        made.append(F.when((own > 0) != (ahead > 0), place))
    return met.select(F.explode(F.array(*made)).alias("p")).where("p IS NOT NULL").select("p.*")


def statistics(field: DataFrame, voxel: float = 0.01, truncation: float = 0.04) -> DataFrame:
    """One row: voxels, occupied ones (inside the surface), volume of these, mean weight, parameters."""
    return field.agg(F.count("*").alias("num_voxels"), F.count_if(F.col("sdf") <= 0).alias("inside"), (F.count_if(F.col("sdf") <= 0) * voxel**3).alias("volume"), F.avg("weight").alias("mean_weight")).withColumns({"voxel": F.lit(voxel), "truncation": F.lit(truncation)})


#: The eight corners of a cube, and its six tetrahedra around the diagonal from corner 0 to 7.
_CORNERS = [(i >> 2 & 1, i >> 1 & 1, i & 1) for i in range(8)]
_TETRAHEDRA = [(0, a, a | b, 7) for a in (1, 2, 4) for b in (1, 2, 4) if a != b]
TRIANGLES = "vx int, vy int, vz int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double"


def mesh(field: DataFrame, voxel: float = 0.01, keys: tuple[str, ...] = ()) -> DataFrame:
    """Triangles of the zero surface by marching tetrahedra, one row a triangle with its cube; with
    ``keys`` a mesh for each of their values.

    A cube has its corners at eight voxel centres; cubes without all eight give nothing. Every
    voxel is sent to the cubes around it, so no cube needs more than its own rows.
    """
    around = F.explode(F.array(*[F.struct(*keys, *[(F.col(c) - o).alias(c) for c, o in zip(_CELL, corner, strict=True)], F.lit(k).alias("k")) for k, corner in enumerate(_CORNERS)]))
    sent = field.select(around.alias("q"), "sdf").select("q.*", "sdf")
    cubes = sent.groupBy(*keys, *_CELL).agg(*[F.max(F.when(F.col("k") == k, F.col("sdf"))).alias(f"s{k}") for k in range(8)])
    full = cubes.where(F.greatest(*[f"s{k}" for k in range(8)]) > 0).where(F.least(*[f"s{k}" for k in range(8)]) <= 0).dropna(subset=[f"s{k}" for k in range(8)])
    kinds = dict(full.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        corners = np.array(_CORNERS, dtype=float)
        for batch in batches:
            base = batch[list(_CELL)].to_numpy()
            values = batch[[f"s{k}" for k in range(8)]].to_numpy()
            for tetra in _TETRAHEDRA:
                v = values[:, tetra]
                inside = v <= 0
                for pattern in range(1, 15):
                    low = [i for i in range(4) if pattern >> i & 1]
                    high = [i for i in range(4) if i not in low]
                    hit = np.flatnonzero((inside == [bool(pattern >> i & 1) for i in range(4)]).all(axis=1))
                    if not len(hit):
                        continue

                    def cut(i: int, j: int, hit: np.ndarray = hit, v: np.ndarray = v, tetra: tuple = tetra) -> np.ndarray:
                        share = (v[hit, i] / (v[hit, i] - v[hit, j]))[:, None]
                        place = corners[tetra[i]] + share * (corners[tetra[j]] - corners[tetra[i]])
                        return (base[hit] + 0.5 + place) * voxel

                    if len(low) == 2:
                        a, b, c, d = cut(low[0], high[0]), cut(low[0], high[1]), cut(low[1], high[1]), cut(low[1], high[0])
                        made = [(a, b, c), (a, c, d)]
                    else:
                        one, others = (low[0], high) if len(low) == 1 else (high[0], low)
                        made = [tuple(cut(one, o) for o in others)]
                    for triangle in made:
                        made_rows = pd.DataFrame(np.hstack([base[hit], *triangle]), columns=[c.split()[0] for c in TRIANGLES.split(", ")]).astype({c: "int32" for c in _CELL})
                        yield made_rows.assign(**{k: batch[k].to_numpy()[hit] for k in keys})

    return full.mapInPandas(run, ", ".join([TRIANGLES, *[f"`{k}` {kinds[k]}" for k in keys]]))


def _cross() -> list[Column]:
    """The normal of a triangle, as long as twice its area."""
    e, f = ([F.col(f"{a}{k}") - F.col(f"{a}0") for a in "xyz"] for k in (1, 2))
    return [e[1] * f[2] - e[2] * f[1], e[2] * f[0] - e[0] * f[2], e[0] * f[1] - e[1] * f[0]]


def vertex_normals(triangles: DataFrame, keys: tuple[str, ...] = (), places: int = 9) -> DataFrame:
    """(keys, x, y, z, nx, ny, nz): each vertex of a mesh with the mean direction of its triangles,
    weighed by area and turned so that its largest part is positive, as triangles have no common
    winding. Vertices are alike that agree to ``places`` decimals; one of no direction gets
    (0, 0, 1). A vertex lies in few triangles, whatever the size of the mesh.
    """
    cross = _cross()
    side = F.greatest(*[F.abs(c) for c in cross])
    lead = F.when(F.abs(cross[0]) == side, cross[0]).when(F.abs(cross[1]) == side, cross[1]).otherwise(cross[2])
    turned = [F.when(lead < 0, -c).otherwise(c).alias(f"n{a}") for c, a in zip(cross, "xyz", strict=True)]
    corners = F.explode(F.array(*[F.struct(*[F.round(F.col(f"{a}{k}"), places).alias(a) for a in "xyz"]) for k in range(3)]))
    rows = triangles.select(*keys, corners.alias("v"), *turned).groupBy(*keys, "v").agg(*[F.sum(f"n{a}").alias(f"n{a}") for a in "xyz"])
    size = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    rest = {"nx": 0.0, "ny": 0.0, "nz": 1.0}
    return rows.select(*keys, "v.*", *[F.when(size > 0, F.col(c) / size).otherwise(F.lit(z)).alias(c) for c, z in rest.items()])


def mesh_statistics(triangles: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Triangles, area, and the volume of the box around them, of each mesh (one row without keys)."""
    cross = _cross()
    area = F.sqrt(sum((c * c for c in cross[1:]), cross[0] * cross[0])) / 2
    sides = [F.max(F.greatest(*[f"{a}{k}" for k in range(3)])) - F.min(F.least(*[f"{a}{k}" for k in range(3)])) for a in "xyz"]
    return triangles.groupBy(*keys).agg(F.count("*").alias("num_triangles"), F.sum(area).alias("area"), (sides[0] * sides[1] * sides[2]).alias("box_volume"))
