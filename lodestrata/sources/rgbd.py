"""RGB-D scenes on disk: images, poses, slicing and resizing, as DataFrames.

A scene folder has ``results/frame*.jpg``, ``results/depth*.png`` and ``traj.txt`` with one
row-major 4 x 4 pose (camera to world) a line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.sources import png


@dataclass(frozen=True)
class Camera:
    height: int = 680
    width: int = 1200
    fx: float = 600.0
    fy: float = 600.0
    cx: float = 599.5
    cy: float = 339.5
    depth_scale: float = 6553.5

    def resized(self, height: int | None, width: int | None) -> Camera:
        """Intrinsics after a resize; nothing changes unless both sides are given."""
        if not height or not width:
            return self
        sx, sy = width / self.width, height / self.height
        return replace(self, height=height, width=width, fx=self.fx * sx, cx=self.cx * sx, fy=self.fy * sy, cy=self.cy * sy)


@dataclass(frozen=True)
class SceneConfig:
    kind: str = "replica"
    path: str = ""
    start: int = 0
    end: int = -1
    stride: int = 1
    max_frames: int = 0
    height: int | None = 480
    width: int | None = 640
    camera: Camera = Camera()


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(position, path) of the files that match, in the order of the numbers in their names."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    number = F.regexp_extract("path", r"(\d+)\.[^./]*$", 1).cast("long")
    return listed.select((F.row_number().over(Window.orderBy(number, "path")) - 1).alias("position"), "path")


def poses(spark: SparkSession, path: str) -> DataFrame:
    """(position, pose) by line; a line without sixteen numbers is an error."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\n")).alias("position", "line"))
    numbers = F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.try_cast("double"))
    made = lines.withColumn("pose", numbers)
    bad = (F.size("pose") != 16) | F.exists("pose", lambda x: x.isNull())
    return made.select("position", F.when(bad, F.raise_error(F.concat(F.lit("pose line without sixteen numbers: "), F.col("position").cast("string")))).otherwise(F.col("pose")).alias("pose"))


def sliced(rows: DataFrame, start: int = 0, end: int = -1, stride: int = 1) -> DataFrame:
    """Positions start, start + stride, ... before ``end`` (-1: all), with ``frame_idx`` from 0."""
    kept = rows.where((F.col("position") >= start) & ((F.col("position") - start) % stride == 0))
    if end >= 0:
        kept = kept.where(F.col("position") < end)
    return kept.withColumn("frame_idx", F.expr(f"CAST((position - {start}) div {stride} AS INT)"))


def frames(spark: SparkSession, config: SceneConfig) -> DataFrame:
    """One row a frame: frame_idx, color_path, depth_path, camera columns, pose.

    Errors: an unknown kind, no images, other numbers of colour and depth images, fewer poses
    than images.
    """
    if config.kind != "replica":
        raise ValueError(f"unknown kind of dataset: {config.kind!r}")
    color, depth = files(spark, f"{config.path}/results", "frame*.jpg"), files(spark, f"{config.path}/results", "depth*.png")
    n, m = color.count(), depth.count()
    if not n or not m:
        raise FileNotFoundError(f"{config.path}: {n} colour and {m} depth images")
    if n != m:
        raise ValueError(f"{config.path}: {n} colour but {m} depth images")
    placed = poses(spark, f"{config.path}/traj.txt")
    if placed.count() < n:
        raise ValueError(f"{config.path}: fewer poses than images")
    rows = color.withColumnRenamed("path", "color_path").join(depth.withColumnRenamed("path", "depth_path"), "position").join(placed, "position")
    end = config.start + config.max_frames * config.stride if config.max_frames > 0 else config.end
    camera = config.camera.resized(config.height, config.width)
    numbers = {k: F.lit(v) for k, v in (("height", camera.height), ("width", camera.width), ("fx", camera.fx), ("fy", camera.fy), ("cx", camera.cx), ("cy", camera.cy))}
    return sliced(rows, config.start, end, config.stride).drop("position").withColumns(numbers)


def nearest_rows(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resize by taking the source pixel that each target pixel's start falls in."""
    y = np.minimum((np.arange(height) * (image.shape[0] / height)).astype(int), image.shape[0] - 1)
    x = np.minimum((np.arange(width) * (image.shape[1] / width)).astype(int), image.shape[1] - 1)
    return image[y][:, x]


def bilinear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resize with centres aligned, borders held."""
    y = np.clip((np.arange(height) + 0.5) * image.shape[0] / height - 0.5, 0, image.shape[0] - 1)
    x = np.clip((np.arange(width) + 0.5) * image.shape[1] / width - 0.5, 0, image.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    image = image.astype(np.float32).reshape(*image.shape[:2], -1)
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    return (top * (1 - fy) + (image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx) * fy).astype(np.float32)


def depth_pixels(frames_: DataFrame, scale: float = 6553.5) -> DataFrame:
    """(frame_idx, row, col, z): depths in metres of each frame's depth image, resized by nearest
    pixel to the frame's size."""
    spark = frames_.sparkSession
    folder = frames_.select(F.regexp_extract("depth_path", r"^(.*)/[^/]*$", 1).alias("f")).first()
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "depth*.png").load(folder["f"]).select(F.col("path").alias("depth_path"), "content")
    rows = frames_.select("frame_idx", "height", "width", "depth_path").join(raw, "depth_path").select("frame_idx", "height", "width", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                z = nearest_rows(png.decode(r.content), r.height, r.width).astype(np.float64) / scale
                row, col = np.indices(z.shape)
                yield pd.DataFrame({"frame_idx": r.frame_idx, "row": row.ravel(), "col": col.ravel(), "z": z.ravel()})

    return rows.mapInPandas(run, "frame_idx int, row int, col int, z double")


def color_images(frames_: DataFrame) -> DataFrame:
    """(frame_idx, image) with Spark's image source: decoded 8-bit pixels, blue first."""
    spark = frames_.sparkSession
    folder = frames_.select(F.regexp_extract("color_path", r"^(.*)/[^/]*$", 1).alias("f")).first()
    images = spark.read.format("image").option("pathGlobFilter", "frame*.jpg").load(folder["f"])
    place: Column = F.regexp_extract("image.origin", r"([^/]*)$", 1)
    return frames_.select("frame_idx", F.regexp_extract("color_path", r"([^/]*)$", 1).alias("_n")).join(images.withColumn("_n", place), "_n").drop("_n")


def color_pixels(frames_: DataFrame, images: DataFrame) -> DataFrame:
    """(frame_idx, row, col, r, g, b) in 0..1: the images (as ``color_images`` gives them) resized
    between pixels to the frame's size; grey ones have three equal parts."""
    rows = frames_.select("frame_idx", "height", "width").join(images.select("frame_idx", "image"), "frame_idx")
    rows = rows.select("frame_idx", "height", "width", F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("data"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                bgr = bilinear(np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, r.n), r.height, r.width).reshape(-1, r.n) / 255.0
                bgr = bgr[:, :3] if r.n >= 3 else np.repeat(bgr[:, :1], 3, axis=1)
                row, col = np.indices((r.height, r.width))
                yield pd.DataFrame({"frame_idx": r.frame_idx, "row": row.ravel(), "col": col.ravel(), "r": bgr[:, 2], "g": bgr[:, 1], "b": bgr[:, 0]})

    return rows.mapInPandas(run, "frame_idx int, row int, col int, r double, g double, b double")


def camera_params(frames_: DataFrame) -> DataFrame:
    return frames_.select("frame_idx", "fx", "fy", "cx", "cy", "width", "height")
