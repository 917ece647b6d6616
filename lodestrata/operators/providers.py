"""Interfaces for models that run on executors, and table-backed stand-ins.

A provider is a picklable object made once a worker; adapters run it over batches. Real
weights are not part of this engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import geometry as G


class Segmenter(Protocol):
    def segment(self, image: bytes, boxes: list | None, points: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Masks (n, h, w), boxes (n, 4), scores (n,); empty arrays if there are none."""


class Embedder(Protocol):
    dimension: int

    def images(self, images: list[bytes]) -> np.ndarray: ...

    def texts(self, texts: list[str]) -> np.ndarray: ...


class Captioner(Protocol):
    def caption(self, crops: list[bytes]) -> list[str | None]: ...


#: Names of models and what makes them; unknown names are an error, not a default.
REGISTRY: dict[str, Callable[[], object]] = {}


def register(name: str) -> Callable:
    def keep(make: Callable[[], object]) -> Callable[[], object]:
        REGISTRY[name] = make
        return make

    return keep


def provider(name: str) -> object:
    if name not in REGISTRY:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]()


def _maker(name: str) -> Callable[[], object]:
    """What makes a model, to be shipped to the executors: these know only what is registered where
    this module is imported."""
    if name not in REGISTRY:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return np.divide(vectors, size, out=np.zeros_like(vectors, dtype=float), where=size > 0)


@register("hashed-words")
class HashedWords:
    """A deterministic embedder for tests: signed counts of hashed words (or bytes), unit length."""

    dimension = 64

    def texts(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dimension))
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % self.dimension] += 1 if h >> 16 & 1 else -1
        return unit(out)

    def images(self, images: list[bytes]) -> np.ndarray:
        out = np.zeros((len(images), self.dimension))
        for i, data in enumerate(images):
            out[i] = np.bincount(np.frombuffer(data, np.uint8) % self.dimension, minlength=self.dimension) if data else 0
        return unit(out)


def segment(frames: DataFrame, name: str, min_area: int = 100) -> DataFrame:
    """(frame_idx, det_idx, x1, y1, x2, y2, score, area) of each frame's ``color`` bytes; frames
    without masks give no rows. Columns ``boxes`` (arrays of x1, y1, x2, y2) and ``points`` (arrays
    of x, y) are the prompts of a frame; without them the model finds masks by itself."""
    make = _maker(name)
    prompts = [c for c in ("boxes", "points") if c in frames.columns]
    kinds = dict(frames.dtypes)

    def asked(row: object, column: str) -> list | None:
        found = getattr(row, column, None)
        return None if found is None else [list(p) for p in found]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            for r in batch.itertuples(index=False):
                masks, boxes, scores = model.segment(r.color, asked(r, "boxes"), asked(r, "points"))
                area = np.asarray(masks).reshape(len(masks), -1).sum(axis=1) if len(masks) else np.zeros(0)
                keep = np.flatnonzero(area >= min_area)
                if len(keep):
                    b = np.asarray(boxes, float)[keep]
                    yield pd.DataFrame({"frame_idx": r.frame_idx, "det_idx": np.arange(len(keep)), "x1": b[:, 0], "y1": b[:, 1], "x2": b[:, 2], "y2": b[:, 3], "score": np.asarray(scores, float)[keep], "area": area[keep].astype(int)})

    return frames.select("frame_idx", "color", *prompts).mapInPandas(run, f"frame_idx {kinds['frame_idx']}, det_idx int, x1 double, y1 double, x2 double, y2 double, score double, area long")


def embed(rows: DataFrame, name: str, column: str, out: str = "embedding", images: bool = False, batch_size: int | None = None) -> DataFrame:
    """``rows`` with the embedding of a text (or image bytes) column, ``batch_size`` rows at once
    (as Arrow delivers them if not given). No rows give no rows."""
    make = _maker(name)
    fields = [f"`{n}` {t}" for n, t in rows.dtypes]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        run_on = model.images if images else model.texts
        for batch in batches:
            if len(batch):
                values = batch[column].tolist()
                step = batch_size or len(values)
                made = np.concatenate([run_on(values[at : at + step]) for at in range(0, len(values), step)])
                yield batch.assign(**{out: list(np.asarray(made, dtype=np.float32))})

    return rows.mapInPandas(run, ", ".join([*fields, f"`{out}` array<float>"]))


def crops(detections: DataFrame, images: DataFrame, padding: float = 10.0) -> DataFrame:
    """(detections' columns, crop, crop_height, crop_width): the pixels of each detection's ``bbox``,
    grown by ``padding``, cut to whole pixels and clipped, out of ``images`` (frame_idx, image as
    Spark's image source gives it). Detections that have no image, no whole box, or an empty one get
    null and sides of 0.
    """
    box = G.crop_box(F.col("bbox"), padding, F.col("_w"), F.col("_h"), whole_pixels=True)
    pixels = images.select("frame_idx", F.col("image.data").alias("_data"), F.col("image.width").alias("_w"), F.col("image.height").alias("_h"), F.col("image.nChannels").alias("_n"))
    rows = detections.join(pixels, "frame_idx", "left").withColumn("_box", box)
    wide, high = F.col("_box.x2") - F.col("_box.x1"), F.col("_box.y2") - F.col("_box.y1")
    whole = F.col("_data").isNotNull()
    for side in ("x1", "y1", "x2", "y2"):  # the least and greatest of crop_box pass over nulls
        whole &= F.col(f"bbox.{side}").isNotNull()
    rows = rows.withColumns({n: F.when(whole, F.greatest(F.lit(0), c)).otherwise(0) for n, c in (("crop_width", wide), ("crop_height", high))})

    def line(y: Column) -> Column:
        return F.hex(F.substring(F.col("_data"), ((F.col("_box.y1") + y) * F.col("_w") + F.col("_box.x1")) * F.col("_n") + 1, F.col("crop_width") * F.col("_n")))

    some = (F.col("crop_width") > 0) & (F.col("crop_height") > 0)
    lines = F.transform(F.sequence(F.lit(0), F.col("crop_height") - 1), line)
    return rows.withColumn("crop", F.when(some, F.unhex(F.array_join(lines, "")))).select(*detections.columns, "crop", "crop_height", "crop_width")


def caption(rows: DataFrame, name: str, column: str = "crop", out: str = "caption", batch_size: int = 32) -> DataFrame:
    """``rows`` with the caption of an image column, ``batch_size`` at once; null images get null
    and are not given to the model."""
    make = _maker(name)
    fields = [f"`{n}` {t}" for n, t in rows.dtypes]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            said: list[str | None] = [None] * len(batch)
            asked = [i for i, image in enumerate(batch[column]) if image is not None]
            for at in range(0, len(asked), batch_size):
                part = asked[at : at + batch_size]
                for i, text in zip(part, model.caption([bytes(batch[column].iloc[i]) for i in part]), strict=True):
                    said[i] = text
            yield batch.assign(**{out: pd.Series(said, index=batch.index, dtype=object)})

    return rows.mapInPandas(run, ", ".join([*fields, f"`{out}` string"]))


def captions_from_table(crops: DataFrame, table: DataFrame) -> DataFrame:
    """A stand-in captioner: captions by (object_id, frame_idx) from a table, null where it has none."""
    return crops.join(table.select("object_id", "frame_idx", "caption"), ["object_id", "frame_idx"], "left")


def text_query(objects: DataFrame, name: str, text: str, top_k: int = 5, threshold: float = 0.5) -> DataFrame:
    """Objects nearest to a text, by the named embedder."""
    from lodestrata.operators.objects import by_embedding

    return by_embedding(objects.where(F.col("embedding").isNotNull()), provider(name).texts([text])[0].tolist(), top_k, threshold)
