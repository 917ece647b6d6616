"""The tracker and cloud aggregates on unbounded streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrata.operators.tracking import OBSERVED, Scene, Track, TrackerConfig, rows_of, step

_STATE = "next_id long, last_frame int, dropped long, tracks string, waiting string"
_COLUMNS = ["frame_idx", "det_idx", "x1", "y1", "x2", "y2", "embedding"]


def track_stream(detections: DataFrame, config: TrackerConfig = TrackerConfig(), timeout_ms: int = 10_000) -> DataFrame:
    """Observations of a stream of detections (columns as in batch; a null det_idx marks a frame
    without any).

    The newest frame of a scene waits until a later one arrives, or for ``timeout_ms`` without
    news. Rows of frames already passed are late: they are dropped and counted in the state.
    """
    rows = detections.select(F.col("scene_id").cast("string"), F.col("frame_idx").cast("int"), F.col("det_idx").cast("int"), "bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2", F.col("embedding").cast("array<double>"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_id, last, dropped, tracks, waiting = state.get if state.exists else (0, -1, 0, "[]", "[]")
        scene = Scene(next_id, [Track(*t) for t in json.loads(tracks)])
        got = [pd.DataFrame(json.loads(waiting), columns=_COLUMNS), *(b[_COLUMNS] for b in batches)]
        got = pd.concat([g for g in got if len(g)]) if any(len(g) for g in got) else got[0]
        late = got["frame_idx"] <= last
        dropped += int(late.sum())
        got = got[~late].sort_values(["frame_idx", "det_idx"], na_position="first")
        newest = None if state.hasTimedOut or not len(got) else got["frame_idx"].max()
        for frame_idx, part in got[got["frame_idx"] != newest].groupby("frame_idx", sort=True):
            part = part[part["det_idx"].notna()].drop_duplicates("det_idx")
            made = step(scene, rows_of(part), config)
            last = int(frame_idx)
            if made:
                ids, matched, scores = zip(*made, strict=True)
                yield pd.DataFrame({"scene_id": key[0], "frame_idx": last, "det_idx": part["det_idx"].astype(int).to_numpy(), "object_id": ids, "is_match": matched, "similarity": scores})
        kept = got[got["frame_idx"] == newest]
        packed = json.dumps([[None if not isinstance(x, list) and pd.isna(x) else x for x in (list(y) if hasattr(y, "__len__") else y for y in row)] for row in kept.astype(object).itertuples(index=False)], default=lambda x: x.item())
        state.update((scene.next_id, last, dropped, json.dumps([[t.object_id, t.box, t.feature, t.misses] for t in scene.tracks]), packed))
        if len(kept):
            state.setTimeoutDuration(timeout_ms)

    return rows.groupBy("scene_id").applyInPandasWithState(run, OBSERVED, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def voxel_stream(points: DataFrame, size: float, keys: tuple[str, ...] = ("object_id",)) -> DataFrame:
    """Sums and counts a voxel of a stream of points; write in update mode. Means are sums by ``n``."""
    cells = {f"v{a}": F.floor(F.col(a) / size) for a in "xyz"}
    sums = [F.sum(c).alias(f"sum_{c}") for c in ("x", "y", "z", "r", "g", "b") if c in points.columns]
    return points.withColumns(cells).groupBy(*keys, *cells).agg(*sums, F.count("*").alias("n"))


def windowed_counts(events: DataFrame, ts: str = "ts", window: str = "5 minutes", delay: str = "10 minutes", key: str = "scene_id") -> DataFrame:
    """Detections a scene and window of event time, closed once the watermark has passed."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n"))


def append_captions(captions: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """A stream of captions without repeats of (object_id, frame_idx, seq)."""
    return captions.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["object_id", "frame_idx", "seq"])
