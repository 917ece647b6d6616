"""Row types of the domain as DDL, declared once. Lengths are metres, z is up, poses map camera to world."""

from __future__ import annotations

BOX2D = "STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>"
BOX3D = "STRUCT<cx: DOUBLE, cy: DOUBLE, cz: DOUBLE, w: DOUBLE, h: DOUBLE, d: DOUBLE>"

FRAMES = ("frame_idx INT, color BINARY, depth BINARY, height INT, width INT, fx DOUBLE, fy DOUBLE, cx DOUBLE, cy DOUBLE, pose ARRAY<DOUBLE>, ts TIMESTAMP")
DETECTIONS = (f"scene_id STRING, frame_idx INT, det_idx INT, bbox {BOX2D}, score DOUBLE, area LONG, embedding ARRAY<FLOAT>")
MASK_PIXELS = ("frame_idx INT, det_idx INT, row INT, col INT")
DEPTH_PIXELS = ("frame_idx INT, row INT, col INT, z DOUBLE, r INT, g INT, b INT")
OBSERVATIONS = (f"scene_id STRING, object_id LONG, frame_idx INT, det_idx INT, is_match INT, similarity DOUBLE, bbox {BOX2D}, score DOUBLE, embedding ARRAY<FLOAT>")
TRACKS = (
    f"scene_id STRING, object_id LONG, status STRING, first_seen_frame INT, last_seen_frame INT, num_observations INT, num_missing_frames INT, bbox {BOX2D}, score DOUBLE, embedding ARRAY<DOUBLE>"
)
CAPTIONS = ("object_id LONG, frame_idx INT, seq INT, caption STRING")
OBJECTS = (
    "object_id LONG, label STRING, caption_history ARRAY<STRING>, status STRING, first_seen_frame INT, last_seen_frame INT, num_observations INT,"
    f" semantic_confidence DOUBLE, tracking_confidence DOUBLE, confidence DOUBLE, num_points LONG, bbox {BOX3D}, embedding ARRAY<FLOAT>"
)
POINTS = ("object_id LONG, x DOUBLE, y DOUBLE, z DOUBLE, r DOUBLE, g DOUBLE, b DOUBLE")
RELATIONS = ("object_a_id LONG, object_b_id LONG, relation_type STRING, confidence DOUBLE, metadata MAP<STRING, STRING>")
OVERLAP = ("a_id LONG, b_id LONG, ratio DOUBLE")
TSDF = ("vx INT, vy INT, vz INT, sdf DOUBLE, weight DOUBLE, r DOUBLE, g DOUBLE, b DOUBLE")

STATUSES = ("active", "missing", "inactive")
RELATION_TYPES = ("on", "in", "near", "above", "below", "left_of", "right_of", "front_of", "behind", "none")
