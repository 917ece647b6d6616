"""Domain views over the general test tables, as SQL that Spark and DuckDB read alike.

A table stands in braces; ``spark_view`` and ``duck_view`` fill it in. Scenes are runs of forty
parts, so all pairs of a scene are linear in the table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_LABEL = "CASE p_partkey % 8 WHEN 0 THEN 'cup' WHEN 1 THEN 'Table' WHEN 2 THEN 'book' WHEN 3 THEN 'shelf' WHEN 4 THEN 'Lamp' WHEN 5 THEN 'box' WHEN 6 THEN 'chair' ELSE '' END"

OBJECTS = f"""
SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS scene_id, p_partkey AS object_id,
       CASE WHEN p_partkey % 8 = 7 THEN '' ELSE concat({_LABEL}, ' ', p_name) END AS label,
       CASE p_partkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'missing' ELSE 'inactive' END AS status,
       CAST(p_partkey % 50 AS INT) AS first_seen_frame, CAST(p_partkey % 50 + p_size % 20 AS INT) AS last_seen_frame,
       CAST(coalesce(n_rows, 0) % 12 AS INT) AS num_observations, CAST(coalesce(n_points, 0) AS BIGINT) AS num_points,
       (1 + p_size % 10) / 10e0 AS confidence,
       (p_partkey % 20) / 10e0 AS cx, (CAST(floor(p_partkey / 20) AS BIGINT) % 20 + p_size % 7) / 10e0 AS cy, (p_partkey % 7) / 10e0 AS cz,
       (1 + p_size % 5) / 10e0 AS w, (1 + p_size % 3) / 10e0 AS h, (1 + p_partkey % 4) / 10e0 AS d
FROM {{part}} LEFT JOIN (SELECT l_partkey, count(*) AS n_rows, sum(l_quantity) * 10 AS n_points FROM {{lineitem}} GROUP BY l_partkey) t ON l_partkey = p_partkey"""

#: Clouds that touch but rarely: x by order, y by supplier, z by line.
POINTS = """
SELECT l_partkey AS object_id, l_orderkey / 100e0 AS x, l_suppkey / 100e0 AS y, l_linenumber / 100e0 AS z,
       (l_orderkey % 256) / 255e0 AS r, (l_suppkey % 256) / 255e0 AS g, l_discount AS b
FROM {lineitem}"""

DETECTIONS = """
SELECT event_type AS scene_id, CAST(floor(event_id / 50) AS INT) AS frame_idx, CAST(event_id % 50 AS INT) AS det_idx, user_id AS object_id,
       (event_id * 7 % 40) / 1e0 AS x1, (event_id * 11 % 40) / 1e0 AS y1, (event_id * 7 % 40 + 5 + event_id % 9) / 1e0 AS x2, (event_id * 11 % 40 + 4 + event_id % 7) / 1e0 AS y2,
       value AS score, CAST(event_id * 37 % 400 AS BIGINT) AS area
FROM {events}"""

CAPTIONS = """
SELECT conv_id AS object_id, CAST(turn AS INT) AS frame_idx, CAST(turn AS INT) AS seq, text AS caption FROM {conversations}"""

#: Masks: a rectangle of 2 to 7 by 2 to 5 pixels for each part, eight to a frame.
MASK_PIXELS = """
SELECT CAST(floor(p_partkey / 8) AS BIGINT) AS frame_idx, CAST(p_partkey % 8 AS INT) AS det_idx, CAST(p_size * 3 % 8 + dy AS INT) AS row, CAST(p_partkey * 5 % 9 + dx AS INT) AS col
FROM {part} CROSS JOIN (SELECT DISTINCT n_nationkey % 6 AS dx FROM {nation}) a CROSS JOIN (SELECT DISTINCT n_nationkey % 4 AS dy FROM {nation}) b
WHERE dx < 2 + p_size % 5 AND dy < 2 + p_partkey % 3"""

DEPTH = "SELECT frame_idx, row, col, CAST((row * 7 + col * 3 + frame_idx) % 50 AS DOUBLE) / 10e0 AS z FROM (SELECT DISTINCT frame_idx, row, col FROM ({mask_pixels}) m) u".replace("{mask_pixels}", MASK_PIXELS)

POSES = """
SELECT l_orderkey AS scene_id, l_linenumber AS frame_idx, l_partkey, (l_partkey % 360) * pi() / 180e0 AS turn, l_quantity AS tx, l_discount AS ty, l_tax AS tz FROM {lineitem}"""


def spark_view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view as a DataFrame; only the tables that the SQL names are read."""
    names = sorted(set(re.findall(r"\{(\w+)\}", sql)))
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def duck_view(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)
