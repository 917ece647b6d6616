"""Queries on objects, captions and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import geometry as G
from lodestrata.operators import captions as C
from lodestrata.operators import objects as O
from lodestrata.plans.common import Views, query, r6

_SURE = "num_observations >= 2 AND num_points >= 100"


@query("confirmed_objects", f"SELECT object_id, label, num_observations, num_points FROM v_objects WHERE {_SURE} AND confidence >= 0.3")
def confirmed_objects(v: Views) -> DataFrame:
    return O.confirmed(v.objects, O.ConfirmConfig(min_confidence=0.3)).select("object_id", "label", "num_observations", "num_points")


@query("confirmed_without_confidence", f"SELECT object_id FROM v_objects WHERE {_SURE}")
def confirmed_without_confidence(v: Views) -> DataFrame:
    return O.confirmed(v.objects.drop("confidence"), use_confidence=False).select("object_id")


@query("confirmed_tracks", "SELECT object_id, num_observations FROM v_objects WHERE num_observations >= 2")
def confirmed_tracks(v: Views) -> DataFrame:
    return O.confirmed_tracks(v.objects).select("object_id", "num_observations")


@query("active_objects", "SELECT object_id, last_seen_frame - first_seen_frame + 1 AS age FROM v_objects WHERE status = 'active'")
def active_objects(v: Views) -> DataFrame:
    return O.age(O.with_status(v.objects, "active")).select("object_id", "age")


@query("label_search_partial", "SELECT object_id, label FROM v_objects WHERE label <> '' AND contains(lower(label), 'cup')")
def label_search_partial(v: Views) -> DataFrame:
    return O.by_label(v.objects, "CUP").select("object_id", "label")


@query("label_search_exact", "SELECT object_id, label FROM v_objects WHERE lower(label) = 'table red widget'")
def label_search_exact(v: Views) -> DataFrame:
    return O.by_label(v.objects, "Table Red Widget", partial=False).select("object_id", "label")


@query("object_by_id", "SELECT object_id, label, cx, cy, cz, w, h, d, num_observations, confidence FROM v_objects WHERE object_id = 17")
def object_by_id(v: Views) -> DataFrame:
    return O.brief(O.by_id(v.objects, 17)).select("object_id", "label", "bbox.*", "num_observations", "confidence")


@query("objects_in_region", "SELECT object_id FROM v_objects WHERE cx BETWEEN 0.5 AND 1.25 AND cy BETWEEN 0.25 AND 1 AND cz BETWEEN 0 AND 0.35")
def objects_in_region(v: Views) -> DataFrame:
    return O.in_region(v.objects, (0.5, 0.25, 0.0), (1.25, 1.0, 0.35)).select("object_id")


@query(
    "object_statistics",
    f"""SELECT count(*) AS total_objects, count(*) FILTER ({_SURE}) AS confirmed_objects, count(*) FILTER (status = 'active') AS active_objects,
 count(*) FILTER (label <> '') AS labelled_objects, round(avg(num_points), 6) AS avg_points, round(avg(num_observations), 6) AS avg_observations, round(avg(confidence), 6) AS avg_confidence FROM v_objects""",
)
def object_statistics(v: Views) -> DataFrame:
    s = O.statistics(v.objects)
    return s.select("total_objects", "confirmed_objects", "active_objects", "labelled_objects", r6("avg_points"), r6("avg_observations"), r6("avg_confidence"))


@query("top_objects_by_observations", "SELECT object_id, num_observations FROM v_objects ORDER BY num_observations DESC, object_id LIMIT 10")
def top_objects_by_observations(v: Views) -> DataFrame:
    return O.top_by(v.objects, "num_observations", 10).select("object_id", "num_observations")


@query("top_objects_by_points", "SELECT object_id, num_points FROM v_objects ORDER BY num_points DESC, object_id LIMIT 10")
def top_objects_by_points(v: Views) -> DataFrame:
    return O.top_by(v.objects, "num_points", 10).select("object_id", "num_points")


@query(
    "embedding_top_k",
    """WITH pairs AS (SELECT q.vec_id AS query_id, e.vec_id AS object_id, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 4) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)
SELECT query_id, object_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, object_id) AS rank FROM pairs WHERE similarity >= 0.2) WHERE rank <= 5""",
)
def embedding_top_k(v: Views) -> DataFrame:
    rows = v.table("embeddings").select(F.col("vec_id").alias("object_id"), "embedding")
    found = O.search(rows, rows.where("object_id % 100 = 0").withColumnRenamed("object_id", "query_id"), 5, 0.2, places=4)
    return found.select("query_id", "object_id", "similarity")


@query(
    "embedding_norms",
    "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm FROM embeddings",
)
def embedding_norms(v: Views) -> DataFrame:
    return v.table("embeddings").select("vec_id", F.round(G.norm(F.col("embedding")), 4).alias("norm"))


@query("caption_length_filter", "SELECT object_id, seq FROM v_captions WHERE length(caption) >= 200 AND frame_idx % 2 = 0")
def caption_length_filter(v: Views) -> DataFrame:
    return C.sampled_frames(C.long_enough(v.captions, 200), 2).select("object_id", "seq")


@query("captions_capped", "SELECT object_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY frame_idx, seq) AS k FROM v_captions) WHERE k <= 5")
def captions_capped(v: Views) -> DataFrame:
    return C.capped(v.captions, 5).select("object_id", "seq")


@query("caption_histories", "SELECT object_id, md5(string_agg(caption, '|' ORDER BY frame_idx, seq)) AS history_md5, count(*) AS n FROM v_captions GROUP BY object_id")
def caption_histories(v: Views) -> DataFrame:
    rows = C.histories(v.captions)
    return rows.select("object_id", F.md5(F.array_join("captions", "|").cast("binary")).alias("history_md5"), F.size("captions").cast("long").alias("n"))


_LONGEST = "arg_max(caption, (length(caption), -frame_idx, -seq))"


@query(
    "caption_short_labels",
    rf"""SELECT object_id, CASE WHEN count(*) > 1 THEN array_to_string(list_filter(regexp_split_to_array({_LONGEST}, '\s+'), lambda x: x <> '')[1:5], ' ') ELSE {_LONGEST} END AS label
 FROM v_captions GROUP BY object_id""",
)
def caption_short_labels(v: Views) -> DataFrame:
    return C.short_labels(v.captions)


@query(
    "caption_full_labels",
    rf"""WITH longest AS (SELECT object_id, {_LONGEST} AS label, count(*) AS n FROM v_captions GROUP BY object_id)
SELECT object_id, label, round(CASE WHEN any_value(n) = 1 THEN 0.5 ELSE count(*) FILTER (
   len(list_filter(regexp_split_to_array(lower(label), '\s+'), lambda x: x <> '' AND contains(lower(caption), x))) > 0) / count(*) END, 6) AS semantic_confidence
FROM v_captions JOIN longest USING (object_id) GROUP BY object_id, label""",
)
def caption_full_labels(v: Views) -> DataFrame:
    return C.full_labels(v.captions).select("object_id", "label", r6("semantic_confidence"))


@query(
    "caption_statistics",
    """SELECT count(*) AS captioned_objects, CAST(sum(labelled) AS BIGINT) AS labelled_objects, CAST(sum(n) AS BIGINT) AS total_captions, round(avg(n), 6) AS avg_captions
 FROM (SELECT object_id, count(*) AS n, CAST(max(caption <> '') AS INT) AS labelled FROM v_captions GROUP BY object_id)""",
)
def caption_statistics(v: Views) -> DataFrame:
    return C.statistics(v.captions).select("captioned_objects", "labelled_objects", "total_captions", r6("avg_captions"))


@query(
    "finalised_objects",
    f"""WITH seen AS (SELECT object_id, min(frame_idx) AS first_seen_frame, max(frame_idx) AS last_seen_frame, count(*) AS num_observations FROM v_detections GROUP BY object_id),
 boxes AS (SELECT object_id, count(*) AS n, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz, max(x) - min(x) AS w, max(y) - min(y) AS h, max(z) - min(z) AS d FROM v_points GROUP BY object_id),
 longest AS (SELECT object_id, {_LONGEST} AS label, count(*) AS n FROM v_captions GROUP BY object_id),
 named AS (SELECT object_id, label, CASE WHEN any_value(n) = 1 THEN 0.5 ELSE count(*) FILTER (len(list_filter(regexp_split_to_array(lower(label), '\\s+'), lambda x: x <> '' AND contains(lower(caption), x))) > 0) / count(*) END AS sc FROM v_captions JOIN longest USING (object_id) GROUP BY object_id, label)
SELECT object_id, first_seen_frame, last_seen_frame, num_observations, coalesce(b.n, 0) AS num_points, round(cx, 6) AS cx, round(d, 6) AS d, round(cx + w / 2, 6) AS corner_x,
 coalesce(label, 'object_' || object_id) AS label, round(coalesce(sc, 0), 6) AS semantic_confidence, least(1, num_observations / 10) AS tracking_confidence,
 round((coalesce(sc, 0) + least(1, num_observations / 10)) / 2, 6) AS confidence
FROM seen LEFT JOIN boxes b USING (object_id) LEFT JOIN named USING (object_id)""",
)
def finalised_objects(v: Views) -> DataFrame:
    rows = O.finalise(v.detections, v.points, C.full_labels(v.captions))
    return rows.select(
        "object_id", "first_seen_frame", "last_seen_frame", "num_observations", "num_points", r6("bbox.cx", "cx"), r6("bbox.d", "d"),
        r6(F.col("corners")[1][0], "corner_x"), "label", r6("semantic_confidence"), "tracking_confidence", r6("confidence"),
    )
