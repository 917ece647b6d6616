"""Query op10: winnowing fingerprints of all documents and of their edited texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import winnow
from lodestrata.llm.session import table


def _text_of(kept: str) -> Column:
    return F.array_join(F.col(kept).cast("array<string>"), " ")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edit_and_fingerprint(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        _text_of("kept").alias("fingerprint"),
        _text_of("edited_kept").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


QUERIES = {"op10_fingerprints": op10_fingerprints}
ORACLE_SQL: dict[str, str] = {}
