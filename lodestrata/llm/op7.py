"""Query op7: classes of near-duplicates of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.probminhash import near_duplicates
from lodestrata.llm.session import table


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "copy_of", "class_id")


QUERIES = {"op7_near_dedup": op7_near_dedup}
ORACLE_SQL: dict[str, str] = {}
