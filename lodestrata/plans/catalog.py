"""The registry of queries on the engine's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.plans import common, composed_queries, objects_queries, perception_queries, relations_queries, tracking_queries
from lodestrata.plans.common import Views

MODULES = (composed_queries, objects_queries, relations_queries, perception_queries, tracking_queries)
QUERIES, ORACLE_SQL = common.QUERIES, common.ORACLE_SQL


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations_queries.relation_summary(Views(spark, sf_dir))
