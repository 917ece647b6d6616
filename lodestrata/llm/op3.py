"""Query op3: rates that mix all documents to target weights of labelled domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.mixing import mix
from lodestrata.llm.session import table

#: Target shares of tokens: documents that look low or toxic are mixed to these, not removed.
WEIGHTS = {"clean": 0.95, "low": 0.03, "toxic": 0.02}


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the labels of quality and toxicity."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), domains_of(table(spark, sf_dir, "labels")), WEIGHTS, anchor="clean")


QUERIES = {"op3_mixing": op3_mixing}
ORACLE_SQL: dict[str, str] = {}
