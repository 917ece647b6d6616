"""Query op1: the main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import crf
from lodestrata.llm.session import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.extract(table(spark, sf_dir, "pages"), crf.trained()).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op1_html_text": op1_html_text}
ORACLE_SQL: dict[str, str] = {}
