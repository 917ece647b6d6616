"""How a query and its SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.plans import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Views:
    """The domain views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, sql: str) -> DataFrame:
        return adapters.spark_view(self.spark, self.sf_dir, sql)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def objects(self) -> DataFrame:
        return self(adapters.OBJECTS).withColumn("bbox", F.struct("cx", "cy", "cz", "w", "h", "d")).drop("cx", "cy", "cz", "w", "h", "d")

    @property
    def points(self) -> DataFrame:
        return self(adapters.POINTS)

    @property
    def detections(self) -> DataFrame:
        return self(adapters.DETECTIONS).withColumn("bbox", F.struct("x1", "y1", "x2", "y2")).drop("x1", "y1", "x2", "y2")

    @property
    def captions(self) -> DataFrame:
        return self(adapters.CAPTIONS)

    @property
    def mask_pixels(self) -> DataFrame:
        return self(adapters.MASK_PIXELS)

    @property
    def depth(self) -> DataFrame:
        return self(adapters.DEPTH)


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of ``Views`` under ``name``; ``sql`` sees the views as tables."""

    def keep(f: Callable[[Views], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            views = {n: getattr(adapters, n.upper()) for n in ("objects", "points", "detections", "captions", "mask_pixels", "depth")}
            used = [n for n in views if f"v_{n}" in sql]
            head = ", ".join(f"v_{n} AS ({adapters.duck_view(views[n])})" for n in used)
            body = sql.strip()
            if "{head}" in body:
                body = body.replace("{head}", f"{head}, " if head else "")
            elif head:
                body = f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
            ORACLE_SQL[name] = body
        return f

    return keep


def r6(column: Column | str, name: str | None = None) -> Column:
    column_ = F.col(column) if isinstance(column, str) else column
    return F.round(column_, 6).alias(name or column)
