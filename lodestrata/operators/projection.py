"""Principal components of embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def principal(rows: DataFrame, column: str = "embedding", k: int = 2) -> DataFrame:
    """``rows`` with ``projected``, the first ``k`` principal components of a vector column about its
    mean, and ``explained``, their shares of the variance. Rows without a vector are kept and
    not projected (null); with two vectors or fewer none is."""
    empty = F.lit(None).cast("array<double>")
    vectors = rows.where(F.col(column).isNotNull()).withColumn("_v", array_to_vector(F.col(column)))
    if vectors.limit(3).count() < 3:
        return rows.withColumns({"projected": empty, "explained": empty})
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vectors)
    mean = np.array(vectors.select(Summarizer.mean(F.col("_v")).alias("m")).first()["m"].toArray())
    shift = mean @ model.pc.toArray()  # k numbers
    shares, shifts = (F.array(*[F.lit(float(x)) for x in values]) for values in (model.explainedVariance.toArray(), shift))
    made = model.transform(vectors).withColumns({"projected": F.zip_with(vector_to_array("_p"), shifts, lambda a, b: a - b), "explained": shares}).drop("_v", "_p")
    return made.unionByName(rows.where(F.col(column).isNull()).withColumns({"projected": empty, "explained": empty}))
