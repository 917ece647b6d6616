"""Reliable checkpoints for iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the session's ``spark.checkpoint.dir`` and cut its lineage; a folder of
    this machine serves only where that is unset."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lodestrata-"))
    return df.checkpoint(eager=True)
