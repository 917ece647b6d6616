"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one in ``spark.checkpoint.dir``. Where that is
    unset, a local session gets a folder of this machine and a cluster an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestrata-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again. Unlike a checkpoint it forgets what the
    optimiser has inferred, which would grow from round to round of a long loop."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that nothing refers to any more. Spark deletes them once the driver's
    garbage collection finds them, which on a driver with room to spare may be long after. As
    measured, one collection leaves the files of the query that ended last (probably held by the
    last events); a small job and a second collection free them."""
    for _ in range(2):
        gc.collect()
        spark.range(8).repartition(2).count()
        time.sleep(0.2)  # until its events are handled
        spark._jvm.System.gc()


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders that are no longer read, on whatever file system they are."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table."""
    remove(df.sparkSession, *{f.rsplit("/", 1)[0] for f in df.inputFiles()})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
