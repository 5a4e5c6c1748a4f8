"""Tables written to the folder that all executors and the driver share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where no cluster names one, a temporary folder is made and set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster has to name a shared folder in spark.checkpoint.dir")
        own = tempfile.mkdtemp(prefix="namewright-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, rows: int, each: int, *keys: str) -> DataFrame:
    """Dealt by the keys into partitions of about ``each`` of ``rows`` rows, so that a task's memory does not grow with the table. Adaptive execution leaves such partitions as they are."""
    return df.repartition(max(1, -(-rows // each)), *keys)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes and rereads a table: cuts lineage, and a lost executor costs a re-read only."""
    at = fresh(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
