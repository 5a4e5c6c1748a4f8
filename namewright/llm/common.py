"""What the operators share: the shared folder, written tables, row keys, word caches.

Every operator takes a DataFrame plus the names of its key and text columns and
first projects exactly those, so extra columns, whatever their names, never clash.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: ``spark.checkpoint.dir``.

    Only where the cluster names none (single-machine tests) a temporary folder is
    made and set.
    """
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


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package and bounds their batches.

    Batches hold at most 500 rows, so a worker's memory follows its longest
    documents and not the row count.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    env.setdefault("TOKENIZERS_PARALLELISM", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return spark


#: Addresses of the tables written so far, in order.
SCRATCH: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    Cuts lineage so that a lost executor costs a re-read and not a re-run, and makes
    both sides of a later join shuffles of their own, which adaptive execution can split.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    SCRATCH.append(at)
    return spark.read.schema(df.schema).parquet(at)


def forget(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Deletes the tables that were written after the first ``since``, except for the last ``keep``, once nothing reads them any more."""
    to = len(SCRATCH) - keep
    for at in SCRATCH[since:to]:
        where = spark._jvm.org.apache.hadoop.fs.Path(at)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    del SCRATCH[since:to]


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def bucket_of(col: Column, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo ``modulus``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


class WordIds(dict):
    """Ids (little-endian bytes) of text pieces that a tokenizer treats independently.

    A miss is tokenized by ``encode``; at ``most`` entries the cache starts anew, so
    a worker's memory stays bounded whatever the vocabulary.
    """

    def __init__(self, encode, most: int = 600_000):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, piece):
        if len(self) >= self.most:
            self.clear()
        ids = self.encode(piece)
        if len(piece) <= 40:
            self[piece] = ids
        return ids
