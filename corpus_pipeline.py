"""A training corpus from documents: quality, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and
returns the columns of documents; the last returns the packed pieces. Decisions are
made for rows and joined to the texts by a row id, which each stage gives its rows in a
written table, so repeated and null doc_ids are decided one by one.

Edge cases, in every stage: null and empty texts are texts without words (quality rules
reject them); ties go to the smallest doc_id, nulls last or, in exact dedup, first, then
to the smallest row id; of repeated rows each is decided by itself; an empty table gives
an empty one; columns beside those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.llm.common import SCRATCH, documents, forget, prepare, written
from namewright.llm.exactdedup import dedup_exact
from namewright.llm.mixing import mix
from namewright.llm.packing import packed
from namewright.llm.quality import judge, learn
from namewright.llm.simhash import near_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The mixture cannot be told by SQL (a seeded choice), nor can token ids.
ORACLE_SQL = None


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """The rows with a unique ``row_id``, written, so that every reader sees the same ids; and how many tables are written so far."""
    rows = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_id")), "numbered")
    return rows, len(SCRATCH)


def only(rows: DataFrame, since: int, decided: DataFrame, more=()) -> DataFrame:
    """The rows of ``rows``, numbered, whose row_id is in ``decided`` (row_id, more...), each at most once there.

    Always a shuffled hash join on the narrow side: the texts move once and are not
    sorted, and the plan does not change with the size of the decisions. The decisions are
    written; the tables that led to them, those after the first ``since``, are deleted.
    """
    decided = written(decided.select("row_id", *more), "decided")
    forget(rows.sparkSession, since, keep=1)
    return rows.join(decided.hint("shuffle_hash"), "row_id").drop("row_id")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned list rejects."""
    rules = learn(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, since = numbered(docs)
    return only(rows, since, judge(rows, rules, row="row_id").where("kept"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts."""
    rows, since = numbered(docs)
    return only(rows, since, dedup_exact(rows, row="row_id").where("kept"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the smallest doc_id and then row id, of each component of near fingerprints."""
    rows, since = numbered(docs)
    return only(rows, since, near_dedup(rows, row="row_id").where("kept"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mixture takes it."""
    rows, since = numbered(docs)
    times = mix(rows, row="row_id").where("taken > 0").select(F.col("rid").alias("row_id"), F.expr("cast(taken div size as int)").alias("times"))
    repeated = only(rows, since, times, ["times"])
    return repeated.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in packed sequences of 1024 ids."""
    return packed(docs)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("SimHash near-dedup", simhash_dedup), ("mixing sources", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(prepare(spark), sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        since = len(SCRATCH)
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, "stage")
            forget(spark, since, keep=1)
    return docs
