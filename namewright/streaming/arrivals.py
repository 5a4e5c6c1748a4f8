"""Arriving papers assigned as they come: an extension, the batch pipelines score one file after another.

A stream of (pid, block, year, authors) rows is joined to a static profile table and
scored with the batch operators' expressions; each micro-batch appends its best person
per paper. Batches are written by batch id, so a replayed batch replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from namewright.functions.similarity import jaccard, year_gap
from namewright.operators.ranking import top_1


def assign(papers: DataFrame, profiles: DataFrame, least: float = 0.1) -> DataFrame:
    """Best profile (block, aid, last_year, authors) of each paper of the block, if good enough."""
    pairs = papers.join(profiles.withColumnRenamed("authors", "known"), "block")
    score = jaccard(F.col("authors"), F.col("known")) - 0.01 * year_gap(F.col("year"), F.col("last_year"))
    return top_1(pairs.withColumn("score", F.round(score, 6)), ["pid"], "score", "aid", ["aid", "score"]).where(F.col("score") >= least)


def start(stream: DataFrame, profiles: DataFrame, out: str, checkpoint: str, least: float = 0.1) -> StreamingQuery:
    """Starts the stream; results are parquet folders ``out``/batch=<id>."""

    def batch(papers: DataFrame, number: int) -> None:
        assign(papers, profiles, least).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
