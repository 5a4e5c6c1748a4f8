"""Operator 2, toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Presence of a hashed n-gram is scaled by the log of its smoothed rate among toxic over
its rate among other training rows; a logistic regression is fitted on the scaled
presences. Scoring reads each whole text once and needs no shuffle.

Edge cases: null and empty texts get the score of a text without any known n-gram; rows
with a null label, or labelled documents that are absent, do not train; repeated labels
of one document count once (toxic if any says so); one class alone, or no label, gives
its smoothed rate as every score; a null key counts as the empty text for its fold; an
empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.llm.common import bucket_of, documents, prepare, text_of, written
from namewright.llm.grams import gram_hashes

SIZES, BITS = (3, 4, 5, 6), 20
#: Bound of the labelled rows that the classifier is fitted on.
MOST_ROWS = 8_000
#: An n-gram counts if FEWEST rows have it and its log-count ratio is so many standard errors from zero, however many do.
FEWEST, CLEAR = 3, 3.5


def presence(text: str) -> np.ndarray:
    """Distinct hashed n-grams of a text."""
    parts = list(gram_hashes(text, SIZES, BITS))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def sampled(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, most_rows: int) -> DataFrame:
    """At most about ``most_rows`` labelled rows outside fold 0, up to half of each class: label, text."""
    kept = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("key").isNotNull() & (bucket_of(F.col("key"), 5) != 0))
    kept = kept.groupBy("key").agg(F.max("label").alias("label"))
    n = {r["label"]: r["n"] for r in kept.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = min(n.values(), default=0)
    share = {x: min(1.0, (most_rows - min(few, most_rows // 2) if m > few else most_rows // 2) / m) for x, m in n.items()}
    draw = F.pmod(F.xxhash64("key", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    drawn = kept.where(F.coalesce(*[F.when((F.col("label") == x) & (draw < s), True) for x, s in share.items()], F.lit(False)))
    rows = df.select(F.col(key).alias("key"), text_of(text).alias("text"))
    return written(rows.join(F.broadcast(drawn), "key").select("label", "text"), "toxicity-sample")  # drawn: at most most_rows ids


def ratios(sample: DataFrame, n_pos: int, n_neg: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams that count, 2**BITS at most, and their log-count ratios."""

    def op(batches):
        counts = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[int(y > 0), presence(t)] += 1
        at = np.flatnonzero(counts.any(axis=0))
        for i in range(0, len(at), 50_000):
            k = at[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(counts[1, k].astype(np.int64)), pa.array(counts[0, k].astype(np.int64))], names=["gram", "pos", "neg"])

    counted = sample.coalesce(16).mapInArrow(op, "gram int, pos bigint, neg bigint").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    p, q = (F.col("pos") + 0.5) / (n_pos + 1.0), (F.col("neg") + 0.5) / (n_neg + 1.0)
    error = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    found = counted.where(F.col("pos") + F.col("neg") >= FEWEST).select("gram", F.log(p / q).alias("r"), error.alias("e")).where(F.abs("r") >= CLEAR * F.col("e")).drop("e").toArrow()
    order = np.argsort(found.column("gram").to_numpy())
    return found.column("gram").to_numpy()[order].astype(np.int64), found.column("r").to_numpy()[order]


def logistic(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, rounds: int = 60, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on presences times ``scale`` (Adam on all rows, a few hundred at a time in memory)."""
    chunks = [rows[i : i + 250] for i in range(0, len(rows), 250)]
    w, b = np.zeros(len(scale)), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    m = v = np.zeros(len(scale) + 1)
    for i in range(1, rounds + 1):
        g, ws, at = np.zeros(len(scale) + 1), w * scale, 0
        for chunk in chunks:
            size = np.array([len(r) for r in chunk])
            col, row = np.concatenate(chunk), np.repeat(np.arange(len(chunk)), size)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, ws[col], len(chunk)) + b, -30, 30)))
            e = (p - y[at : at + len(chunk)]) / len(y)
            g += np.append(np.bincount(col, e[row], len(scale)), e.sum())
            at += len(chunk)
        g[:-1] = g[:-1] * scale + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w * scale, b


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = MOST_ROWS) -> tuple[np.ndarray, float]:
    """(weight per hashed n-gram as a table of 2**BITS, intercept)."""
    prepare(df.sparkSession)
    table = np.zeros(1 << BITS, np.float32)
    sample = sampled(df, labels, key, text, label, most_rows)
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos = sum(m for x, m in n.items() if x > 0)
    n_neg = sum(n.values()) - n_pos
    if not n_pos or not n_neg:
        return table, float(np.log((n_pos + 0.5) / (n_neg + 0.5)))
    grams, r = ratios(sample, n_pos, n_neg)
    place = np.full(1 << BITS, -1, np.int32)
    place[grams] = np.arange(len(grams))
    shared = df.sparkSession.sparkContext.broadcast(place)

    def op(batches):
        place = shared.value
        for batch in batches:
            found = [(x := place[presence(t)])[x >= 0] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["label", "grams"])

    got = sample.mapInArrow(op, "label int, grams array<int>").toArrow()
    rows = [x.values.to_numpy() for x in got.column("grams").combine_chunks()] if got.num_rows else []
    w, b = logistic(rows, (got.column("label").to_numpy() > 0).astype(float), r)
    table[grams] = w
    return table, b


def score(df: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score: the probability of label 1 for every whole text."""
    spark = prepare(df.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # 4 MB, whatever the corpus

    def op(batches):
        table, b = shared.value
        used = table != 0
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                parts = [h[used[h]] for h in gram_hashes(t, SIZES, BITS)]
                at = np.unique(np.concatenate(parts)) if parts else []
                out.append(1 / (1 + np.exp(-np.clip(float(table[at].sum()) + b if len(at) else b, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["key", "score"])

    return df.select(F.col(key).cast("bigint").alias("key"), text_of(text).alias("text")).mapInArrow(op, "key bigint, score double").withColumnRenamed("key", key)


def op2_toxicity(spark, sf_dir):
    """Contract 2 over all documents."""
    docs = documents(spark, sf_dir)
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (bucket_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
