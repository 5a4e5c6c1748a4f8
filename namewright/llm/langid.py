"""Operator 6, language identification by multilingual mixture inference.

Every language has a smoothed distribution over hashed character n-grams. A document is a
mixture of languages: expectation-maximisation finds the proportions that make its
n-grams likeliest. Its language set grows along the proportions of the full mixture and
stops where another language does not raise the likelihood by more than its penalty.

Edge cases: a null text, or one without a letter (numerals and signs that print as letters are
none), is ``und`` with score 0; more than ``MOST_LANGUAGES`` languages are refused; documents
with a null language do not train; if nothing trains, every text is ``und``; repeated
rows train and are scored one by one; ties go to the language first in code point order;
an empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.llm.common import bucket_of, documents, prepare, text_of, written
from namewright.llm.grams import gram_hashes

SIZES, BITS = (2, 3, 4), 16
#: Bound of training documents for each language.
MOST_DOCS = 2_000
#: Log-likelihood that a further language must add: PENALTY x log(number of n-grams). N-grams overlap, so it is above the 1/2 of independent draws.
PENALTY, ROUNDS = 4.0, 25
#: The model is a table of 2**BITS numbers a language, and every worker holds it: 256 MB at most.
MOST_LANGUAGES = 1_000


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of the text and how often each occurs."""
    parts = list(gram_hashes(text, SIZES, BITS))
    counts = np.bincount(np.concatenate(parts).astype(np.int64), minlength=1 << BITS) if parts else np.zeros(1 << BITS, np.int64)
    at = np.flatnonzero(counts)
    return at, counts[at]


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most_docs: int = MOST_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages in code point order, P(n-gram | language) as a table of 2**BITS rows)."""
    prepare(df.sparkSession)
    train = df.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), text_of(text).alias("text")).where(F.col("lang").isNotNull() & (bucket_of(F.col("key"), 4) != 2))
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    langs = sorted(sizes)
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; at most {MOST_LANGUAGES} are learned")
    if not langs:
        return [], np.zeros((1 << BITS, 0), np.float32)
    draw = F.pmod(F.xxhash64("key", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, most_docs / sizes[k]))])
    place = {k: i for i, k in enumerate(langs)}

    def op(batches):
        counts = np.zeros((len(place), 1 << BITS), np.int64)
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, n = gram_counts(t)
                counts[place[k], at] += n
        for i in np.flatnonzero(counts.any(axis=1)):
            at = np.flatnonzero(counts[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[i, at])], names=["lang", "gram", "n"])

    sample = written(train.where(draw < share[F.col("lang")]).select("lang", "text"), "language-sample").coalesce(16)
    got = sample.mapInArrow(op, "lang int, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # at most languages x 2**BITS rows
    table = np.full((1 << BITS, len(langs)), 0.5)
    table[got.column("gram").to_numpy(), got.column("lang").to_numpy()] += got.column("n").to_numpy()
    return langs, (table / table.sum(axis=0)).astype(np.float32)


def mixture(likely: np.ndarray, counts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions after expectation-maximisation, and the log-likelihood."""
    share, total = start / start.sum(), counts.sum()
    for _ in range(ROUNDS):
        mixed = likely @ share
        new = share * (likely.T @ (counts / mixed)) / total
        done = np.abs(new - share).max() < 1e-3
        share = new / new.sum()
        if done:
            break
    return share, float(counts @ np.log(likely @ share))


def proportions(likely: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Proportion of each language; zero outside the set of best penalised likelihood."""
    langs = likely.shape[1]
    alone = counts @ np.log(likely)
    best = np.zeros(langs)
    best[int(np.argmax(alone))] = 1.0
    if langs == 1:
        return best
    full, _ = mixture(likely, counts, np.ones(langs))
    order = [int(np.argmax(alone)), *(i for i in np.argsort(-full, kind="stable") if i != np.argmax(alone))]
    value, toll = float(alone.max()), PENALTY * np.log(counts.sum())
    for k in range(2, langs + 1):
        members = order[:k]
        share, fitted = mixture(likely[:, members], counts, np.maximum(full[members], 1e-3))
        if fitted - value <= toll:
            break
        value, best = fitted, np.zeros(langs)
        best[members] = share
    return best


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (its proportion), languages (map of all proportions above zero)."""
    spark = prepare(df.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # languages x 2**BITS floats

    def op(batches):
        langs, table = shared.value
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not langs or not any(map(str.isalpha, t)):
                    rows.append({"key": k, "lang_pred": "und", "score": 0.0, "languages": []})
                    continue
                at, n = gram_counts(t)
                share = proportions(table[at].astype(np.float64), n)
                top = int(np.argmax(share))
                rows.append({"key": k, "lang_pred": langs[top], "score": float(min(1.0, share[top])), "languages": [(langs[i], float(share[i])) for i in np.flatnonzero(share)]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=OUT)

    out = df.select(F.col(key).cast("bigint").alias("key"), text_of(text).alias("text")).mapInArrow(op, "key bigint, lang_pred string, score double, languages map<string,double>")
    return out.withColumnRenamed("key", key)


OUT = pa.schema([("key", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.map_(pa.string(), pa.float64()))])


def op6_language_id(spark, sf_dir):
    """Contract 6 over all documents."""
    docs = documents(spark, sf_dir)
    found = identify(docs, fit(docs))
    return found.select("doc_id", (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
