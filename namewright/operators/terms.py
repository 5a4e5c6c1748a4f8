"""Term statistics: document frequency, idf, n-grams, TF-IDF of persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namewright.functions.text import ngrams
from namewright.operators.ranking import top_k
from namewright.sources.shared import written


def document_frequency(df: DataFrame, tokens: str) -> DataFrame:
    """(token, df): documents that hold each token."""
    return df.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    """ln(n / (df + 1)); at or below zero for tokens of almost all documents."""
    return F.log(n / (df + 1))


def ngram_counts(df: DataFrame, owner: str, tokens: str, sizes: range) -> DataFrame:
    """(owner, ngram, n) for all sizes at once."""
    grams = F.flatten(F.array(*[ngrams(F.col(tokens), n) for n in sizes]))
    return df.select(owner, F.explode(grams).alias("ngram")).groupBy(owner, "ngram").agg(F.count(F.lit(1)).alias("n"))


def owner_lengths(df: DataFrame, owner: str, tokens: str) -> DataFrame:
    """Tokens of each owner."""
    return df.groupBy(owner).agg(F.sum(F.size(tokens)).alias("length"))


def owner_tfidf(counts: DataFrame, lengths: DataFrame, owner: str) -> DataFrame:
    """N / length x ln(owners / (owners with the n-gram + 1)).

    How many owners have an n-gram is written, so that its size is known where it is joined
    and few n-grams do not make the counts move.
    """
    owners = lengths.agg(F.count(F.lit(1)).alias("owners"))
    df = written(counts.groupBy("ngram").agg(F.count(F.lit(1)).alias("df")), "owners-of-ngrams")
    joined = counts.join(lengths, owner).join(df, "ngram").join(F.broadcast(owners))
    return joined.select(owner, "ngram", (F.col("n") / F.col("length") * idf(F.col("owners"), F.col("df"))).alias("tfidf"))


def mean_ngram_score(papers: DataFrame, pid: str, owner: str, tokens: str, sizes: range) -> DataFrame:
    """Mean owner score (A05) over a paper's n-grams, repeats counted; no n-gram gives 0.

    An owner's counts are taken beside the n-grams, in the owner's partition, instead of being joined.
    """
    counts = ngram_counts(papers, owner, tokens, sizes)
    owners = papers.agg(F.count_distinct(owner).alias("owners"))
    df = written(counts.groupBy("ngram").agg(F.count(F.lit(1)).alias("df")), "owners-of-ngrams")
    grams = F.flatten(F.array(*[ngrams(F.col(tokens), n) for n in sizes]))
    rows = papers.withColumn("length", F.sum(F.size(tokens)).over(Window.partitionBy(owner))).select(pid, owner, "length", F.explode_outer(grams).alias("ngram"))
    rows = rows.withColumn("n", F.count("ngram").over(Window.partitionBy(owner, "ngram"))).join(df, "ngram", "left").join(F.broadcast(owners))
    tfidf = F.col("n") / F.col("length") * idf(F.col("owners"), F.col("df"))
    return rows.groupBy(pid, owner).agg(F.avg(F.coalesce(tfidf, F.lit(0.0))).alias("score"))


def top_terms(df: DataFrame, owner: str, doc: str, words: str, k: int) -> DataFrame:
    """Each owner's k terms of largest summed TF-IDF, fitted per owner.

    Smooth idf ln((1 + n) / (1 + df)) + 1 and rows of unit length, as vectorizers do by default.
    """
    over = lambda *keys: Window.partitionBy(*keys)
    docs = df.groupBy(owner).agg(F.count(F.lit(1)).alias("docs"))
    terms = df.join(docs, owner).select(owner, doc, "docs", F.explode(words).alias("term")).groupBy(owner, doc, "term", "docs").agg(F.count(F.lit(1)).alias("tf"))
    weighed = terms.withColumn("df", F.count(F.lit(1)).over(over(owner, "term"))).withColumn("w", F.col("tf") * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1))
    normed = weighed.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(over(owner, doc))))
    scored = normed.groupBy(owner, "term").agg(F.round(F.sum(F.col("w") / F.col("norm")), 9).alias("score"))
    return top_k(scored, [owner], [F.desc("score"), "term"], k)
