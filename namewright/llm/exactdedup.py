"""Operator 4, exact dedup by content-defined chunk recipes; DataFrame functions only.

A normalised text is cut where its own characters say so. Equal chunks get one verified
identifier: their 64-bit hash, and, where different chunks share a hash, their place
among those. Two texts are equal exactly when their ordered identifier lists are, so
long documents are never moved or compared again: each distinct chunk moves once (per
map task) for verification, all else works on the short lists.

Edge cases: null counts as empty and empty texts are equal to each other; a null key
sorts first among equals; repeated rows (same key, same text) each count and one of
them is kept; an empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namewright.llm.common import documents, prepare, text_of, written

#: The characters that normalisation deletes.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: A chunk ends after this pair of characters once it is long enough, or at the most characters.
LEAST, MOST, ENDS = 512, 4096, "[aeiouäöüéèáíóú][bcdfghjkmpqvwxyz]"


def normalised(text: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), BLANKS, text)


def chunks(norm: Column) -> Column:
    """The text's chunks, in order; joined they give the text."""
    return F.regexp_extract_all(norm, F.lit(rf"(?s).{{{LEAST},{MOST - 2}}}?{ENDS}|.{{1,{MOST}}}"), F.lit(0))


def recipes(df: DataFrame, key: str, text: str, hash_bits: int = 64, row: str | None = None) -> DataFrame:
    """Per row: key, row id if named, code points of the original text, SHA-256 of the normalised text, recipe (a hash per chunk)."""
    ids = [F.col(row).alias("rid")] if row else []
    norm = df.select(F.col(key).alias("key"), *ids, text_of(text).alias("text")).withColumns({"n": F.length("text"), "norm": normalised(F.col("text"))}).drop("text")
    return norm.select(*norm.columns[:-1], F.sha2("norm", 256).alias("sha"), F.transform(chunks(F.col("norm")), lambda c: hashed(c, hash_bits)).alias("recipe"))


def hashed(chunk: Column, bits: int) -> Column:
    return F.xxhash64(chunk) if bits == 64 else F.xxhash64(chunk).bitwiseAND(F.lit((1 << bits) - 1))


def pieces(df: DataFrame, key: str, text: str, hash_bits: int) -> DataFrame:
    placed = df.select(F.col(key).alias("key"), F.posexplode(chunks(normalised(text_of(text)))).alias("pos", "chunk"))
    return placed.withColumn("h", hashed(F.col("chunk"), hash_bits))


def clashing(df: DataFrame, key: str, text: str, hash_bits: int) -> DataFrame:
    """Hashes that different chunks share.

    Groups by hash and whole chunk, so every identifier is verified on content; a map
    task sends a chunk once however often it holds it. At 64 bits even 10^10 distinct
    chunks are expected to give fewer than three such hashes.
    """
    distinct = pieces(df, key, text, hash_bits).groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("uses"))
    return written(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("h"), "clashes")


def patches(df: DataFrame, clash: DataFrame, key: str, text: str, hash_bits: int) -> DataFrame:
    """Per key with clashing chunks: the recipe's corrections, (position, place among the hash's chunks)."""
    hit = pieces(df, key, text, hash_bits).join(clash, "h")
    variants = hit.select("h", "chunk").distinct().withColumn("variant", F.row_number().over(Window.partitionBy("h").orderBy("chunk")) - 1)
    return hit.join(variants.where("variant > 0"), ["h", "chunk"]).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("pos", "variant", F.xxhash64("chunk", "variant").alias("of")))).alias("patch"))


PATCH = "array<struct<pos:int,variant:int,of:bigint>>"


def dedup_exact(df: DataFrame, key: str = "doc_id", text: str = "text", hash_bits: int = 64, row: str | None = None) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256, and ``row``, a unique row id, if named.

    Of equal texts the row with the most code points, then the smallest key, then the smallest row id, stays.
    Group results are written before they are joined to the rows, so a group that holds
    a third of all rows is a skewed join side, which adaptive execution splits.
    """
    prepare(df.sparkSession)
    clash = clashing(df, key, text, hash_bits)
    if clash.isEmpty():
        rows = recipes(df, key, text, hash_bits, row).withColumn("patch", F.array().cast(PATCH))
    else:  # corrections are joined row by row, so the rows get their ids first
        numbered = written(df.select(F.col(key).alias("key"), F.col(text).alias("text"), (F.col(row) if row else F.monotonically_increasing_id()).alias("rid")), "numbered")
        more = patches(numbered, clash, "rid", "text", hash_bits).withColumnRenamed("key", "rid")
        rows = recipes(numbered, "key", "text", hash_bits, "rid").join(more, "rid", "left").withColumn("patch", F.coalesce("patch", F.array().cast(PATCH)))
    rows = written(rows.select(F.col("rid") if "rid" in rows.columns else F.monotonically_increasing_id().alias("rid"), "key", "n", "sha", F.struct("recipe", "patch").alias("ids")), "recipes")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("key").alias("key"), F.col("rid").alias("rid"))).alias("best")
    groups = rows.groupBy("ids").agg(F.count(F.lit(1)).alias("size"), best).where("size > 1")
    groups = written(groups.select("ids", "size", F.col("best.key").alias("keep"), F.col("best.rid").alias("best")), "groups")
    alone = F.col("size").isNull()
    keep = F.when(alone, F.col("key")).otherwise(F.col("keep"))
    return rows.join(groups, "ids", "left").select(
        F.col("key").alias(key), keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"), (alone | (F.col("rid") == F.col("best"))).alias("kept"), F.col("sha").alias("text_sha256"), *([F.col("rid").alias(row)] if row else [])
    )


def op4_exact_dedup(spark, sf_dir):
    """Contract 4 over all documents."""
    return dedup_exact(documents(spark, sf_dir))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
k AS (SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
