"""Persons in the order of the hash of a pair, against all pairs one by one."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from namewright.operators import hashes
from test_size import moved


def test_first_words_are_those_of_md5():
    rnd = np.random.default_rng(1)
    heads = [f"1|{x}|".encode() for x in [0, -5, 10**9, *rnd.integers(0, 10**7, 20)]]
    for tails in ([str(x).encode() for x in [0, 2**62, -(2**63), *rnd.integers(0, 10**6, 9000)]], [b"x" * 60, b"y"], []):
        want = np.array([[int.from_bytes(hashlib.md5(h + t).digest()[:4], "big") for t in tails] for h in heads], np.uint32).reshape(len(heads), len(tails))
        assert (hashes.hashed(heads, tails) == want).all()


@pytest.mark.parametrize("tile", [7, 8192])
def test_first_by_hash_in_tiles(spark, tile):
    slots = [(f"b{i % 3}", 100 + i, i % 40) for i in range(50)] + [("none", 900, 1)]
    persons = [(f"b{i % 3}", i) for i in range(40)] + [("alone", 99)]
    before, hashes.TILE = hashes.TILE, tile
    try:
        rows = hashes.first_by_hash(spark.createDataFrame(slots, "block string, pid bigint, true_aid bigint"), spark.createDataFrame(persons, "block string, aid bigint"), 9, 3).collect()
    finally:
        hashes.TILE = before
    want = {(pid, a) for block, pid, true in slots for a in sorted((a for b, a in persons if b == block and a != true), key=lambda a: hashlib.md5(f"3|{pid}|{a}".encode()).hexdigest())[:9]}
    assert {(r.pid, r.aid) for r in rows} == want and len(rows) == len(want)


@pytest.fixture(scope="module")
def one_block(spark, tmp_path_factory):
    """400 persons of one block with five papers each: 160,000 pairs."""
    at = str(tmp_path_factory.mktemp("one-block"))
    spark.range(400).select(F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey"), F.lit("x").alias("c_mktsegment")).write.parquet(f"{at}/customer.parquet")
    spark.range(2000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 400).alias("o_custkey"), F.timestamp_seconds(F.col("id") * 86400).alias("o_orderdate"), F.lit("v").alias("o_orderpriority")).write.parquet(f"{at}/orders.parquet")
    return at


@pytest.mark.parametrize("name,rows", [("r02_negatives", 3600), ("r05_nil_injection", 159_600)])
def test_no_pair_is_shuffled(spark, one_block, name, rows):
    """all pairs of a block's slots and persons were shuffled, R05's twice."""
    n, before = {}, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on tables too large for it
    try:
        records = moved(spark, lambda: n.update(rows=entry.queries()[name](spark, one_block).count()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert n["rows"] == rows and records < 40_000
