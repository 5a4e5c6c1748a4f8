"""Operator 8, SimHash near-dedup: tiled exact comparison of fingerprints.

Distinct fingerprints are cut into tiles of equal bit counts (of the high and of the low
half). A pair of fingerprints within the radius differs by at most the radius in those
counts, so tile pairs beyond it are skipped and no pair is lost. The remaining tile pairs
are compared whole with numpy exclusive-or and bit counts; large ones are first cut
again by the counts of their four quarters. A task returns a spanning forest of the links
it found, never all pairs; components are then joined over all tasks.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; a
null key is never a component's name unless all its members have none; repeated rows
share a fingerprint; an empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.llm.common import documents, prepare, text_of, written
from namewright.llm.components import components

#: Seed of XXH64; a list row holds up to SUB fingerprints, a tile up to SUBS rows.
SEED, SUB, SUBS = 42, 512, 16
#: Tile pairs of more fingerprint pairs than this are cut by quarter counts.
FINE = 1 << 22


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash over word shingles, repeats included; zero if there is no word."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z alone are lowered, [\x20\x09-\x0D] alone split
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = np.array([digest(b" ".join(words), SEED)], np.uint64)
    else:
        hashes = np.fromiter((digest(b" ".join(w), SEED) for w in zip(*(words[i:] for i in range(shingle)), strict=False)), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str, text: str, shingle: int, row: str | None = None) -> DataFrame:
    def op(batches):
        for batch in batches:
            made = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64)), batch.column(2)], names=["key", "fp", "row"])

    own = F.col(row) if row else F.lit(None)
    return df.select(F.col(key).cast("bigint").alias("key"), text_of(text).alias("text"), own.cast("bigint").alias("row")).mapInArrow(op, "key bigint, fp bigint, row bigint")


class Forest:
    """Union-find over array positions, whole arrays of links at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def quarters(fps: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct bit counts of the four 16-bit quarters, and the positions that have each."""
    counts = np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int64)
    sigs, which = np.unique(counts @ np.array([1, 32, 1024, 32768]), return_inverse=True)
    order = np.argsort(which, kind="stable")
    return np.stack([sigs >> s & 31 for s in (0, 5, 10, 15)], 1), np.split(order, np.cumsum(np.bincount(which))[:-1])


def compare(a: np.ndarray, b: np.ndarray, radius: int, found) -> None:
    """Calls ``found(i, j)`` with positions in a and b of all pairs within the radius."""

    def whole(ia: np.ndarray, ib: np.ndarray) -> None:
        step, right = max(1, (1 << 20) // max(1, len(ib))), b[ib]
        for at in range(0, len(ia), step):
            i, j = np.nonzero(np.bitwise_count(a[ia[at : at + step], None] ^ right[None, :]) <= radius)
            if len(i):
                found(ia[at + i], ib[j])

    if len(a) * len(b) <= FINE:
        whole(np.arange(len(a)), np.arange(len(b)))
        return
    (sa, pa_), (sb, pb) = quarters(a), quarters(b)
    for i, sig in enumerate(sa):
        for j in np.flatnonzero(np.abs(sb - sig).sum(axis=1) <= radius):
            whole(pa_[i], pb[j])


def tile_links(fps: DataFrame, radius: int) -> DataFrame:
    """A spanning forest (a, b) of the links between the distinct ``fp`` of ``fps``."""
    spark = fps.sparkSession
    celled = fps.select("fp", F.bit_count(F.shiftrightunsigned("fp", 32)).alias("hi"), F.bit_count(F.col("fp").bitwiseAND(0xFFFFFFFF)).alias("lo"))
    cells = celled.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"))  # at most 33 x 33 rows
    known = spark.createDataFrame([(r["hi"], r["lo"], -(-r["n"] // SUB)) for r in cells.collect()], "hi int, lo int, subs int")
    sub = F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int")
    lists = celled.join(F.broadcast(known), ["hi", "lo"]).groupBy("hi", "lo", sub.alias("sub")).agg(F.collect_list("fp").alias("fps"))
    tiles = written(lists.groupBy("hi", "lo", F.floor(F.col("sub") / SUBS).alias("tile")).agg(F.flatten(F.collect_list("fps")).alias("fps")), "tiles")
    near = [(x, y) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) if abs(x) + abs(y) <= radius and (x, y) >= (0, 0)]
    left = tiles.select(F.col("hi").alias("h"), F.col("lo").alias("l"), F.col("tile").alias("t"))
    shift = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in near])).alias("d")
    other = tiles.select("hi", "lo", "tile")
    pairs = left.select("h", "l", "t", shift).withColumns({"hi": F.col("h") + F.col("d.x"), "lo": F.col("l") + F.col("d.y")}).join(other, ["hi", "lo"])
    pairs = pairs.where("d.x <> 0 or d.y <> 0 or t <= tile").drop("d")
    first = tiles.select(F.col("hi").alias("h"), F.col("lo").alias("l"), F.col("tile").alias("t"), F.col("fps").alias("one"))
    spread = pairs.join(first, ["h", "l", "t"]).join(tiles.withColumnRenamed("fps", "two"), ["hi", "lo", "tile"])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = spread.select("one", "two", ((F.col("h") == F.col("hi")) & (F.col("l") == F.col("lo")) & (F.col("t") == F.col("tile"))).alias("same")).repartition(4 * n)

    def op(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one, two = (batch.column(c)[row].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (0, 1))
                both = one if batch.column(2)[row].as_py() else np.concatenate([one, two])
                forest, shift = Forest(len(both)), len(both) - len(two)
                compare(one, two, radius, lambda i, j, f=forest, s=shift: f.link(i, j + s))
                child = np.flatnonzero(forest.root != np.arange(len(both)))
                if len(child):
                    yield pa.RecordBatch.from_arrays([pa.array(both[forest.root[child]].view(np.int64)), pa.array(both[child].view(np.int64))], names=["a", "b"])

    return spread.mapInArrow(op, "a bigint, b bigint")


def near_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3, row: str | None = None) -> DataFrame:
    """One row per input row: key, fingerprint (16 hex digits), component_id (smallest key reachable).

    If ``row`` names a unique row id, also that and ``kept``, true for one row of each
    component: the smallest key (null last), then the smallest row id.
    Texts are read once and never shuffled; all else works on distinct fingerprints.
    """
    prepare(df.sparkSession)
    rows = written(fingerprints(df, key, text, shingle, row), "fingerprints")
    best = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("first")
    fps = written(rows.groupBy("fp").agg(best, F.count(F.lit(1)).alias("n")), "distinct")
    links = written(tile_links(fps.select("fp"), radius), "tile-links")
    labels = components(links).select(F.col("node").alias("fp"), "label")
    named = fps.join(labels, "fp", "left").where("label is not null or n > 1").withColumn("label", F.coalesce("label", "fp"))
    named = written(named, "named")
    lowest = named.groupBy("label").agg(F.min("first").alias("first"))
    classes = written(named.select("fp", "label").join(lowest, "label").select("fp", F.col("first.key").alias("component_id"), F.col("first.row").alias("best")), "classes")
    out = rows.join(classes, "fp", "left")
    ids = [F.col("row").alias(row), (F.coalesce("best", "row") == F.col("row")).alias("kept")] if row else []
    return out.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "key").alias("component_id"), *ids)


def op8_simhash(spark, sf_dir):
    """Contract 8 over all documents."""
    return near_dedup(documents(spark, sf_dir))
