"""Operator 11, vector code compression: nearest codebook entries by vantage-point trees.

Components become integers, vectors are cut into equal parts, each part position has a
codebook. In every round Spark tasks assign their rows' parts to nearest entries and hand on
one sum per entry; the sums over all tasks are the next codebook, a table of parts x entries
rows whatever the corpus. Assignment walks a vantage-point tree over the entries: an inner
node splits its entries by their distance from one of them and keeps the range of distances
on either side, rounded outwards; a branch is visited unless its bound is strictly above the
best distance so far; what is compared are whole squared distances in exact integers, ties
to the lower index. Queries walk the tree together, split at each node.

Squared distances stay below 2^53 for ordinary values, where a product of matrices in
doubles is exact; a batch with larger ones is computed in Python's integers.

Edge cases: rows whose vector is null, or holds a null or non-finite component, are left
out; equal vec_ids are ordered by their vectors, a null vec_id comes last; vectors of other
lengths are filled with zeros to the longest, rounded up to whole parts (empty ones are all
zeros); repeated rows each get a code; with fewer rows than entries the codebook is as short;
components are cut off at +-2^62 and errors at 2^63 - 1; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewright.llm.common import prepare, written

LEAF = 16
#: Components of the vectors that are coded at once.
GATHERED = 1 << 19
LIMIT, TOP = 1 << 62, (1 << 63) - 1
#: Below it, sums of squares and products of two components are exact in doubles for 2^12 components.
EXACT = 1 << 19


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` from all rows of ``y``, exact: in doubles if these hold the values, else in Python's integers."""
    if x.dtype == object:
        return ((x[:, None, :] - y[None, :, :]) ** 2).sum(2)
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)


def root(x: np.ndarray, to: float) -> np.ndarray:
    """The square root, rounded two steps towards ``to``."""
    return np.nextafter(np.nextafter(np.sqrt(np.asarray(x, np.float64)), to), to)


class Vantage:
    """A vantage-point tree over the rows of ``entries``; a node is ``LEAF`` entries at most, or one entry and the nearer and farther half of the others."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.top = self.node(np.arange(len(entries)))

    def node(self, of: np.ndarray):
        if len(of) <= LEAF:
            return np.sort(of)
        point, others = of[:1], of[1:]
        far = squares(self.entries[point], self.entries[others])[0]
        order = np.argsort(far, kind="stable")
        halves = np.array_split(order, 2)
        return point, [(self.node(others[h]), root(far[h[0]], -np.inf), root(far[h[-1]], np.inf)) for h in halves]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``x`` the index of its nearest entry, the lowest of equals, and the squared distance."""
        best = np.full(len(x), np.inf).astype(x.dtype)
        index = np.full(len(x), len(self.entries))
        self.visit(self.top, x, np.arange(len(x)), best, index)
        return index, best

    def compare(self, of: np.ndarray, x, rows, best, index) -> np.ndarray:
        far = squares(x[rows], self.entries[of])
        at = np.argmin(far, 1)
        least, entry = far[np.arange(len(rows)), at], of[at]
        better = ((least < best[rows]) | ((least == best[rows]) & (entry < index[rows]))).astype(bool)
        best[rows[better]], index[rows[better]] = least[better], entry[better]
        return least

    def visit(self, node, x, rows, best, index) -> None:
        if len(rows) == 0:
            return
        if isinstance(node, np.ndarray):
            self.compare(node, x, rows, best, index)
            return
        point, sides = node
        far = self.compare(point, x, rows, best, index)
        low, high = root(far, -np.inf), root(far, np.inf)
        bound = [np.nextafter(np.maximum(least - high, low - most), -np.inf) for _, least, most in sides]
        nearer = bound[0] <= bound[1]
        for side, own in ((0, nearer), (1, ~nearer)):
            self.visit(sides[side][0], x, rows[own], best, index)
        for side, own in ((0, ~nearer), (1, nearer)):
            self.visit(sides[side][0], x, rows[own & (bound[side] <= root(best[rows], np.inf))], best, index)


def integers(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every vector, filled with zeros to ``width``: doubles that hold whole numbers."""
    flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False), vectors.value_lengths().to_numpy()
    whole = np.clip(np.floor(flat * float(scale)), -float(LIMIT), float(LIMIT))
    if (sizes == width).all():
        return whole.reshape(len(sizes), width)
    out, starts = np.zeros((len(sizes), width)), np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(starts, sizes)] = whole
    return out


def exactly(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


class Book:
    """One part position's entries, with its tree for ordinary values and, where needed, that for large ones."""

    def __init__(self, entries: list[list[int]]):
        self.entries = np.array(entries, object).reshape(len(entries), len(entries[0]) if entries else 0)
        self.small = all(abs(v) < EXACT for v in self.entries.ravel())
        self.trees: dict = {}

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index, squared distance, and the rows as they were compared."""
        small = self.small and (np.abs(x).max(initial=0) < EXACT)
        if small not in self.trees:
            self.trees[small] = Vantage(self.entries.astype(np.float64) if small else self.entries)
        x = x if small else exactly(x)
        return *self.trees[small].nearest(x), x


def gathered(batches, width: int):
    """Batches put together to some ``GATHERED`` components: a tree is walked faster by many queries at once."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows * width >= GATHERED:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def kept(df: DataFrame, key: str, vector: str, label: str | None) -> DataFrame:
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    of_label: Column = F.col(label) if label else F.lit(None).cast("string")
    return df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"), of_label.alias("label")).where(F.col("vector").isNotNull() & finite)


def train(rows: DataFrame, width: int, parts: int, entries: int, rounds: int, scale: int) -> list[list[list[int]]]:
    """The codebooks: for each part position its entries' integers."""
    w = width // parts
    first = rows.orderBy(F.asc_nulls_last("key"), "vector").limit(entries).select("vector").toArrow()  # at most ``entries`` rows
    start = exactly(integers(first.column(0).combine_chunks(), width, scale))
    books = [[list(v[p * w : (p + 1) * w]) for v in start] for p in range(parts)]
    for _ in range(rounds):

        def op(batches, books=books):
            tables, n = [Book(b) for b in books], np.zeros((parts, len(books[0])), np.int64)
            total = np.zeros((parts, len(books[0]), w), np.int64)
            for batch in gathered(batches, width):
                x = integers(batch.column(0).combine_chunks(), width, scale)
                for p, table in enumerate(tables):
                    index, _, own = table.nearest(x[:, p * w : (p + 1) * w])
                    if own.dtype == object:
                        total = total.astype(object)
                    n[p] += np.bincount(index, minlength=n.shape[1])
                    np.add.at(total[p], index, own.astype(total.dtype))
            part, entry = np.nonzero(n)
            sums = [[Decimal(int(v)) for v in total[p, e]] for p, e in zip(part, entry, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(n[part, entry]), pa.array(sums, pa.list_(pa.decimal128(38, 0)))], ["part", "entry", "n", "sums"])

        of_tasks = rows.select("vector").mapInArrow(op, "part bigint, entry bigint, n bigint, sums array<decimal(38,0)>")
        sums = of_tasks.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(w)]).alias("sums"))
        books = [list(b) for b in books]
        for r in sums.collect():  # at most ``parts`` x ``entries`` rows
            books[r["part"]][r["entry"]] = [int(v) // r["n"] for v in r["sums"]]
    return books


def encode(rows: DataFrame, books: list[list[list[int]]], width: int, scale: int) -> DataFrame:
    """``key``, ``label``, ``code`` (one byte a part) and ``error``: the squared distances from the chosen entries, summed."""
    parts = len(books)
    w = width // parts

    def op(batches):
        tables = [Book(b) for b in books]
        for batch in gathered(batches, width):
            x = integers(batch.column(1).combine_chunks(), width, scale)
            found = [t.nearest(x[:, p * w : (p + 1) * w]) for p, t in enumerate(tables)]
            codes = np.stack([f[0] for f in found], 1).astype(np.uint8)
            errors = [min(sum(int(f[1][i]) for f in found), TOP) for i in range(len(x))]
            yield pa.RecordBatch.from_arrays([batch.column(0).combine_chunks(), batch.column(2).combine_chunks(), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors, pa.int64())], ["key", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.select("key", "vector", "label").mapInArrow(op, f"key {kinds['key']}, label {kinds['label']}, code binary, error bigint")


def decode(codes: DataFrame, books: list[list[list[int]]], scale: int = 1024, code: str = "code") -> DataFrame:
    """Adds ``vector``: the entries that a code names, as doubles (components of the scaled integers' middle)."""
    table = [[[(v + 0.5) / scale for v in e] for e in b] for b in books]

    def op(batches):
        arrays = [np.array(b) for b in table]
        for batch in batches:
            at = np.frombuffer(b"".join(batch.column(code).to_pylist()), np.uint8).reshape(batch.num_rows, len(arrays))
            vectors = np.concatenate([a[at[:, p]] for p, a in enumerate(arrays)], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(vectors), pa.list_(pa.float64()))], [*batch.schema.names, "vector"])

    return codes.mapInArrow(op, ", ".join(f"`{n}` {k}" for n, k in codes.dtypes) + ", vector array<double>")


def compressed(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """Per kept row ``key, code`` (two hex digits a part), ``error``, ``label_error`` (over its label) and ``codebooks_sha256``."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte a part: 1 to 256 entries")
    prepare(df.sparkSession)
    rows = kept(df, key, vector, label)
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    width = max(1, -(-(longest or 0) // parts)) * parts
    books = [[] for _ in range(parts)] if longest is None else train(rows, width, parts, entries, rounds, scale)
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    coded = written(encode(rows, books, width, scale), "vector-codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.least(total, F.lit(TOP).cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(F.col("key").alias(key), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_vector_codes(spark, sf_dir):
    """Contract 11 over all embeddings."""
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
