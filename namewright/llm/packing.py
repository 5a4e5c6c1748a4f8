"""Operator 10, packing into sequences: best-fit decreasing over lengths.

A document longer than the sequence length is cut into full windows; what is left is an
item. Items of one length are interchangeable, so best-fit decreasing is planned on the
counts by length: for each length, longest first, a segment tree indexed by remaining
capacity finds the tightest open sequences, and whole runs of items are placed at once.
The plan has at most one row per (length, run), a number bounded by the sequence length
and not by the corpus; it is the same plan that one-by-one best-fit decreasing makes.
Documents then find their place by their rank among the items of their length: each task
numbers its items of a length, and running sums of the tasks' counts say where its numbers
begin, so no window holds the items of a length.

Edge cases: null and empty texts are the end id alone; a null key is kept; repeated rows
are separate documents; any text length is cut; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namewright.llm.common import documents, prepare, text_of, written
from namewright.llm.tokens import encoder

PIECES = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int64()), ("nth", pa.int64()), ("ids", pa.binary())])


def cut_pieces(df: DataFrame, key: str, text: str, tokenizer_path: str | None, kind: str, end_id: int, length: int, with_ids: bool) -> DataFrame:
    """Pieces of at most ``length`` ids, numbered by task and length; on demand with their ids as unsigned 32-bit little-endian bytes."""
    kinds = list(PIECES)[: None if with_ids else -1]

    def op(batches):
        import public_tokenizers
        from pyspark import TaskContext

        ids_of = encoder(tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), kind)
        end, step, seen, part = np.array([end_id], "<u4").tobytes(), 4 * length, [0] * (length + 1), TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = ids_of(t) + end
                for at in range(0, len(ids), step):
                    n = len(x := ids[at : at + step]) // 4
                    rows.append((k, at // 4, n, zlib.crc32(x), len(ids) // 4, part, seen[n], x))
                    seen[n] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=False)], schema=pa.schema(kinds))

    rows = df.select(F.col(key).cast("bigint").alias("key"), text_of(text).alias("text"))
    return rows.mapInArrow(op, ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'bigint'}" for f in kinds))


class Tightest:
    """A segment tree over capacities 0..n: the smallest capacity of at least x with an open sequence."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = self.leaves + capacity
        while at:
            self.open[at] += n
            at //= 2

    def find(self, least: int) -> int | None:
        at = self.leaves + least
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], length: int) -> list[tuple[int, int, int, int, int, int]]:
    """The plan: (length, first item, last item + 1, first sequence, items each, offset).

    Items first..last of the length go, ``each`` to a sequence one after the other, to the
    sequences from ``sequence`` on, starting at offset ``at``.
    """
    tree, runs, plan, made = Tightest(length), defaultdict(list), [], 0
    for size in sorted(counts, reverse=True):
        placed, total = 0, counts[size]
        while placed < total:
            room = tree.find(size)
            if room is None:
                first, have, room = made, -(-(total - placed) // (length // size)), length
                made += have
            else:
                first, have = runs[room].pop()
                tree.add(room, -have)
            each = room // size
            used = min(have, -(-(total - placed) // each))
            n = min(total - placed, used * each)
            plan.append((size, placed, placed + n, first, each, length - room))
            full, rest = divmod(n, each)
            for start, many, left in ((first, full, room - each * size), (first + full, int(rest > 0), room - rest * size), (first + used, have - used, room)):
                if many and left:
                    runs[left].append((start, many))
                    tree.add(left, many)
            placed += n
    return plan


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", *, tokenizer_path: str | None = None, kind: str = "byte", end_id: int = 0, length: int = 1024, with_ids: bool = False) -> DataFrame:
    """A row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` on demand.

    The pieces are written once. The driver sees one count a length, and the plan; both
    are bounded by the length, and the plan is the only data that is broadcast.
    """
    spark = prepare(df.sparkSession)
    pieces = written(cut_pieces(df, key, text, tokenizer_path, kind, end_id, length, with_ids), "pieces")
    counted = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")  # a row for each task that has the length
    before = written(counted.select("part", "length", "n", running.alias("before")), "before")
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    firsts = defaultdict(list)
    for row in best_fit_decreasing(counts, length):
        firsts[row[0]].append(row)
    shared = spark.sparkContext.broadcast(dict(firsts))

    def op(batches):
        tables = {size: np.array(rows) for size, rows in shared.value.items()}
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns, strict=True))
            size, item = col["length"].to_numpy(), col["item"].to_numpy()
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for s in np.unique(size):
                of, table = np.flatnonzero(size == s), tables[int(s)]
                run = table[np.searchsorted(table[:, 1], item[of], "right") - 1]
                within = item[of] - run[:, 1]
                sequence[of], offset[of] = run[:, 3] + within // run[:, 4], run[:, 5] + within % run[:, 4] * s
            made = {**{c: col[c] for c in kept}, "sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_pydict(made)

    kept = [c for c in pieces.columns if c not in ("part", "nth")]
    items = pieces.join(before.drop("n"), ["part", "length"]).select(*kept, (F.col("before") + F.col("nth")).alias("item"))
    return items.mapInArrow(op, "".join(f"{c} {'binary' if c == 'ids' else 'bigint'}, " for c in kept) + "sequence_id bigint, offset bigint")


def sequences(places: DataFrame, length: int = 1024) -> DataFrame:
    """The packed rows of pieces with ids: sequence_id, ids (int array), n_real, padded to ``length`` except at a power of two."""

    def op(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids = np.frombuffer(b"".join(x["ids"] for x in r["parts"]), "<u4").tolist()
                pad = 0 if len(ids) & (len(ids) - 1) == 0 else length - len(ids)
                rows.append({"sequence_id": r["sequence_id"], "ids": ids + [0] * pad, "n_real": len(ids)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("sequence_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_real", pa.int32())]))

    grouped = places.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # at most ``length`` ids each
    return grouped.mapInArrow(op, "sequence_id bigint, ids array<int>, n_real int")


def packed(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    return pack(df, key, text, **options).select(F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_packing(spark, sf_dir):
    """Contract 10 over all documents."""
    return packed(documents(spark, sf_dir))
