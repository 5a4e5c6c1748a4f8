"""Operator 3, token-id output: Arrow stream files of equal-length sequences and masks.

The documents, in key order, form one long row of ids. It is cut by range of keys into
shards of a bounded number of ids; each shard is one Arrow IPC stream file whose record
batches hold two fixed-size lists: ``ids``, ``length`` values, and ``mask``, a bit for
each, 1 for a real id, eight to a byte. A memory-mapped file gives ids and mask of sequence
i without a copy: batch ``i // rows``, row ``i % rows``. A second small stream file per
shard says where each document starts.

Files have unique names and only those of successful tasks are listed in the manifest,
so a task that runs again after a lost executor does no harm.

Edge cases: null and empty texts are the end id alone; a null key sorts first; rows
that share a key are ordered by text; an empty table writes no shard; extra columns are
not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namewright.llm.common import documents, prepare, shared_dir, text_of, written
from namewright.llm.tokens import encoder

#: Sequences of a record batch, so that a batch is a few MB whatever the shard's size.
ROWS = 256
#: A shard is closed after the document with which it reaches so many ids.
SHARD = 1 << 24


def filesystem(uri: str):
    """pyarrow's file system and path of a folder's address; a bare path is local."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes ids as they come; at most one record batch is held."""

    def __init__(self, uri: str, length: int, width: str):
        self.fs, path = filesystem(uri)
        self.fs.create_dir(path, recursive=True)
        self.length, self.kind = length, np.dtype(width)
        self.name = f"shard-{uuid.uuid4().hex}"
        schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), length)), ("mask", pa.list_(pa.uint8(), -(-length // 8)))])
        self.sink = self.fs.open_output_stream(f"{path}/{self.name}.arrows")
        self.out = pa.ipc.new_stream(self.sink, schema)
        self.docs_sink = self.fs.open_output_stream(f"{path}/{self.name}.docs.arrows")
        self.docs = pa.ipc.new_stream(self.docs_sink, DOCS)
        self.schema, self.parts, self.held, self.total, self.keys, self.starts, self.sizes = schema, [], 0, 0, [], [], []

    def add(self, key, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.starts.append(self.total)
        self.sizes.append(len(ids))
        self.parts.append(ids.astype(self.kind))
        self.total += len(ids)
        self.held += len(ids)
        if len(self.keys) >= 10_000:
            self.note()
        if self.held >= ROWS * self.length:
            flat = np.concatenate(self.parts)
            whole = len(flat) // (ROWS * self.length) * ROWS * self.length
            for at in range(0, whole, ROWS * self.length):
                self.batch(flat[at : at + ROWS * self.length], ROWS * self.length)
            self.parts, self.held = [flat[whole:]], len(flat) - whole

    def batch(self, flat: np.ndarray, real: int) -> None:
        mask = np.packbits((np.arange(len(flat)) < real).reshape(-1, self.length), axis=1, bitorder="little")
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), n) for v, n in ((flat, self.length), (mask, mask.shape[1]))]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def note(self) -> None:
        self.docs.write_batch(pa.RecordBatch.from_arrays([pa.array(self.keys, pa.int64()), pa.array(self.starts, pa.int64()), pa.array(self.sizes, pa.int64())], schema=DOCS))
        self.keys, self.starts, self.sizes = [], [], []

    def close(self) -> dict:
        if self.held:
            flat = np.concatenate(self.parts)
            self.batch(np.pad(flat, (0, -len(flat) % self.length)), len(flat))
        self.note()
        for x in (self.out, self.docs, self.sink, self.docs_sink):
            x.close()
        return {"name": self.name, "n_tokens": self.total}


DOCS = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class Shard:
    """Random access to a written shard; a local file is memory-mapped and not copied, any other is read, SHARD ids at most and a document."""

    def __init__(self, uri: str, name: str):
        fs, path = filesystem(uri)
        at = f"{path}/{name}"
        local = fs.type_name == "local"
        self.source = pa.memory_map(f"{at}.arrows") if local else fs.open_input_file(f"{at}.arrows")
        reader = pa.ipc.open_stream(self.source)
        self.length = reader.schema.field("ids").type.list_size
        self.batches = list(reader)
        with fs.open_input_file(f"{at}.docs.arrows") as f:
            self.docs = pa.ipc.open_stream(f).read_all()

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask bits of sequence i, both views of the file; ``unpacked`` makes booleans of the bits."""
        batch, row = self.batches[i // ROWS], i % ROWS
        return tuple(x.values.to_numpy(zero_copy_only=True)[row * x.type.list_size : (row + 1) * x.type.list_size] for x in batch.columns)

    def unpacked(self, mask: np.ndarray) -> np.ndarray:
        return np.unpackbits(mask, count=self.length, bitorder="little").view(bool)

    def between(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of the shard's stream; within one batch a view."""
        per = ROWS * self.length
        views = [self.batches[b].column(0).values.to_numpy(zero_copy_only=True)[max(0, start - b * per) : stop - b * per] for b in range(start // per, -(-stop // per))]
        return views[0] if len(views) == 1 else np.concatenate([*views, np.zeros(0, np.uint16)])


def write_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", *, to: str | None = None, tokenizer_path: str | None = None, kind: str = "word", end_id: int = 2, length: int = 2048, width: str = "<u2", most: int = SHARD) -> tuple[str, DataFrame]:
    """Writes the shards to folder ``to`` and returns it with the manifest.

    ``width`` "<u2" holds vocabularies up to 65,536 ids, "<u4" any. One shuffle orders
    the texts by range of keys (ids would be as large); a task closes a shard and opens
    the next after SHARD ids. The manifest has a row per shard: shard, name, n_tokens, start.
    """
    spark = prepare(df.sparkSession)
    to = to or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"

    def op(batches):
        import public_tokenizers
        from pyspark import TaskContext

        ids_of = encoder(tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), kind)
        end, shard, closed = np.array([end_id], "<u4"), None, []
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = shard or ShardWriter(to, length, width)
                ids = np.concatenate([np.frombuffer(ids_of(t), "<u4"), end])
                if int(ids.max()) > np.iinfo(shard.kind).max:
                    raise ValueError(f"id {ids.max()} does not fit {width}")
                shard.add(k, ids)
                if shard.total >= most:
                    closed.append(shard.close())
                    shard = None
        if shard:
            closed.append(shard.close())
        if closed:
            rows = [x | {"shard": TaskContext.get().partitionId(), "place": i} for i, x in enumerate(closed)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("shard", pa.int64()), ("place", pa.int64()), ("name", pa.string()), ("n_tokens", pa.int64())]))

    rows = df.select(F.col(key).cast("bigint").alias("key"), text_of(text).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = rows.repartitionByRange(n, F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    manifest = written(made.mapInArrow(op, "shard bigint, place bigint, name string, n_tokens bigint"), "manifest")
    return to, placed(manifest)


def placed(manifest: DataFrame) -> DataFrame:
    """Numbers the shards of all tasks and gives each its start: (shard, name, n_tokens, start).

    Sums run within each task's shards and over the tasks' totals, a row for each range of
    keys; no list of shards is collected.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    tasks = manifest.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("of_task"))
    tasks = tasks.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shards_before"), F.coalesce(F.sum("of_task").over(before), F.lit(0)).alias("ids_before"))
    rows = manifest.withColumn("ids_within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(tasks, "shard")
    return rows.select((F.col("shards_before") + F.col("place")).alias("shard"), "name", "n_tokens", (F.col("ids_before") + F.col("ids_within")).alias("start"))


def read_tokens(uri: str, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document, from the files: key, start in the whole stream, n_tokens, ids_crc32."""

    def op(batches):
        for batch in batches:
            for r in batch.to_pylist():
                shard = Shard(uri, r["name"])
                for docs in shard.docs.to_batches(max_chunksize=10_000):
                    at, n = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    crc = [zlib.crc32(shard.between(a, a + m).astype("<u4").tobytes()) for a, m in zip(at, n, strict=True)]
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(at + r["start"], pa.int64()), docs.column(2), pa.array(crc, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

    shards = manifest.select("shard", "name", "start").repartition(max(1, min(manifest.count(), 10_000)), "shard")
    return shards.mapInArrow(op, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("key", key)


def op3_token_output(spark, sf_dir):
    """Contract 3 over all documents, read back from the files."""
    return read_tokens(*write_tokens(documents(spark, sf_dir)))
