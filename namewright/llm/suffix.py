"""Operator 5, suffix-array dedup: difference-cover sorting, distributed by the text itself.

Two equal strings of ``span`` bytes have the same smallest hashed gram (their anchor).
So every text is cut, wherever the anchor of the running ``span``-byte string changes,
into overlapping snippets, and every pair of equal strings lies in snippets of equal
anchors. Four steps, each a shuffle or a read of the texts part by part:

1. Anchors are counted by bucket; those of one document alone hold no repeat and are left
   out (five bytes an anchor and part).
2. The other snippets meet by anchor, each distinct one once per part, with its smallest
   key. An anchor whose snippets are all equal is a repeat of that one snippet. Snippets of
   an anchor in several contexts are sorted: the bucket's suffixes are put in order by the
   difference-cover algorithm (sampled triples are sorted and named, the names sorted by
   recursion, the remaining suffixes merged in), adjacent suffixes are compared to ``span``
   bytes, and each run of equal prefixes takes its smallest key.
3. What was learned goes back to the parts that have the snippet: its smallest key, and the
   starts of strings that a still smaller key has.
4. Each text is cut again and loses what a smaller key has.

Buckets are cut by anchors and not by ranges of one global suffix order: a global order
would move some 80 bytes for each byte of repeated text, more than the disk a run may use,
and strings of different anchors are never equal, so no comparison is lost. An anchor in
more than HEAVY documents could outgrow a bucket; its snippets are cut into their single
strings, which meet by their own hashes over any number of buckets.

Edge cases: null and empty texts have no bytes; texts shorter than the span lose nothing
and lend nothing; a null key counts as smaller than all others; rows that share a key
never remove each other's bytes; an empty table gives an empty one; extra columns are
not read.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.llm.common import documents, prepare, shared_dir, text_of, written
from namewright.llm.tokenstore import filesystem

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Seed of the second hash, by which strings of heavy anchors are told apart.
SECOND = 0x51ED2701
#: Anchors in a bucket of the first shuffle, bytes of repeated text behind one of the second.
ANCHORS, BYTES = 500_000, 6_000_000
#: An anchor in more documents than this is compared string by string.
HEAVY = 50_000
#: Starts in a snippet, bits of a verdict.
STARTS = 32
#: Bytes of text that are hashed at once, and that a part gathers before it sends its distinct snippets.
CHUNK, GATHERED = 1 << 16, 1 << 24


# --- numpy: snippets and suffix sorting ---


def joined(left: np.ndarray, right: np.ndarray, by: int) -> np.ndarray:
    """Hashes of runs from the hashes of their first part and of the part ``by`` positions later."""
    n = max(0, min(len(left), len(right) - by))
    r = right[by : by + n]
    h = left[:n] * M1 + (r ^ (r >> np.uint64(29)))
    h ^= h >> np.uint64(32)
    h *= M2
    return h


def power_below(n: int) -> int:
    return 1 << (n.bit_length() - 1)


class Hashes:
    """Hashes of all runs of 1, 2, 4 ... bytes, and of any length by two overlapping ones."""

    def __init__(self, data: np.ndarray, longest: int, seed: int = 1):
        self.of = {1: (data.astype(np.uint64) + np.uint64(seed)) * M2}
        for n in (1 << i for i in range(1, power_below(longest).bit_length())):
            self.of[n] = joined(self.of[n // 2], self.of[n // 2], n // 2)

    def run(self, n: int) -> np.ndarray:
        p = power_below(n)
        return self.of[p] if p == n else joined(self.of[p], self.of[p], n - p)

    def strings(self, first: np.ndarray, size: np.ndarray, span: int) -> np.ndarray:
        """Hashes of the strings of ``size`` (span to span + STARTS - 1) bytes from ``first``."""
        p = power_below(span)
        blocks = -(-(span + STARTS - 1) // p)
        out = size.astype(np.uint64) * M2
        for i in range(blocks):
            x = self.of[p][first + (size - p) * i // (blocks - 1)]
            out = (out ^ (x >> np.uint64(31)) ^ x) * M1
            out ^= out >> np.uint64(29)
        return out


def chunked(texts: list[bytes]):
    """(first text, concatenated bytes, sizes) of consecutive texts of about CHUNK bytes together."""
    at, held = 0, []
    for i, t in enumerate(texts):
        held.append(t)
        if i + 1 == len(texts) or sum(map(len, held)) + len(texts[i + 1]) > CHUNK:
            yield at, np.frombuffer(b"".join(held), np.uint8), np.array([len(x) for x in held])
            at, held = i + 1, []


class Cut:
    """The snippets of a chunk: text (index in the chunk), first and last start, anchor; digests on demand."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, span: int):
        self.data, self.span = data, span
        gram = max(min(20, span), span - STARTS + 1)
        ends = np.cumsum(sizes)
        n = len(data) - span + 1
        empty = np.zeros(0, np.int64)
        self.text, self.first, self.last, self.anchor = empty, empty, empty, np.zeros(0, np.uint64)
        if n < 1:
            return
        self.hashes = Hashes(data, span)
        low, have, window = self.hashes.run(gram), 1, span - gram + 1
        while have < window:
            step = min(have, window - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        owner = np.repeat(np.arange(len(sizes)), sizes)[:n]
        valid = np.arange(span, span + n) <= ends[owner]
        new = np.ones(n, bool)
        new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        if (last - first >= STARTS).any():  # periodic text: one anchor for very long
            place = np.arange(n) - np.repeat(first, last - first + 1)
            first = np.flatnonzero(new | (place % STARTS == 0))
            last = np.append(first[1:], n) - 1
        kept = valid[first]
        self.first, last = first[kept], last[kept]
        self.text = owner[self.first]
        self.last = np.minimum(last, ends[self.text] - span)
        v = low[self.first]
        self.anchor = (v ^ (v >> np.uint64(31))) * M1

    def only(self, hit: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, first, last, anchor, digest) of the snippets ``hit``; those that are ``single`` as one for each of their strings."""
        some = hit & ~single
        text, first, last, anchor = (x[some] for x in (self.text, self.first, self.last, self.anchor))
        digest = self.hashes.strings(first, last - first + self.span, self.span) if len(first) else np.zeros(0, np.uint64)
        if single.any():
            n = (self.last - self.first + 1)[single]
            starts = np.repeat(self.first[single] - np.cumsum(n) + n, n) + np.arange(n.sum())
            width = np.full(len(starts), self.span)
            one, two = (h.strings(starts, width, self.span) for h in (self.hashes, Hashes(self.data, self.span, SECOND)))
            text, first, last, anchor, digest = (np.concatenate(x) for x in ((text, np.repeat(self.text[single], n)), (first, starts), (last, starts), (anchor, one), (digest, two)))
        return text, first, last, anchor, digest


def gathered(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of the strings of ``size`` from ``first``, one after the other."""
    out = []
    for at in range(0, len(first), 50_000):
        f, n = first[at : at + 50_000], size[at : at + 50_000]
        out.append(data[np.repeat(f - np.cumsum(n) + n, n) + np.arange(n.sum())])
    return np.concatenate(out) if out else data[:0]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of a non-negative integer array in order, by difference cover modulo 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    padded = np.concatenate([s.astype(np.int64) + 1, [0, 0, 0]])
    # One more sampled start where n = 1 (mod 3), so that every remaining suffix has a sampled neighbour.
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    names = named(padded[sample], padded[sample + 1], padded[sample + 2])
    if names.max() + 1 < len(sample):
        order = suffix_array(names)
        rank_of = np.empty(len(sample), np.int64)
        rank_of[order] = np.arange(len(sample))
    else:
        order, rank_of = np.empty(len(sample), np.int64), names  # all names differ
        order[names] = np.arange(len(sample))
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = rank_of + 1
    sampled = sample[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    width = len(sample) + 2
    rest = rest[np.argsort(padded[rest] * width + rank[rest + 1])]
    one, two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before_one = np.searchsorted(padded[one] * width + rank[one + 1], padded[rest] * width + rank[rest + 1])
    pair = named(np.concatenate([padded[two], padded[rest]]), np.concatenate([padded[two + 1], padded[rest + 1]]))
    before_two = np.searchsorted(pair[: len(two)] * width + rank[two + 2], pair[len(two) :] * width + rank[rest + 2])
    at = np.arange(len(rest)) + before_one + before_two
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[at] = False
    out[at], out[free] = rest, sampled
    return out


def named(*columns: np.ndarray) -> np.ndarray:
    """Dense names of tuples in their order."""
    top = max(int(c.max()) for c in columns) + 1
    if top ** len(columns) < 1 << 62:
        key = columns[0]
        for c in columns[1:]:
            key = key * top + c
    else:
        first = named(*columns[:-1])
        key = first * top + columns[-1]
    order = np.argsort(key)
    ordered = key[order]
    names = np.empty(len(key), np.int64)
    names[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
    return names


def smallest_keys(flat: np.ndarray, size: np.ndarray, keys: np.ndarray, span: int) -> np.ndarray:
    """For texts of ``size`` bytes, one after the other, and the start of each of their ``span``-byte strings: the smallest key of a text that has the string.

    One row per text and one column per start, as many as the longest text has; columns beyond a text are its own key.
    """
    ends = np.cumsum(size)
    starts = ends - size + np.arange(len(size))  # with a zero after each text
    owner = np.repeat(np.arange(len(size)), size + 1)
    s = np.zeros(len(flat) + len(size), np.int64)
    s[np.arange(len(flat)) + np.repeat(np.arange(len(size)), size)] = flat.astype(np.int64) + 1
    order = suffix_array(s)
    left = (starts + size)[owner] - np.arange(len(s))
    order = order[left[order] >= span]
    word = np.concatenate([np.maximum(s - 1, 0), np.zeros(8, np.int64)]).astype(np.uint64)
    eight = sum((word[i : i + len(s)] << np.uint64(8 * i) for i in range(8)), np.zeros(len(s), np.uint64))
    a, b = order[:-1], order[1:]
    same = np.ones(max(0, len(order) - 1), bool)
    for at in [*range(0, span - 7, 8), span - 8]:
        same &= eight[a + at] == eight[b + at]
    heads = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, np.int64)
    lowest = np.repeat(keys[:, None], int((size - span).max(initial=0)) + 1, axis=1)
    if len(order):
        found = np.minimum.reduceat(keys[owner[order]], heads)
        lowest[owner[order], order - starts[owner[order]]] = np.repeat(found, np.diff(np.append(heads, len(order))))
    return lowest


# --- the distributed operator ---


def side_table(uri: str, part: int) -> pa.Table | None:
    """The rows of one part of a table written by parts; any task can read it at any time."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, path = filesystem(uri)
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{path}/part={part}", allow_not_found=True)) if f.path.endswith(".parquet")]
    tables = [pq.read_table(f, filesystem=fs, partitioning=None) for f in found]
    return pa.concat_tables(tables) if tables else None


def by_part(df: DataFrame, name: str) -> str:
    """Writes a table in folders by part and returns its address."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.repartition("part").write.option("compression", "zstd").partitionBy("part").parquet(at)
    return at


def whole(table: pa.Table | None, column: str, kind) -> np.ndarray:
    """A column of packed arrays as one array."""
    return np.frombuffer(b"".join(x.as_py() for x in table[column]) if table is not None else b"", kind)


def bucketed(bucket: np.ndarray, *columns: np.ndarray):
    """(bucket, packed columns) for each run of equal buckets."""
    edges = np.append(heads_of(bucket), len(bucket))
    for a, b in zip(edges, edges[1:], strict=False):
        yield int(bucket[a]), *(c[a:b].tobytes() for c in columns)


def packed_rows(rows, schema: pa.Schema):
    """Record batches of rows given as tuples."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 256:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def by_text_parts(batches):
    """(part, other columns as lists, texts as bytes) of consecutive rows of one part."""
    for batch in batches:
        part = batch.column(0).to_numpy()
        edges = np.append(heads_of(part), len(part))
        for a, b in zip(edges, edges[1:], strict=False):
            more = [c.slice(a, b - a).to_pylist() for c in batch.columns[1:]]
            yield int(part[a]), more[:-1], [t.encode("utf-8", "surrogatepass") for t in more[-1]]


COUNTS = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("low", pa.binary()), ("times", pa.binary())])
OFFERS = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("anchor", pa.binary()), ("digest", pa.binary()), ("key", pa.binary()), ("size", pa.binary()), ("bytes", pa.binary())])
RESULT = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def repeated_anchors(docs: DataFrame, span: int, bits: int, heavy: int) -> str:
    """By part: the anchors, as bucket and 32 further bits, that two documents or more have, and whether more than ``heavy`` do."""

    def count(batches):
        held, part = [], None
        for p, _, texts in by_text_parts(batches):
            if held and (p != part or sum(map(len, held)) > 2_000_000):
                yield from packed_rows(counted(np.concatenate(held), part), COUNTS)
                held = []
            part = p
            for _, data, sizes in chunked(texts):
                cut = Cut(data, sizes, span)
                order = np.lexsort((cut.text, cut.anchor))
                v, t = cut.anchor[order], cut.text[order]
                held.append(v[np.concatenate([[True], (v[1:] != v[:-1]) | (t[1:] != t[:-1])])] if len(v) else v)  # once for each text
        if held:
            yield from packed_rows(counted(np.concatenate(held), part), COUNTS)

    def counted(v, part):
        found, times = np.unique(v >> np.uint64(64 - bits) << np.uint64(32) | v & np.uint64(0xFFFFFFFF), return_counts=True)
        code = np.ceil(np.log2(times)).astype(np.uint8)  # twice the count at most
        for bucket, low, often in bucketed(found >> np.uint64(32), found.astype(np.uint32), code):
            yield bucket, part, low, often

    def repeats(_, table):
        lows = [np.frombuffer(b.as_py(), np.uint32) for b in table["low"]]
        low = np.concatenate(lows)
        times = np.ldexp(1.0, np.frombuffer(b"".join(b.as_py() for b in table["times"]), np.uint8).astype(np.int32))
        order = np.argsort(low, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], low[order][1:] != low[order][:-1]]))
        total = np.empty(len(low))
        total[order] = np.repeat(np.add.reduceat(times[order], heads), np.diff(np.append(heads, len(low))))
        edges = np.cumsum([len(x) for x in lows])[:-1]
        kept = [(x[t >= 2].tobytes(), x[t > heavy].tobytes()) for x, t in zip(lows, np.split(total, edges), strict=True)]
        return pa.table({"part": table["part"], "bucket": table["bucket"], "low": pa.array([k[0] for k in kept], pa.binary()), "heavy": pa.array([k[1] for k in kept], pa.binary())})

    spread = docs.select("part", "text").mapInArrow(count, "bucket int, part int, low binary, times binary")
    return by_part(spread.groupBy("bucket").applyInArrow(repeats, "part int, bucket int, low binary, heavy binary").where("length(low) > 0"), "repeated-anchors")


class Known:
    """The repeated anchors of the part that is being read, and the heavy ones among them."""

    def __init__(self, uri: str, bits: int):
        self.uri, self.bits, self.part = uri, bits, None

    def of(self, part: int, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if part != self.part:
            table, self.part = side_table(self.uri, part), part
            high = [np.uint64(b.as_py()) << np.uint64(32) for b in table["bucket"]] if table is not None else []
            self.sets = [np.sort(np.concatenate([*(h | np.frombuffer(x.as_py(), np.uint32).astype(np.uint64) for h, x in zip(high, table[c], strict=True)), np.zeros(0, np.uint64)])) if high else np.zeros(0, np.uint64) for c in ("low", "heavy")]
        mine = anchor >> np.uint64(64 - self.bits) << np.uint64(32) | anchor & np.uint64(0xFFFFFFFF)
        return tuple(among(s, mine) >= 0 for s in self.sets)


def among(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Positions of values in an ordered array, -1 where absent."""
    if not len(ordered):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return np.where(ordered[at] == values, at, -1)


def verdicts(docs: DataFrame, repeated: str, span: int, bits: int, buckets: int) -> str:
    """By part: for each of its repeated snippets the smallest key that has it, and the starts (bits) of strings that a smaller key still has."""

    def offer(batches):
        known, held, part = Known(repeated, bits), [], None
        for p, (keys,), texts in by_text_parts(batches):
            if held and (p != part or sum(len(h[0]) for h in held) > GATHERED):
                yield from packed_rows(offered(held, part), OFFERS)
                held = []
            part = p
            for at, data, sizes in chunked(texts):
                cut = Cut(data, sizes, span)
                if len(cut.first):
                    hit, heavy = known.of(part, cut.anchor)
                    text, first, last, anchor, digest = cut.only(hit, heavy)
                    held.append((data, np.array(keys[at : at + len(sizes)], np.int64)[text], first, last - first + span, anchor, digest))
        if held:
            yield from packed_rows(offered(held, part), OFFERS)

    def offered(held, part):
        base = np.cumsum([0, *(len(h[0]) for h in held)])
        first = np.concatenate([h[2] + b for h, b in zip(held, base, strict=False)])
        key, size, anchor, digest = (np.concatenate([h[i] for h in held]) for i in (1, 3, 4, 5))
        data = np.concatenate([h[0] for h in held])
        order = np.lexsort((key, digest, anchor))
        order = order[heads_of(anchor[order], digest[order])]
        bucket = (anchor[order] >> np.uint64(16)) % np.uint64(buckets)
        order = order[np.argsort(bucket, kind="stable")]
        bucket = (anchor[order] >> np.uint64(16)) % np.uint64(buckets)
        flat, ends = gathered(data, first[order], size[order]), np.concatenate([[0], np.cumsum(size[order])])
        at = 0
        for b, a, d, k, n in bucketed(bucket, anchor[order], digest[order], key[order], size[order].astype(np.uint16)):
            to = at + len(a) // 8
            yield b, part, a, d, k, n, flat[ends[at] : ends[to]].tobytes()
            at = to

    def judge(_, table):
        anchor, digest, key, size = (whole(table, c, k) for c, k in (("anchor", np.uint64), ("digest", np.uint64), ("key", np.int64), ("size", np.uint16)))
        size = size.astype(np.int64)
        data = whole(table, "bytes", np.uint8)
        order = np.lexsort((key, digest, anchor))
        head = heads_of(anchor[order], digest[order])
        which = np.empty(len(anchor), np.int64)
        which[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(order))))
        first = order[head]  # a row for each distinct snippet, the one of its smallest key
        lowest, mask = key[first], np.zeros(len(first), np.uint32)
        same = anchor[first][1:] == anchor[first][:-1]
        several = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
        if len(several):
            rows = first[several]
            starts = np.cumsum(size) - size
            low = smallest_keys(gathered(data, starts[rows], size[rows]), size[rows], lowest[several], span)
            mask[several] = ((low < lowest[several, None]) << np.arange(low.shape[1], dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
        edges = np.cumsum([len(x.as_py()) // 8 for x in table["anchor"]])[:-1]
        split = [np.split(x, edges) for x in (anchor.astype(np.uint32), digest, lowest[which], mask[which])]
        return pa.table({"part": table["part"], **{c: pa.array([x.tobytes() for x in xs], pa.binary()) for c, xs in zip(("anchor", "digest", "lowest", "starts"), split, strict=True)}})

    sent = docs.select("part", "key", "text").mapInArrow(offer, "bucket int, part int, anchor binary, digest binary, key binary, size binary, bytes binary")
    return by_part(sent.groupBy("bucket").applyInArrow(judge, "part int, anchor binary, digest binary, lowest binary, starts binary"), "verdicts")


def heads_of(*columns: np.ndarray) -> np.ndarray:
    """Positions where a row differs from the one before."""
    n = len(columns[0])
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])) if n else np.zeros(0, np.int64)


def dedup_spans(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = 50, heavy: int = HEAVY) -> DataFrame:
    """One row per input row: key, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges, end exclusive). ``span`` is 20 at least."""
    spark = prepare(df.sparkSession)
    null_first = F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63)))
    docs = written(df.select(F.spark_partition_id().alias("part"), F.col(key).cast("bigint").alias("own"), null_first.alias("key"), text_of(text).alias("text")), "parts")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, math.ceil(math.log2(max(1, size / 16 / ANCHORS))))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BYTES))
    repeated = repeated_anchors(docs, span, bits, heavy)
    told = verdicts(docs, repeated, span, bits, buckets)

    def apply(batches):
        known, part, digests = Known(repeated, bits), None, np.zeros(0, np.uint64)
        for p, (owns, keys), texts in by_text_parts(batches):
            if p != part:
                part, table = p, side_table(told, p)
                digests = whole(table, "digest", np.uint64)
                order = np.argsort(digests)
                digests, anchors, lowest, starts = digests[order], whole(table, "anchor", np.uint32)[order], whole(table, "lowest", np.int64)[order], whole(table, "starts", np.uint32)[order]
            rows = []
            for at, data, sizes in chunked(texts):
                cut, marks = Cut(data, sizes, span), np.zeros(len(data) + 1, np.int32)
                if len(cut.first) and len(digests):
                    text_, first, last, anchor, digest = cut.only(*known.of(part, cut.anchor))
                    place = among(digests, digest)
                    ok = (place >= 0) & (anchors[place] == anchor.astype(np.uint32))
                    text_, first, last, place = text_[ok], first[ok], last[ok], place[ok]
                    mine = np.array(keys[at : at + len(sizes)], np.int64)[text_]
                    all_of = mine > lowest[place]
                    np.add.at(marks, first[all_of], 1)
                    np.add.at(marks, last[all_of] + span, -1)
                    some = np.flatnonzero(~all_of & (starts[place] > 0))
                    bit, of = np.nonzero(starts[place[some]] >> np.arange(STARTS, dtype=np.uint32)[:, None] & 1)
                    np.add.at(marks, first[some[of]] + bit, 1)
                    np.add.at(marks, first[some[of]] + bit + span, -1)
                gone = np.cumsum(marks[:-1]) > 0
                end = 0
                for i, n in enumerate(sizes.tolist()):
                    mine, own = gone[end : end + n], data[end : end + n]
                    a, b = runs(mine)
                    kept = hashlib.sha256(own[~mine].tobytes() if len(a) else own.tobytes()).hexdigest()
                    rows.append((owns[at + i], n, int((b - a).sum()), len(a), kept, [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]))
                    end += n
            yield from packed_rows(rows, RESULT)

    out = docs.select("part", "own", "key", "text").mapInArrow(apply, "key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:int,end:int>>")
    return out.withColumnRenamed("key", key)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions of the runs of true values, and the positions after their last."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def op5_suffix_dedup(spark, sf_dir):
    """Contract 5 over all documents."""
    return dedup_spans(documents(spark, sf_dir)).drop("spans")
