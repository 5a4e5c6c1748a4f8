"""Operator 12, cross-tokenizer alignment: where the tokens of two tokenizers meet.

A run of documents from an Arrow batch is laid end to end. The ends of both
tokenizers' tokens are byte offsets into it and are counted once each (bincount): an offset
that both have closes a group, an offset that either has closes exactly one link, because
the stretch before it lies in one token of each side. Running sums over the same offsets
give tokens their groups and links their tokens; read at the documents' bounds they give
every document its numbers back. Runs hold a
few MB of text (or one longer document), so memory follows the run and not the batch.

A document's links are kept as its distinct id pairs and their numbers. Pairs are counted
over documents: in a task first, then by pair, and marked if no other pair of their A id is
in more documents. Of the counts, a bounded number of the most frequent pairs is broadcast
(``most`` in all, whatever the corpus); the links of all other pairs are joined with their
counts row by row. So frequent pairs, which most links are, move nowhere, and no key of the
join is in more documents than the rarest broadcast pair.

Edge cases: null and empty texts, and texts whose token bytes differ from a blank and the
text, have no tokens, zeros and an empty digest; special tokens' strings are plain text; a
null key is kept; repeated rows are separate documents; a text of any length is aligned
whole; equal counts all are highest; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namewright.llm.common import WordIds, documents, prepare, text_of, written
from namewright.llm.flat import Spelling
from namewright.llm.tokens import encoder

#: Bytes of text that are aligned at once.
RUN = 1 << 22
#: Distinct pairs that a task holds before it hands on its counts.
HELD = 1 << 22

LINKED = pa.schema(
    [("row", pa.int64()), ("key", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())]
)


@lru_cache(maxsize=2)
def byte_side(path: str):
    """``ids(text) -> bytes`` of 32-bit ids of a byte-level BPE file, special strings as text, and the bytes of its entries."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    library, quick = Tokenizer.from_file(path), encoder(path, "byte")
    library.encode_special_tokens = True
    specials = [t.content for t in library.get_added_tokens_decoder().values()]

    def ids(text: str) -> bytes:
        if any(s in text for s in specials):
            return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return quick(text)

    # The byte alphabet: characters that print stand for themselves, the other bytes take the next characters from 256 on.
    byte_of, spare = {}, 256
    alphabet = set(ByteLevel.alphabet())
    for b in range(256):
        byte_of[chr(b) if chr(b) in alphabet else chr(spare)] = b
        spare += chr(b) not in alphabet
    entries = [library.id_to_token(i) or "" for i in range(library.get_vocab_size())]
    return ids, Spelling([bytes(byte_of[c] for c in e) if all(c in byte_of for c in e) else e.encode() for e in entries])


@lru_cache(maxsize=2)
def piece_side(path: str):
    """``ids(text) -> bytes`` of 32-bit ids of a sentencepiece file, and the bytes of its pieces.

    Where no piece holds a blank after another character, merges never cross such a blank,
    so the stretches between them are encoded separately and a bounded cache keeps them.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    blank = np.array([pieces.index("▁")], "<u4").tobytes()

    def plain(text: str) -> bytes:
        return np.array(model.encode(text), "<u4").tobytes()

    known = WordIds(lambda chunk: plain(chunk[1:]) if len(chunk) > 1 else blank, 500_000)
    cut, runs = re.compile(r"(?<=[^ ])(?= )"), re.compile("  | $|^ |\x00")
    separate = not any(re.search("[^▁]▁", p) for p in pieces)

    def ids(text: str) -> bytes:
        if not separate or "▁" in text:
            return plain(text)
        parts = cut.split(f" {text}") if runs.search(text) else f" {text}".replace(" ", "\x00 ").split("\x00")[1:]
        return b"".join(map(known.__getitem__, parts))

    return ids, Spelling([bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])


@lru_cache(maxsize=2)
def decimals(n: int) -> Spelling:
    """Every id in decimal digits and one byte for what follows it."""
    return Spelling([b"%d;" % i for i in range(n)])


def per_document(offsets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the ascending offsets lie in each document, whose last bytes' ends are ``bounds``."""
    return np.diff(np.searchsorted(offsets, bounds, "right"), prepend=0)


def align(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray, n_ids: int) -> dict[str, np.ndarray]:
    """Groups and links of documents laid end to end: ``sizes`` their bytes, ``a`` and ``b`` all their ids, ``len_*`` the ids' bytes."""
    bounds, ends_a, ends_b = np.cumsum(sizes), np.cumsum(len_a), np.cumsum(len_b)
    size = int(bounds[-1]) + 1
    in_a, in_b = (np.bincount(e, minlength=size).astype(np.uint8) for e in (ends_a, ends_b))
    ends, both = np.flatnonzero(in_a | in_b), in_a & in_b
    cuts, closed = np.flatnonzero(both), np.cumsum(both, dtype=np.int32)
    group_a, group_b = closed[ends_a] - both[ends_a], closed[ends_b] - both[ends_b]
    # How many tokens of the other side lie in the groups before, and in those up to, each group.
    in_group_a, in_group_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
    before_b, upto_a = np.cumsum(in_group_b) - in_group_b, np.cumsum(in_group_a)
    # All tokens in one row: group by group, A before B, each followed by the mark that separates it from the next.
    at_a, at_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + upto_a[group_b]
    merged, marks = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
    merged[at_a], merged[at_b] = a, b
    marks[at_a] = np.where(np.diff(group_a, append=-1) == 0, ord(","), ord("|"))
    marks[at_b] = np.where(np.diff(group_b, append=-1) == 0, ord(","), ord(";"))
    digits = decimals(n_ids)
    spelled, stops = digits.of(merged), np.cumsum(digits.size[merged])
    spelled[stops - 1] = marks
    tokens = np.cumsum(per_document(ends_a, bounds) + per_document(ends_b, bounds))
    first_a, first_b = (np.cumsum(x, dtype=np.int32) - x for x in (in_a, in_b))  # the token of either side that a stretch lies in
    return {
        "n_a": per_document(ends_a, bounds), "n_b": per_document(ends_b, bounds), "n_groups": per_document(cuts, bounds), "n_links": per_document(ends, bounds),
        "link_doc": np.repeat(np.arange(len(sizes)), per_document(ends, bounds)), "link_a": a[first_a[ends]].astype(np.int64), "link_b": b[first_b[ends]].astype(np.int64),
        "spelled": spelled, "stops": stops[tokens - 1] if len(tokens) else stops,
    }


def linked(df: DataFrame, key: str, text: str, byte_path: str | None, piece_path: str | None) -> DataFrame:
    """Per document its numbers and digest, and its distinct pairs (a * size of B + b, ascending, as differences) with their numbers of links."""
    prepare(df.sparkSession)

    def op(batches):
        import public_tokenizers
        from pyspark import TaskContext

        (ids_a, spell_a), (ids_b, spell_b) = byte_side(byte_path or public_tokenizers.path("byte_bpe_50k.json")), piece_side(piece_path or public_tokenizers.path("piece_bpe_32k.model"))
        n_ids, of_b, row = max(len(spell_a.size), len(spell_b.size)), len(spell_b.size), TaskContext.get().partitionId() << 33
        none = (0, 0, 0, 0, "", b"", b"")

        def tokens(text):
            if not text:
                return None
            raw, a, b = f" {text}".encode(), np.frombuffer(ids_a(f" {text}"), "<u4"), np.frombuffer(ids_b(text), "<u4")
            return (len(raw), a, b) if spell_a.of(a).tobytes() == raw == spell_b.of(b).tobytes() else None

        def flushed(run):
            found = [x for _, x in run if x]
            results = iter(())
            if found:
                a, b = (np.concatenate([x[i] for x in found]) for i in (1, 2))
                got = align(np.array([x[0] for x in found]), a, b, spell_a.size[a], spell_b.size[b], n_ids)
                all_pairs = len(spell_a.size) * of_b
                pair = np.sort(got["link_doc"] * all_pairs + got["link_a"] * of_b + got["link_b"])
                first = np.flatnonzero(np.diff(pair, prepend=-1))
                times, doc, pair = np.diff(first, append=len(pair)).astype("<u4"), pair // all_pairs, pair[first] % all_pairs
                to = np.searchsorted(doc[first], np.arange(len(found)), "right")
                spelled = got["spelled"].tobytes()

                def results_of():
                    since, begin = 0, 0
                    for i, stop in enumerate(got["stops"]):
                        numbers = [int(got[c][i]) for c in ("n_a", "n_b", "n_groups", "n_links")]
                        yield (*numbers, hashlib.sha256(spelled[begin : stop - 1]).hexdigest(), np.diff(pair[since : to[i]], prepend=0).astype("<i8").tobytes(), times[since : to[i]].tobytes())
                        since, begin = to[i], stop

                results = results_of()
            rows = [(row + i, k, *(next(results) if x else none)) for i, (k, x) in enumerate(run)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), LINKED, strict=True)], schema=LINKED)

        for batch in batches:
            run, held = [], 0
            for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = tokens(t)
                if run and held + (x[0] if x else 0) > RUN:
                    yield flushed(run)
                    row, run, held = row + len(run), [], 0
                run.append((k, x))
                held += x[0] if x else 0
            if run:
                yield flushed(run)
                row += len(run)

    rows = df.select(F.col(key).cast("bigint").alias("key"), text_of(text).alias("text"))
    return rows.mapInArrow(op, "row bigint, key bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary")


def link_counts(links: DataFrame, of_b: int) -> DataFrame:
    """Per id pair ``a_id``, ``b_id``: ``n_docs`` it is linked in, and ``best``: no pair of its A id is in more."""

    def op(batches):
        pairs, counts, fresh = np.empty(0, np.int64), np.empty(0, np.int64), []

        def merged():
            keys, where = np.unique(np.concatenate([pairs, *fresh]), return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, where, np.concatenate([counts, np.ones(sum(map(len, fresh)), np.int64)]))
            return keys, sums

        def out():
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])

        for batch in batches:
            for x in batch.column(0):
                fresh.append(np.cumsum(np.frombuffer(x.as_py(), "<i8")))
                if sum(map(len, fresh)) > HELD if len(fresh) % 64 == 0 else len(fresh[-1]) > HELD:
                    pairs, counts = merged()
                    fresh = []
                    if len(pairs) > HELD:
                        yield out()
                        pairs, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        if fresh:
            pairs, counts = merged()
        if len(pairs):
            yield out()

    summed = links.select("pairs").mapInArrow(op, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n_docs"))
    of_a = Window.partitionBy("a_id")  # at most one row for each id of B
    ids = summed.select(F.expr(f"pair div {of_b}").alias("a_id"), (F.col("pair") % of_b).alias("b_id"), "n_docs")
    return ids.withColumn("best", F.col("n_docs") == F.max("n_docs").over(of_a))


def frequent(counts: DataFrame, most: int) -> int:
    """The least ``n_docs`` from which on there are at most ``most`` pairs, found by counts over steps of an eighth of a doubling."""
    step = F.floor(F.log2("n_docs") * 8).cast("int")
    total, least = 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("n_docs").alias("least")).orderBy(F.desc("step")).collect():  # some 8 x 40 rows
        total += r["n"]
        if total > most:
            break
        least = r["least"]
    return 1 << 62 if least is None else least


def aligned(df: DataFrame, key: str = "doc_id", text: str = "text", byte_path: str | None = None, piece_path: str | None = None, most: int = 1 << 19) -> DataFrame:
    """Per document ``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` as contract 12 has them."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    spark = df.sparkSession
    of_b = SentencePieceProcessor(model_file=piece_path or public_tokenizers.path("piece_bpe_32k.model")).get_piece_size()
    links = written(linked(df, key, text, byte_path, piece_path), "links")
    counts = written(link_counts(links, of_b), "link-counts").withColumn("pair", F.col("a_id") * of_b + F.col("b_id"))
    least = frequent(counts, most)
    table = counts.where(F.col("n_docs") >= least).select("pair", "n_docs", "best").orderBy("pair").toArrow()  # at most ``most`` rows
    table = spark.sparkContext.broadcast(tuple(table.column(i).to_numpy() for i in range(3)))

    def op(batches):
        keys, n_docs, best = table.value
        keys = np.append(keys, np.int64(1 << 62))
        for batch in batches:
            rows = []
            for row, pairs, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pair, times = np.cumsum(np.frombuffer(pairs, "<i8")), np.frombuffer(times, "<u4").astype(np.int64)
                at = np.searchsorted(keys, pair)
                hit = keys[at] == pair
                here, n = at[hit], times[hit]
                rows.append((row, int(n[best[here]].sum()), int((n * n_docs[here]).sum()), pair[~hit], times[~hit]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["row", "n_best", "count_sum", "pairs", "times"])

    looked = written(links.select("row", "pairs", "times").mapInArrow(op, "row bigint, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>"), "links-counted")
    rest = looked.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    of_rest = rest.join(counts.where(F.col("n_docs") < least), "pair").select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n_docs")).alias("count_sum"))
    sums = looked.select("row", "n_best", "count_sum").unionByName(of_rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return links.join(sums, "row").select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_token_alignment(spark, sf_dir):
    """Contract 12 over all documents."""
    return aligned(documents(spark, sf_dir))
