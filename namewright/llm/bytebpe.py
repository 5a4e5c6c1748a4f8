"""Operator 13, byte-level BPE encoding and decoding by a sentencepiece model made from the ranks.

A rank file lists byte strings by the order of their merges. Every byte becomes one
character of its own, so each entry becomes a piece of text; a sentencepiece BPE model is
serialised from these pieces, scored by negative rank, with identity normalisation and no
prefix or escape of blanks. Its merges then are those of the ranks: best score first, the
leftmost of equals. Texts are split by the tokenizer's pattern, every match is encoded
separately (a match that is an entry itself is that entry), and a bounded per-worker cache
keeps the ids of repeated matches. Decoding maps each id's piece back to its bytes.

Letters and numbers follow the Unicode version of the tiktoken library. Characters that
Python's own table does not assign are looked up there one by one and stand as a letter, a
number or a sign while the text is split.

Edge cases: null and empty texts have no ids and decode to no bytes; a null key is kept;
repeated rows are separate rows; a text of any length is encoded whole (its ids must fit
2 GB); an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.llm.common import WordIds, documents, prepare, text_of
from namewright.llm.flat import Spelling

#: Byte b is the character FIRST + b of a piece.
FIRST = 0x100
TO_PIECE = {b: FIRST + b for b in range(256)}
TO_BYTE = {FIRST + b: b for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(entry): int(rank) for entry, rank in map(bytes.split, f)}


def model_of(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model whose id of an entry is its rank; ranks must be 0, 1, 2 and so on."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    entries = sorted(ranks, key=ranks.get)
    if [ranks[e] for e in entries] != list(range(len(entries))):
        raise ValueError("ranks have to be consecutive from 0")
    model = proto.ModelProto()
    for rank, entry in enumerate(entries):
        model.pieces.add(piece=entry.decode("latin-1").translate(TO_PIECE), score=-float(rank))
    model.pieces.add(piece="<unk>", type=proto.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = proto.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(entries) + 1
    model.trainer_spec.unk_id = len(entries)
    spec = model.normalizer_spec
    spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


def unassigned() -> re.Pattern:
    """Matches characters that Python's Unicode table does not assign."""
    ranges, start = [], None
    for c in range(sys.maxunicode + 2):
        free = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
        if free and start is None:
            start = c
        elif not free and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile(f"[{''.join(ranges)}]")


@lru_cache(maxsize=2)
def splitter(pattern: str):
    """``pieces(text)``: the matches of the pattern, as the tiktoken library finds them."""
    import regex
    import tiktoken

    find, rare, one_byte = regex.compile(pattern).findall, unassigned(), {bytes([b]): b for b in range(256)}
    letter, number = (tiktoken.Encoding(c, pat_str=rf"\p{{{c}}}", mergeable_ranks=one_byte, special_tokens={}) for c in "LN")
    spans = regex.compile(pattern).finditer

    @lru_cache(maxsize=100_000)
    def stand_in(c: str) -> str:
        return "A" if letter.encode_ordinary(c) else "1" if number.encode_ordinary(c) else "#"

    def pieces(text: str) -> list[str]:
        if text.isascii() or not rare.search(text):
            return find(text)
        return [text[m.start() : m.end()] for m in spans(rare.sub(lambda m: stand_in(m[0]), text))]

    return pieces


@lru_cache(maxsize=2)
def codec(path: str, pattern: str):
    """``ids(text) -> bytes`` of unsigned 32-bit little-endian ids, and the spelling that decodes them."""
    from sentencepiece import SentencePieceProcessor

    ranks = read_ranks(path)
    model = SentencePieceProcessor(model_proto=model_of(ranks))
    pieces = splitter(pattern)

    def one(piece: str) -> bytes:
        raw = piece.encode()
        whole = ranks.get(raw)
        return np.array(model.encode(raw.decode("latin-1").translate(TO_PIECE)) if whole is None else [whole], "<u4").tobytes()

    known = WordIds(one)
    # No match holds a blank after its first character but for runs of white space: a blank between two other characters starts a match.
    chunks, cut, runs = WordIds(lambda chunk: b"".join(map(known.__getitem__, pieces(chunk))), 300_000), re.compile(r"(?<=\S)(?= \S)"), re.compile(r" \s|\s |^ | $|\x00")

    def ids(text: str) -> bytes:
        parts = cut.split(text) if runs.search(text) else text.replace(" ", "\x00 ").split("\x00")
        return b"".join(map(chunks.__getitem__, parts)) if text else b""

    return ids, Spelling([model.id_to_piece(i).translate(TO_BYTE).encode("latin-1") for i in range(len(ranks))])


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per row ``key`` and ``ids``: its tokens as unsigned 32-bit little-endian integers in one binary."""
    prepare(df.sparkSession)

    def op(batches):
        import public_tokenizers

        ids, _ = codec(ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ids(t) for t in batch.column(1).to_pylist()], pa.binary())], ["key", "ids"])

    rows = df.select(F.col(key).cast("bigint").alias("key"), text_of(text).alias("text"))
    return rows.mapInArrow(op, "key bigint, ids binary").select(F.col("key").alias(key), "ids")


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per row ``key``, ``ids`` and ``raw``: the bytes that the ids spell (null: none). An id outside the vocabulary is an error."""
    prepare(df.sparkSession)

    def op(batches):
        import public_tokenizers

        _, spelling = codec(ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
        for batch in batches:
            raw = [spelling.of(np.frombuffer(x or b"", "<u4")).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], ["key", "ids", "raw"])

    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(op, "key bigint, ids binary, raw binary").select(F.col("key").alias(key), F.col("ids").alias(ids), "raw")


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Encodes and decodes every text; per row the number of tokens and the digests of ids and decoded bytes."""
    back = decode(encode(df, key, text, **options), key, **options)
    return back.select(key, F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))


def op13_byte_bpe(spark, sf_dir):
    """Contract 13 over all documents."""
    return digests(documents(spark, sf_dir))
