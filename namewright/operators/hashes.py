"""MD5 orders of pairs in numpy: which persons of its block come first for a slot, without a row per pair.

A pair's hash is that of ``seed|slot|person``, as ``ranking.hashed_order`` has it. The first
four bytes are computed for all pairs of two tiles at once; the whole hash only of those
that can be among the first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.operators.tiles import between, numbers

#: Pairs hashed at once, so that the arrays of a step stay in the cache of a core.
AT_ONCE = 1 << 13
#: Rows of a tile: a slot gives ``k`` rows for each tile of persons.
TILE = 8192
SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().astype(np.uint32)
#: The longest message of one MD5 block.
ONE_BLOCK = 55


def first_words(words: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The first four bytes of the MD5 of messages of one block, as a number in their order.

    ``words`` are the sixteen little-endian words of the padded block, each an array that
    broadcasts to ``shape``.
    """
    a, b, c, d = (np.full(shape, v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(61):  # the last three steps do not reach the first word
        if i < 16:
            k = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            k = (7 * i) % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, words[k] + SINES[i], out=f)
        np.left_shift(f, TURNS[i], out=g)
        np.right_shift(f, np.uint32(32) - TURNS[i], out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    return (b + np.uint32(0x67452301)).byteswap()


def as_words(texts: list[bytes], at: int) -> np.ndarray:
    """(word, text): the words of one block with each text at byte ``at``."""
    room = b"".join((b"\0" * at + t).ljust(64, b"\0") for t in texts)
    return np.ascontiguousarray(np.frombuffer(room, "<u4").reshape(len(texts), 16).T)


def hashed(heads: list[bytes], tails: list[bytes]) -> np.ndarray:
    """``first_words`` of every head followed by every tail."""
    out = np.empty((len(heads), len(tails)), np.uint32)
    if not heads or not tails:
        return out
    if max(map(len, heads)) + max(map(len, tails)) > ONE_BLOCK:
        for i, head in enumerate(heads):
            out[i] = [int.from_bytes(hashlib.md5(head + t).digest()[:4], "big") for t in tails]
        return out
    long = np.array([len(t) for t in tails], np.uint32)
    sizes = np.array([len(h) for h in heads])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        left = as_words([heads[i] for i in rows], 0)
        right = as_words([t + b"\x80" for t in tails], int(size))
        bits = ((long + np.uint32(size)) * np.uint32(8))[None, :]
        in_left, in_right = left.any(axis=1), right.any(axis=1)
        wide = -(-len(tails) // -(-len(tails) // AT_ONCE))  # equal parts
        step = max(1, AT_ONCE // wide)
        for start in range(0, len(rows), step):
            for first in range(0, len(tails), wide):
                at, of = rows[start : start + step], slice(first, first + wide)
                words = [left[k, start : start + step, None] if not in_right[k] else right[k][None, of] if not in_left[k] else left[k, start : start + step, None] | right[k][None, of] for k in range(16)]
                words[14] = bits[:, of]
                out[at, of] = first_words(words, (len(at), bits[:, of].shape[1]))
    return out


def first_by_hash(slots: DataFrame, persons: DataFrame, k: int, seed: int) -> DataFrame:
    """(pid, aid, order): the first ``k`` persons of the block other than ``true_aid``, by the hash of the pair and then aid.

    ``slots`` are (block, pid, true_aid), ``persons`` distinct (block, aid). What moves is
    ``k`` rows for each slot and tile of persons. Rows of one pid share its ``k`` places.
    """

    def judge(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, true = numbers(b, "aid"), numbers(a, "true_aid")
        heads = [f"{seed}|{x}|".encode() for x in a.column("pid").to_pylist()]
        tails = [str(x).encode() for x in b.column("aid").to_pylist()]
        some, slot, person, order = min(k + 1, len(tails)), [], [], []
        strip = max(1, (1 << 20) // len(tails))
        for start in range(0, len(heads), strip):
            words = hashed(heads[start : start + strip], tails)
            bound = np.partition(words, some - 1, axis=1)[:, some - 1]
            i, j = np.nonzero(words <= bound[:, None])
            i += start
            other = ids[j] != true[i]
            i, j = i[other], j[other]
            digests = [hashlib.md5(heads[x] + tails[y]).digest() for x, y in zip(i.tolist(), j.tolist(), strict=True)]
            by = np.lexsort((ids[j], np.array(digests, "S16"), i))
            kept = by[np.arange(len(i)) - np.searchsorted(i[by], i[by]) < k]
            slot.append(i[kept])
            person.append(j[kept])
            order += [digests[x] for x in kept.tolist()]
        i, j = (pa.array(np.concatenate(x)) for x in (slot, person))
        return pa.table({"pid": a.column("pid").take(i), "aid": b.column("aid").take(j), "order": pa.array(order, pa.binary())})

    kinds = f"pid {slots.schema['pid'].dataType.simpleString()}, aid {persons.schema['aid'].dataType.simpleString()}"
    parts = between(slots, persons, "block", ("pid", "aid"), TILE, judge, kinds + ", order binary")
    first = F.slice(F.array_sort(F.collect_list(F.struct("order", "aid"))), 1, k)
    return parts.groupBy("pid").agg(first.alias("first")).select("pid", F.explode("first").alias("one")).select("pid", "one.aid", "one.order")
