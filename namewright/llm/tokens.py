"""Exact and fast ids from the ``tokenizers`` library.

Both public vocabularies split a text into pieces before merging, and never merge
across pieces. Natural text repeats its words, so the ids of white-space-bounded
pieces are kept in a bounded per-worker cache; the library itself encodes every miss.
Texts where the cut could matter are encoded whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from namewright.llm.common import WordIds


@lru_cache(maxsize=4)
def encoder(path: str, kind: str):
    """``ids(text) -> bytes`` of unsigned 32-bit little-endian ids.

    ``kind`` "word": white space is dropped by the tokenizer, so any white space is a
    safe cut. ``kind`` "byte": a single space between two other non-white characters
    always starts a new piece, so it is a safe cut in front of the space.
    """
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    library = Tokenizer.from_file(path)
    specials = [t.content for t in library.get_added_tokens_decoder().values()]

    def plain(text: str) -> bytes:
        return np.asarray(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    # Runs of letters are one piece: the model takes them in the byte alphabet, without normalising and splitting again.
    letters = "".join(chr(c) for c in (32, *range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)))
    alphabet = {ord(c): ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0] for c in letters}
    model = library.model

    def run(piece: str) -> bytes:
        return np.array([x.id for x in model.tokenize(piece.translate(alphabet))], "<u4").tobytes()

    def one(piece: str) -> bytes:
        return run(piece) if only.fullmatch(piece) else plain(piece)

    # Letters up to U+00FF, single digits and runs of other ASCII marks are pieces of their own in both vocabularies.
    latin = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
    only = re.compile(rf"[{latin}]+" if kind == "word" else rf" ?[{latin}]+")
    known = WordIds(one, 500_000 if kind == "word" else 1_000_000)
    if kind == "word":
        part = re.compile(rf"[{latin}]+|[0-9]|[!-&(-/:-@\[-`{{-~]+")

        def whole(piece: str) -> bytes:
            low = piece.lower()
            if sum(map(len, parts := part.findall(low))) == len(low):
                return b"".join([known[x] for x in parts])
            return plain(piece)

        cache = WordIds(whole, 200_000)

        def ids(text: str) -> bytes:
            if any(s in text for s in specials):
                return plain(text)
            return b"".join(map(cache.__getitem__, text.replace("\n", " ").split(" "))) if text else b""

        return ids

    unsafe, cut = re.compile(r" \s|\s |^ | $"), re.compile(r"(?<=\S)(?= \S)")
    part = re.compile(rf" ?[{latin}]+| ?[0-9]+|[!-&(-/:-@\[-`{{-~]+|\n")

    def whole(piece: str) -> bytes:
        if "\n\n" not in piece and sum(map(len, parts := part.findall(piece))) == len(piece):
            return b"".join([known[x] for x in parts])
        return plain(piece)

    cache = WordIds(whole, 300_000)

    def ids(text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in specials):
            return plain(text)
        if unsafe.search(text) or "\x00" in text:
            return b"".join(map(cache.__getitem__, cut.split(text)))
        return b"".join(map(cache.__getitem__, text.replace(" ", "\x00 ").split("\x00")))

    return ids
