"""Hashed character n-grams of a text, as numpy arrays."""

from __future__ import annotations

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(text: str, sizes: tuple[int, ...], bits: int):
    """Yields, for each size, the ``bits``-bit hash of every run of that many characters.

    Characters are code points of the lower-cased text between two blanks, so that first
    and last letters count as word ends.
    """
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes[(codes >= 9) & (codes <= 13)] = 32
    key, have = codes, 1
    for n in range(2, max(sizes) + 1):
        if len(codes) < n:
            return
        key = key[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        have = n
        if have in sizes:
            yield ((key ^ (key >> np.uint64(32))) * MIX) >> np.uint64(64 - bits)
