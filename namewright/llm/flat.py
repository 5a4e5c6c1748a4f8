"""Tables of byte strings in one flat array, spelled out for many ids at once."""

from __future__ import annotations

import numpy as np


class Spelling:
    """The byte string of every id. ``of(ids)`` is all their strings joined, ``size[ids]`` their lengths."""

    def __init__(self, strings: list[bytes]):
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        before = np.cumsum(n) - n
        return self.flat[np.repeat(self.start[ids] - before, n) + np.arange(n.sum())]
