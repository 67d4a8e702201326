"""Words of many texts at once, as numpy arrays: where they lie, and 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.empty(0, np.uint64), np.empty(0, np.uint64)]
#: Bytes that are worked on at once; a longer text is worked on by itself.
CHUNK = 1 << 20


def chunks(texts: Iterable[str | None], most: int = CHUNK) -> Iterator[list[bytes]]:
    """UTF-8 of the texts (null: empty) in lists of about ``most`` bytes."""
    held, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > most:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield held


def mixed64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0][:n], _powers[1][:n]


class Words:
    """buf: all bytes, with a line end after each text. start, end: of each word. doc: which text it is in. count, first: words of each text. hash: of each word's bytes."""

    def __init__(self, raws: list[bytes]):
        self.buf = np.frombuffer(b"\n".join([*raws, b""]), np.uint8)
        sizes = np.array([len(r) + 1 for r in raws], np.int64)
        self.doc_end = np.cumsum(sizes)
        self.doc_start = self.doc_end - sizes
        white = _WHITE[self.buf]
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        if len(white) and not white[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.doc_start)
        self.count = np.diff(np.append(self.first, len(self.start)))
        self.doc = np.repeat(np.arange(len(raws)), self.count)

    def hashes(self) -> np.ndarray:
        power, inverse = _grown(len(self.buf) + 1)
        total = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        return mixed64((total[self.end] - total[self.start]) * inverse[self.start])
