"""Words and their 64-bit hashes for many texts at once, in numpy.

A text is cut at ASCII white space, as ``bytes.split`` does.  Hashes are the
same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
#: Bytes of text that are scanned at once, but for a single longer text.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers; one-to-one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo ``2 ** 64``, kept for the next call."""
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        size = max(n, 1 << 16)
        got = np.ones(size, np.uint64)
        have = 1
        while have < size:
            more = min(have, size - have)
            got[have:have + more] = got[:more] * np.uint64(pow(base, have, 1 << 64))
            have += more
        if n <= 2 * BLOCK:
            _POWERS[base] = got
    return got[:n]


class Words:
    """``doc`` (index of the text), ``start``, ``end`` (bytes of ``buf``) and ``hash`` of every word; ``first`` has each text's first word."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.n = len(texts)
        raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        self.buf = _LOWER[raw] if lower else raw
        blank = _BLANK[self.buf]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])
        self.first = np.searchsorted(self.start, begins)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.first))
        n = len(self.buf)
        run = np.empty(n + 1, np.uint64)
        run[0] = 0
        np.cumsum(_BYTES[self.buf] * powers(_STEP, n), out=run[1:])
        self.hash = mix((run[self.end] - run[self.start]) * powers(_BACK, n)[self.start])


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every run of ``size`` words of a text, in order."""
    n = len(words.hash)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        h += words.hash[k:n - size + 1 + k] * np.uint64(pow(_STEP, 2 * k + 1, 1 << 64))
    keep = words.doc[:n - size + 1] == words.doc[size - 1:]
    return words.doc[:n - size + 1][keep], mix(h[keep])


def blocks(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """``(from, to, texts)``: slices of the batch of about ``BLOCK`` bytes; null texts are empty."""
    column, at, held, size = batch.column(text).cast(pa.large_binary()), 0, [], 0
    for i, value in enumerate(column):
        got = value.as_py() or b""
        if held and size + len(got) > BLOCK:
            yield at, i, held
            at, held, size = i, [], 0
        held.append(got)
        size += len(got) + 1
    if held:
        yield at, len(column), held
