"""Vectorised words and word n-grams of blocks of texts.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased: digits, a-z and every
character beyond ASCII. All texts of a block lie in one byte buffer; a word's hash is a difference of prefix
sums of a polynomial modulo 2**64, so nothing loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: Bytes of text that one block holds; a single longer text makes a block of its own.
BLOCK_BYTES = 1 << 20

_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:  # doubling: the next stretch is the first one times a power
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


_tables: dict[str, np.ndarray] = {}


def _tables_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(n, BLOCK_BYTES + 1024)
        _tables["up"], _tables["down"] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a hash: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(32))
    x *= _STEP
    x ^= x >> np.uint64(32)
    x *= _STEP
    x ^= x >> np.uint64(32)
    return x


class Words(NamedTuple):
    folded: bytes  # the block, lower-cased, everything else a space
    starts: np.ndarray  # of each word in ``folded``
    ends: np.ndarray
    hashes: np.ndarray  # uint64 of each word
    first: np.ndarray  # the first word of each text, and the number of words


def words(texts: list[bytes | None]) -> Words:
    block = b"\n".join(t or b"" for t in texts) + b"\n"
    folded = block.translate(_FOLD)
    raw = np.frombuffer(folded, np.uint8)
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[1:] = raw != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _tables_for(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[raw] * up[: len(raw)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))
    return Words(folded, starts, ends, hashes, np.searchsorted(starts, begins))


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (of the first word) and hashes of all runs of ``k`` words inside one text."""
    n = len(w.hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    acc = w.hashes[:n].copy()
    for j in range(1, k):
        acc *= _STEP
        acc += w.hashes[j : n + j]
    acc = mix(acc + np.uint64(k))
    of = np.searchsorted(w.first, np.arange(len(w.hashes)), "right")
    at = np.flatnonzero(of[:n] == of[k - 1 : n + k - 1])
    return at, acc[at]


def blocks(texts: list[bytes | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` bytes each."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) + 1 if t else 1
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)
