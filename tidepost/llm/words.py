"""Words of whole Arrow batches as numpy arrays: positions, hashes and runs of hashes.

A batch of texts is one block of UTF-8 bytes with offsets, so words of many documents are found and
hashed in a few passes over bytes. Texts are worked on in groups of about ``GROUP_BYTES``; a longer
text is a group of its own, never cut.

A word is a longest run of bytes outside ``[\\x20\\x09-\\x0D]``. Hashes are 64 bits wide and the same
on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_FACTOR = np.uint64(0x9E3779B97F4A7C55)
_GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_GOLDEN) + np.uint64(salt))


@lru_cache(maxsize=2)
def _byte_values(fold_case: bool) -> np.ndarray:
    values = seeds(256, 7)
    if fold_case:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, GROUP_BYTES + 1)
        _powers = np.cumprod(np.full(size, _FACTOR, np.uint64))
        _inverses = np.cumprod(np.full(size, pow(int(_FACTOR), -1, 1 << 64), np.uint64))
    return _powers, _inverses


@dataclass
class Group:
    """Some texts of a batch: ``data`` holds their bytes, text ``i`` is ``data[offsets[i]:offsets[i+1]]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def groups(texts: pa.Array, limit: int = GROUP_BYTES) -> Iterator[Group]:
    """All texts of the array in order; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    block = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield Group(at, block[ends[at]:ends[to]], ends[at:to + 1] - ends[at])
        at = to


@dataclass
class Words:
    """Word ``j`` has hash ``hashes[j]``; text ``i`` has words ``bounds[i]`` to ``bounds[i+1]``."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each word position and whether ``k`` words of its text begin there."""
        n = len(self.hashes)
        out = np.zeros(n, np.uint64)
        whole = np.zeros(n, bool)
        if n >= k:
            size = n - k + 1
            total = np.zeros(size, np.uint64)
            for j, factor in enumerate(seeds(k, 31)):
                total += mix(self.hashes[j:j + size] ^ factor) * (factor | np.uint64(1))
            out[:size] = mix(total)
            last = np.repeat(self.bounds[1:], self.counts())
            whole[:size] = np.arange(size) + k <= last[:size]
        return out, whole


def words(group: Group, fold_case: bool = False) -> Words:
    """The words of a group; ``fold_case`` takes A-Z as a-z."""
    data, n = group.data, len(group.data)
    inner = ~_WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[group.offsets] = True
    begins = inner.copy()
    begins[1:] &= ~inner[:-1] | edge[1:-1]
    closes = inner.copy()
    closes[:-1] &= ~inner[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    powers, inverses = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_values(fold_case)[data] * powers[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))
    return Words(starts, ends, hashes, np.searchsorted(starts, group.offsets))
