"""Bloom filters of fixed size over the keys of a table, for keys seen once and keys seen twice or more.

Tasks fill filters for their rows; they merge block by block (twice = either twice or both once). The size is
a parameter and does not follow the input, so the merged filter may be broadcast. Too many keys for it only
make it answer yes more often.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidepost.llm.store import trimmed

BLOCK_BITS = 1 << 16
PROBES = 2


class Filters:
    """Once-seen and twice-seen keys of some documents. Bits of a key lie in one block."""

    def __init__(self, bits: int):
        self.bits, self.block = bits, min(BLOCK_BITS, bits)
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def probes(self, keys: np.ndarray) -> np.ndarray:
        """Bit positions, one row per probe."""
        block = (keys >> np.uint64(40)) % np.uint64(self.bits // self.block)
        base = block * np.uint64(self.block)
        return np.stack([base + ((keys >> np.uint64(20 * p)) % np.uint64(self.block)) for p in range(PROBES)]).astype(np.int64)

    @staticmethod
    def _has(table: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)

    @staticmethod
    def _put(table: np.ndarray, at: np.ndarray) -> None:
        np.bitwise_or.at(table, (at >> 3).ravel(), (np.uint8(1) << (at & 7).astype(np.uint8)).ravel())

    def add(self, keys: np.ndarray) -> None:
        """``keys`` are those of whole documents, each once per document that holds it."""
        keys, counts = np.unique(keys, return_counts=True)
        at = self.probes(keys)
        again = self._has(self.once, at) | (counts > 1)
        self._put(self.twice, at[:, again])
        self._put(self.once, at)

    @classmethod
    def reading(cls, table: bytes, bits: int) -> Filters:
        """A merged filter to be asked by ``suspects``."""
        out = cls.__new__(cls)
        out.bits, out.block, out.twice = bits, min(BLOCK_BITS, bits), np.frombuffer(table, np.uint8)
        return out

    def suspects(self, keys: np.ndarray) -> np.ndarray:
        return self._has(self.twice, self.probes(keys))

    def blocks(self) -> Iterator[tuple[int, bytes, bytes]]:
        width = self.block // 8
        once, twice = self.once.reshape(-1, width), self.twice.reshape(-1, width)
        for i in np.flatnonzero(once.any(axis=1)):
            yield int(i), zlib.compress(once[i].tobytes(), 1), zlib.compress(twice[i].tobytes(), 1)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: one row per block with its once-seen and twice-seen bits."""
    now: int | None = None
    once = twice = np.zeros(0, np.uint8)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([now], pa.int32()), *[pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in (once, twice)]],
            ["block", "once", "twice"])

    for batch in batches:
        for block, a, b in zip(*[batch.column(c).to_pylist() for c in ("block", "once", "twice")], strict=True):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            if block == now:
                twice = twice | b | (once & a)
                once = once | a
            else:
                if now is not None:
                    yield done()
                now, once, twice = block, a, b
    if now is not None:
        yield done()


def merged_filter(rows: DataFrame, keys: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int,
                  kind: str) -> bytes:
    """The ``once`` or ``twice`` filter over all keys that ``keys`` draws from ``rows``: ``bits`` bits, no more."""

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filters(bits)
        for part in keys(batches):
            filters.add(part)
        found = list(filters.blocks())
        for a in range(0, len(found), 256):
            part = list(zip(*found[a:a + 256], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[0], pa.int32()), pa.array(part[1], pa.binary()), pa.array(part[2], pa.binary())],
                ["block", "once", "twice"])

    schema = "block int, once binary, twice binary"
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = (rows.mapInArrow(trimmed(filled), schema).repartition(tasks, "block").sortWithinPartitions("block")
              .mapInArrow(trimmed(_merged), schema).select("block", kind))
    width = min(BLOCK_BITS, bits) // 8
    table = np.zeros((bits // 8 // width, width), np.uint8)
    for row in merged.toLocalIterator():
        table[row[0]] = np.frombuffer(zlib.decompress(bytes(row[1])), np.uint8)
    return table.tobytes()


def key_filter(keys: DataFrame, bits: int) -> bytes:
    """A filter of all values of a table's one long column."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield batch.column(0).to_numpy().view(np.uint64)

    return merged_filter(keys, drawn, bits, "once")
