"""Vector codes of equal parts, with nearest entries looked up in memoised grid cells.

Components are scaled to integers, vectors cut into equal parts, and every part position has a codebook
that a fixed number of rounds refines. To find a part's nearest entry, the part is hashed to its coarse cell
(a box of a grid); per cell the entries that are not dominated across the box are kept: those whose least
distance to the box is no larger than the smallest of all largest distances. Only these are measured exactly.
Cells recur, so that a task works most of them out once; what a cell remembers follows from the codebook alone.

A round is one scan: tasks add up their parts per (position, entry), the sums are folded, and the driver
holds no more than the codebooks, ``parts x entries x width`` numbers whatever the number of rows.

Defined cases: a null vector, or one with a null or non-finite component, is dropped. Vectors shorter than the
longest one, or of a length that ``parts`` does not divide, are padded with zeros. Equal ids are separate rows;
a first codebook takes null ids last and equal ids by their vectors. With fewer rows than entries the codebook
is as long as there are rows. Scaled components beyond +-``LIMIT`` count as that number, since errors are longs. No
rows give no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidepost.llm.store import ship, written
from tidepost.llm.words import seeds

PARTS = 16
ENTRIES = 64
SCALE = 256
ROUNDS = 2
# With components up to this size the error of a vector of 64 components is still a long.
LIMIT = 1 << 27
# Cells that a task remembers for one part position before it starts anew, and numbers in one work array.
MEMO_CELLS = 1 << 13
WORK = 1 << 21


def kept_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there, with finite components only."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                      & (F.abs(x.cast("double")) < float("inf")))
    return df.filter(F.col(vector).isNotNull() & finite)


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """Components times ``scale``, rounded down."""
    low, high = F.lit(-float(LIMIT)), F.lit(float(LIMIT))
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * F.lit(float(scale)), high), low)))


@dataclass(frozen=True)
class Codebooks:
    """Entries as integers, indexed by part position, entry and position within the part."""

    entries: np.ndarray
    scale: int = SCALE

    @property
    def dims(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        """sha256 of all components, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class GridCells:
    """Nearest entries of one codebook. ``edge`` of the cells changes the work, never the result."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.edge = self._edge()
        self.rows: dict[bytes, int] = {}
        self.held = np.zeros((0, len(entries)), bool)

    def _edge(self) -> int:
        """A power of two near the usual distance of an entry from its nearest neighbour."""
        gaps = ((self.entries[:, None, :] - self.entries[None, :, :]).astype(float) ** 2).sum(axis=2)
        gaps[gaps == 0] = np.inf
        near = np.sqrt(gaps.min(axis=1))
        near = near[np.isfinite(near)]
        usual = float(np.median(near)) if len(near) else 1.0
        return 1 << max(int(np.log2(max(usual, 1.0))), 0)

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """Per cell, which entries are not dominated across its box."""
        low = (cells * self.edge)[:, None, :]
        high = low + (self.edge - 1)
        outside = np.maximum(np.maximum(low - self.entries, self.entries - high), 0)
        farthest = np.maximum(np.abs(self.entries - low), np.abs(self.entries - high))
        least, most = (outside * outside).sum(axis=2), (farthest * farthest).sum(axis=2)
        return least <= most.min(axis=1, keepdims=True)

    def masks(self, cells: np.ndarray) -> np.ndarray:
        """``candidates`` of every row's cell, through the memo."""
        hashes = (cells * seeds(cells.shape[1], 13).view(np.int64)).sum(axis=1)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if not np.array_equal(cells[first][which], cells):  # two cells of one hash
            _, first, which = np.unique(cells, axis=0, return_index=True, return_inverse=True)
        if len(self.rows) + len(first) > MEMO_CELLS:
            self.rows, self.held = {}, self.held[:0]
        keys = [x.tobytes() for x in cells[first]]
        new = [i for i, key in enumerate(keys) if key not in self.rows]
        if new:
            self.rows.update((keys[i], len(self.held) + j) for j, i in enumerate(new))
            self.held = np.concatenate([self.held, self.candidates(cells[first[new]])])
        return self.held[np.array([self.rows[key] for key in keys])][which.ravel()]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) per part; of equally near entries the first."""
        if parts.shape[1] == 0:
            return np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        masks = self.masks(np.floor_divide(parts, self.edge))
        row, entry = np.nonzero(masks)
        gap = parts[row] - self.entries[entry]
        distance = np.einsum("ij,ij->i", gap, gap)
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        best = np.minimum.reduceat(distance, starts)
        tied = np.where(distance == best[row], entry, len(self.entries))
        return np.minimum.reduceat(tied, starts), best


def _padded(column: pa.Array, dims: int) -> np.ndarray:
    """A column of integer lists as rows of ``dims`` numbers."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _assigned(batch: pa.RecordBatch, at: int, cells: list[GridCells]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, parts, entries, squared distances) over slices of a batch, arrays by row and part position."""
    width = cells[0].entries.shape[1]
    step = max(WORK // (len(cells[0].entries) * max(width, 1)), 1)
    for start in range(0, batch.num_rows, step):
        rows = _padded(batch.column(at).slice(start, step), len(cells) * width)
        parts = rows.reshape(len(rows), len(cells), width)
        found = [cell.nearest(parts[:, p, :]) for p, cell in enumerate(cells)]
        yield start, parts, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _sums(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(part, entry, n, s0..): how many parts each entry is nearest to, and their sums."""
    positions, entries, width = books.entries.shape
    table = books.entries

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [GridCells(table[p]) for p in range(positions)]
        n, total = np.zeros(positions * entries, np.int64), np.zeros((positions * entries, width), np.int64)
        for batch in batches:
            for _, parts, codes, _ in _assigned(batch, 0, cells):
                slot = (codes + np.arange(positions) * entries).ravel()
                n += np.bincount(slot, minlength=len(n))
                np.add.at(total, slot, parts.reshape(-1, width))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array((used // entries).astype(np.int32)), pa.array((used % entries).astype(np.int32)), pa.array(n[used]),
             *[pa.array(np.ascontiguousarray(total[used, j])) for j in range(width)]],
            ["part", "entry", "n", *[f"s{j}" for j in range(width)]])

    schema = ", ".join(["part int", "entry int", "n long", *[f"s{j} long" for j in range(width)]])
    return rows.mapInArrow(added, schema).groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col(f"s{j}").cast("decimal(20,0)")).alias(f"s{j}") for j in range(width)])


def fit(df: DataFrame, key: str, vector: str, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE,
        rounds: int = ROUNDS) -> Codebooks:
    """Codebooks that begin as the parts of the rows with the smallest keys, and are refined ``rounds`` times.

    Each round moves every entry to the mean, rounded down, of the parts nearest to it; an unused entry stays.
    """
    ship(df.sparkSession)
    rows = kept_vectors(df, vector).select(F.col(key).alias("key"), scaled(F.col(vector), scale).alias("vector"))
    longest = rows.agg(F.max(F.size("vector")).alias("n")).first().n or 0
    width = -(-longest // parts)
    first = rows.orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).collect()
    start = np.zeros((len(first), parts * width), np.int64)
    for i, row in enumerate(first):
        start[i, :len(row.vector)] = row.vector
    table = np.ascontiguousarray(start.reshape(len(first), parts, width).transpose(1, 0, 2))
    for _ in range(rounds if len(first) else 0):
        moved = table.copy()
        for row in _sums(rows.select("vector"), Codebooks(table, scale)).collect():
            moved[row.part, row.entry] = [int(row[f"s{j}"]) // row.n for j in range(width)]
        table = moved
    return Codebooks(table, scale)


def encode(df: DataFrame, key: str, vector: str, books: Codebooks, label: str | None = None) -> DataFrame:
    """(key, label, codes, error): entries by part position, and the squared distance to them."""
    ship(df.sparkSession)
    kept = kept_vectors(df, vector)
    kind = dict(df.dtypes)
    chosen = [F.col(key).alias("key"), (F.lit(None).cast("int") if label is None else F.col(label)).alias("label"),
              scaled(F.col(vector), books.scale).alias("vector")]
    table = books.entries

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [GridCells(t) for t in table]
        for batch in batches:
            for start, _, codes, distances in _assigned(batch, 2, cells):
                n = len(codes)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * codes.shape[1])
                lists = pa.ListArray.from_arrays(offsets, pa.array(codes.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, n), batch.column(1).slice(start, n), lists, pa.array(distances.sum(axis=1))],
                    ["key", "label", "codes", "error"])

    schema = f"key {kind[key]}, label {'int' if label is None else kind[label]}, codes array<int>, error long"
    if table.shape[1] == 0:
        return df.sparkSession.createDataFrame([], schema)
    return kept.select(*chosen).mapInArrow(coded, schema)


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """``codes`` rows with the ``vector`` that they stand for, in the scale of the input."""
    table, scale = books.entries, float(books.scale)
    names = codes.columns

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(names.index("codes")).flatten().to_numpy().reshape(batch.num_rows, table.shape[0])
            rows = table[np.arange(table.shape[0]), own].reshape(batch.num_rows, -1) / scale
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * rows.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))],
                                             [*names, "vector"])

    schema = ", ".join([f"`{c}` {t}" for c, t in codes.dtypes] + ["vector array<double>"])
    return codes.mapInArrow(vectors, schema)


def compress(df: DataFrame, key: str, vector: str, label: str, parts: int = PARTS, entries: int = ENTRIES,
             scale: int = SCALE, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """((key, label, codes, error, label_error), codebooks) of all kept rows.

    ``label_error`` adds up the errors of equal labels, missing ones together (null beyond a long). Sums per label are folded in
    the tasks, and written, so that their real size decides how they are joined back.
    """
    books = fit(df, key, vector, parts, entries, scale, rounds)
    codes = written(encode(df, key, vector, books, label), "vector-codes")
    sums = written(codes.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors")
    joined = codes.join(sums.withColumnRenamed("label", "_label"), F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.drop("_label"), books


def hex_codes(codes: Column) -> Column:
    """Two hexadecimal digits per code."""
    return F.lower(F.array_join(F.transform(codes, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
