"""The exact best rows for any number of profiles, both sides tables: blocked products, blocks that cannot win left out.

Rows are dealt to cells around a few pivots. How near a cell's farthest row is to its pivot bounds the cosine of a
profile with any row of the cell. A profile first meets the cells with the highest bounds that hold enough rows; its
score there at the last place is a threshold, and of the other cells it meets only those whose bound reaches it.

A cell is split into blocks of about ``block_rows`` rows, the profiles into parts of as many; a task multiplies one
block with one part, in slices, and passes on the ``n`` best rows of each profile. The driver sees the pivots and a
line per cell. How well bounds tell cells apart depends on the data; the result does not.

Defined cases: rows and profiles whose vector is null, or holds null or a number that is not finite, are left out; a
zero vector scores 0 on either side; equal scores go by key, a null key first; repeated rows are ranked one by one; fewer
than ``n`` rows are all listed. ``profiles`` holds a row per name. Vectors of different lengths are an error.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepost.functions.vectors import _as_lists, _as_matrix
from tidepost.operators.ranking import top_n_per_group
from tidepost.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIVOTS = 64
BLOCK_ROWS = 8192
SLICE = 256
# What rounding to hundredths can lift a score above its bound, and a little for the arithmetic.
SLACK = 0.011
NO_DIRECTION = -1


def _units(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Finite rows at unit length (zero vectors stay zero) and their positions in the batch."""
    rows, present = _as_matrix(vectors, width)
    finite = np.isfinite(rows).all(axis=1)
    rows, present = rows[finite], present[finite]
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0), present


def pick_pivots(docs: DataFrame, key: str, vector: str, pivots: int = PIVOTS) -> np.ndarray | None:
    """Directions of the rows with the smallest hashes of their keys; None where no row has a vector."""
    some = docs.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(key)).select(vector).limit(pivots).toArrow()
    if some.num_rows == 0:
        return None
    vectors = some.column(0).combine_chunks()
    width = len(vectors[0])
    units, _ = _units(vectors, width)
    units = units[units.any(axis=1)]
    return units if len(units) else np.eye(1, width)


def place(docs: DataFrame, centres: np.ndarray, key: str, vector: str) -> DataFrame:
    """(_key, cell, near, deal, unit): each row in the cell of its nearest pivot, with its cosine to it.

    ``deal`` spreads the rows of a cell over blocks, also where they share a key. Kept in the checkpoint folder.
    """
    width = centres.shape[1]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, present = _units(batch.column(1), width)
            cosines = rows @ centres.T
            cell, near = cosines.argmax(axis=1).astype(np.int32), cosines.max(axis=1, initial=-1.0)
            still = ~rows.any(axis=1)
            cell[still], near[still] = NO_DIRECTION, 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(present)), pa.array(cell), pa.array(near), _as_lists(rows, np.arange(len(rows)), len(rows))],
                ["_key", "cell", "near", "unit"])

    schema = T.StructType([T.StructField("_key", docs.schema[key].dataType), T.StructField("cell", T.IntegerType()),
                           T.StructField("near", T.DoubleType()), T.StructField("unit", T.ArrayType(T.DoubleType()))])
    rows = docs.select(F.col(key).alias("_key"), F.col(vector).alias("vector")).mapInArrow(placed, schema)
    return cut_lineage(rows.withColumn("deal", F.xxhash64(F.monotonically_increasing_id())))


def bounded(profiles: DataFrame, centres: np.ndarray, cells: list[tuple[int, int, float]], n: int, profile: str,
            vector: str) -> DataFrame:
    """(_profile, unit, homes, cells): per profile the cells by falling bound; the first ``homes`` hold ``n`` rows.

    ``cells``: number, rows and smallest cosine to the pivot of each cell that has rows.
    """
    width = centres.shape[1]
    numbers = np.array([c for c, _, _ in cells], np.int32)
    sizes = np.array([size for _, size, _ in cells], np.int64)
    radius = np.arccos(np.clip([low for _, _, low in cells], -1, 1))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, present = _units(batch.column(1), width)
            angles = np.arccos(np.clip(rows @ centres[np.maximum(numbers, 0)].T, -1, 1))
            upper = np.cos(np.maximum(angles - radius, 0))
            upper[:, numbers == NO_DIRECTION] = 0.0
            upper[~rows.any(axis=1)] = 0.0
            order = np.argsort(-upper, axis=1, kind="stable")
            homes = np.minimum((np.cumsum(sizes[order], axis=1) < n).sum(axis=1) + 1, len(numbers))
            everyone = np.arange(len(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(present)), _as_lists(rows, everyone, len(rows)), pa.array(homes, pa.int32()),
                 _as_lists(numbers[order], everyone, len(rows)), _as_lists(np.take_along_axis(upper, order, 1), everyone, len(rows))],
                ["_profile", "unit", "homes", "cell", "upper"])

    schema = T.StructType([T.StructField("_profile", profiles.schema[profile].dataType), T.StructField("unit", T.ArrayType(T.DoubleType())),
                           T.StructField("homes", T.IntegerType()), T.StructField("cell", T.ArrayType(T.IntegerType())),
                           T.StructField("upper", T.ArrayType(T.DoubleType()))])
    rows = profiles.select(F.col(profile).alias("_profile"), F.col(vector).alias("vector")).mapInArrow(measured, schema)
    return rows.select("_profile", "unit", "homes", F.arrays_zip("cell", "upper").alias("cells"))


def home_asks(asking: DataFrame) -> DataFrame:
    """(_profile, unit, cell): the cells that a profile meets first."""
    return asking.select("_profile", "unit", F.explode(F.slice("cells", F.lit(1), F.col("homes"))).alias("c")) \
        .select("_profile", "unit", F.col("c.cell").alias("cell"))


def other_asks(asking: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """(_profile, unit, cell): further cells whose bound reaches the score at a profile's last place."""
    floor = found.filter(F.col("rank") == n).select("_profile", F.col("score").alias("floor"))
    rest = F.slice("cells", F.col("homes") + 1, F.size("cells"))
    hopeful = F.filter(rest, lambda c: F.col("floor").isNull() | (c.upper * 100 + SLACK >= F.col("floor")))
    return asking.join(floor, "_profile", "left").select("_profile", "unit", F.explode(hopeful).alias("c")) \
        .select("_profile", "unit", F.col("c.cell").alias("cell"))


def products(placed: DataFrame, asks: DataFrame, blocks: Column, parts: int, n: int) -> DataFrame:
    """(_profile, _key, score): of each block the ``n`` best rows for each profile that asks for its cell."""

    def best(rows: pa.Table, asked: pa.Table) -> pa.Table:
        picked_rows, picked_asks, picked_scores = [], [], []
        if rows.num_rows and asked.num_rows:
            rows = rows.take(pc.sort_indices(rows, sort_keys=[("_key", "ascending")], null_placement="at_start"))
            left = rows.column("unit").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
            right = asked.column("unit").combine_chunks().flatten().to_numpy().reshape(asked.num_rows, -1)
            take = min(n, len(left))
            for at in range(0, len(right), SLICE):
                scores = np.round(right[at:at + SLICE] @ left.T * 100, 2) + 0.0  # no negative zero
                last = -np.partition(-scores, take - 1, axis=1)[:, take - 1:take]
                above, level = scores > last, scores == last
                level &= np.cumsum(level, axis=1) <= take - above.sum(axis=1, keepdims=True)
                which, row = np.nonzero(above | level)
                picked_asks.append(which + at)
                picked_rows.append(row)
                picked_scores.append(scores[which, row])
        none = [np.zeros(0, np.int64)]
        return pa.table({"_profile": asked.column("_profile").take(pa.array(np.concatenate(picked_asks or none))),
                         "_key": rows.column("_key").take(pa.array(np.concatenate(picked_rows or none))),
                         "score": pa.array(np.concatenate(picked_scores or none).astype(np.float64))})

    at = ["cell", "block", "part"]
    dealt = placed.withColumn("block", F.pmod("deal", blocks)) \
        .select("cell", "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "_key", "unit")
    wanted = asks.withColumn("part", F.pmod(F.xxhash64("_profile"), F.lit(parts)).cast("int")) \
        .select("cell", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "part", "_profile", "unit")
    # At most a row per cell and part, about one for a hundred profiles: rows of cells that no one asks for stay where they are.
    dealt = dealt.join(F.broadcast(wanted.select("cell", "part").distinct()), ["cell", "part"], "left_semi")
    schema = T.StructType([T.StructField("_profile", asks.schema["_profile"].dataType),
                           T.StructField("_key", placed.schema["_key"].dataType), T.StructField("score", T.DoubleType())])
    return dealt.groupBy(*at).cogroup(wanted.groupBy(*at)).applyInArrow(best, schema)


def best_matches(docs: DataFrame, profiles: DataFrame, n: int = 3, key: str = "job_id", profile: str = "profile",
                 vector: str = "embedding", pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(profile, rank, key, score): the ``n`` rows with the highest cosine (times 100, two decimals) for each profile."""
    centres = pick_pivots(docs, key, vector, pivots)
    if centres is None:
        return docs.sparkSession.createDataFrame([], T.StructType([
            T.StructField(profile, profiles.schema[profile].dataType), T.StructField("rank", T.IntegerType()),
            T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.DoubleType())]))
    placed = place(docs, centres, key, vector)
    cells = [tuple(r) for r in placed.groupBy("cell").agg(F.count("*"), F.min("near")).orderBy("cell").collect()]
    blocks = F.element_at(F.create_map(*[F.lit(x) for cell, size, _ in cells or [(NO_DIRECTION, 1, 0.0)]
                                         for x in (cell, -(-size // block_rows))]), F.col("cell")).cast("long")
    parts = max(-(-profiles.count() // block_rows), 1)
    asking = cut_lineage(bounded(profiles, centres, cells, n, profile, vector))
    order = [F.desc("score"), F.asc("_key")]
    first = cut_lineage(top_n_per_group(products(placed, home_asks(asking), blocks, parts, n), ["_profile"], order, n))
    more = products(placed, other_asks(asking, first, n), blocks, parts, n)
    return top_n_per_group(first.drop("rank").unionByName(more), ["_profile"], order, n).select(
        F.col("_profile").alias(profile), "rank", F.col("_key").alias(key), "score")
