"""The daily overlapping ingest as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidepost.operators.similarity import score_profiles
from tidepost.sources.keyed_table import KeyedTable

OVERLAP = "48 hours"
# Rows that a task holds while it folds the repeats of its part of a batch.
HELD_ROWS = 100_000


def posting_stream(spark: SparkSession, path: str, schema: T.StructType,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files below ``path`` as a stream."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def fold_repeats(rows: DataFrame, key: str, event_time: str, held_rows: int = HELD_ROWS) -> DataFrame:
    """In each task the latest row of a key, before anything is shuffled; of equal times the first.

    The latest stays, so that a late row never stands for one that is on time. Rows without a time all stay. A task
    that holds ``held_rows`` different keys passes them on and starts anew: a hot key then leaves it a few times more.
    """

    def latest(table: pa.Table) -> pa.Table:
        codes = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        times = table.column(event_time).combine_chunks()
        undated = times.is_null().to_numpy(zero_copy_only=False)
        order = np.lexsort((-times.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), undated, codes))
        ahead = np.concatenate([[True], codes[order][1:] != codes[order][:-1]])
        return table.take(pa.array(np.sort(order[ahead | undated[order]])))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if batch.num_rows:
                held = [latest(pa.concat_tables([*held, pa.Table.from_batches([batch])]))]
            if held and held[0].num_rows >= held_rows:
                yield from held.pop().to_batches()
        if held:
            yield from held.pop().to_batches()

    return rows.mapInArrow(folded, rows.schema)


def drop_repeats(stream: DataFrame, key: str, event_time: str, overlap: str = OVERLAP) -> DataFrame:
    """One row of a key within the overlap; rows later than the watermark are dropped.

    A batch's own repeats are folded in the tasks first, so that a hot key meets the state once per task.
    """
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return fold_repeats(timed, key, event_time).withWatermark(event_time, overlap).dropDuplicatesWithinWatermark([key])


def score_stream(stream: DataFrame, anchors: Mapping[str, Sequence[float]],
                 vector: str = "embedding") -> DataFrame:
    """Scores of arriving rows; nothing is kept between batches."""
    return score_profiles(stream, anchors, vector)


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is available now to Parquet."""
    return (stream.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path))


def upsert_stream(stream: DataFrame, table: KeyedTable, checkpoint: str, compact_every: int = 50,
                  prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> StreamingQuery:
    """Upsert each micro-batch, tagged with query id and number so that a retried batch counts once.

    The id is kept in the checkpoint: a restarted query goes on with it, another query, or one on a
    new checkpoint, has its own, so that no batch is taken for a different one. The table is folded every ``compact_every`` batches; in between a batch costs its own size.
    """

    def apply(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        table.upsert(prepare(batch), f"{query}.{number}")
        if number and number % compact_every == 0:
            table.compact()

    return (stream.writeStream.foreachBatch(apply).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
