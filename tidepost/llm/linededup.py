"""Line dedup with two Bloom filters, for keys seen once and keys seen in two documents or more.

Every task fills the two filters for its documents; filters of tasks merge block by block (twice = either
twice or both once). Only lines that the merged second filter suspects are shuffled, as 16-byte digests, to
be counted exactly. The filter has ``FILTER_BITS`` bits whatever the input: it is what may be broadcast,
and a corpus too large for it only makes more lines suspects, never a wrong result.

A key is a line without white space at its ends and with A-Z in lower case. A key of at least ``MIN_CHARS``
code points in at least ``MIN_DOCS`` documents loses all its lines except in the largest doc_id that holds
it; repeats inside that document stay.

Defined cases: null or empty text is one empty line; rows with one doc_id are one document; a null id is a
document below all others; equal rows are treated alike; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tidepost.llm.bloom import Filters, merged_filter
from tidepost.llm.store import trimmed, written

MIN_CHARS = 20
MIN_DOCS = 3
FILTER_BITS = 1 << 27

_SPACES = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes | None:
    """The key of a line, or None if it is too short to count."""
    key = line.strip(_SPACES).lower()
    if len(key) < MIN_CHARS or (not key.isascii() and len(key.decode()) < MIN_CHARS):
        return None
    return key


def digests(text: str | None) -> list[bytes | None]:
    """Per line the digest of its key."""
    return [None if (key := line_key(line)) is None else xxhash.xxh3_128_digest(key)
            for line in (text or "").encode("utf-8").split(b"\n")]


def _twice_seen(docs: DataFrame, text: str, bits: int) -> bytes:
    """The filter of keys in two documents or more."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            found = [np.frombuffer(b"".join({d[:8] for d in digests(t) if d}), np.uint64)
                     for t in batch.column(0).to_pylist()]
            if found:
                yield np.concatenate(found)

    return merged_filter(docs.select(F.col(text).cast("string")), keys, bits, "twice")


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS,
               bits: int = FILTER_BITS) -> DataFrame:
    """The columns of ``docs`` but the text under positional names c0, c1, ..., and n_lines, n_dropped, kept_text."""
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    columns = flat.columns
    id_at, text_at = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    keyed = flat.withColumn("text_key", F.xxhash64(F.col(text_at).cast("string")))
    shared = docs.sparkSession.sparkContext.broadcast(_twice_seen(flat, text_at, bits))

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filters.reading(shared.value, bits)
        for batch in batches:
            rows, marks = [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                own = {d for d in digests(t) if d}
                rows.extend([i] * len(own))
                marks.extend(own)
            if not marks:
                continue
            keys = np.frombuffer(b"".join(marks), np.uint64)[::2]
            hit = np.flatnonzero(filters.suspects(np.ascontiguousarray(keys)))
            at = pa.array(np.array(rows, np.int64)[hit])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("text_key").take(at),
                 pa.array([marks[i] for i in hit], pa.binary())], ["doc_id", "text_key", "mark"])

    source = keyed.select(F.col(id_at).cast("long").alias("doc_id"), "text_key", F.col(text_at).cast("string").alias("text"))
    holders = written(source.mapInArrow(trimmed(suspected), "doc_id long, text_key long, mark binary"), "suspects")
    # As a table it is joined by its real size; a line of very many documents is then no more than a skewed join.
    repeated = written(holders.select("mark", "doc_id").distinct().groupBy("mark")
                       .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs), "repeated-lines")
    drops = written(holders.join(repeated.select("mark", "keeper"), "mark").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
                    .groupBy("doc_id", "text_key").agg(F.collect_set("mark").alias("marks"))
                    .withColumnRenamed("text_key", "drop_key"), "dropped-lines")
    joined = keyed.join(drops, F.col(id_at).cast("long").eqNullSafe(F.col("doc_id")) & (F.col("text_key") == F.col("drop_key")),
                        "left").select(*columns, "marks")

    others = [c for c in columns if c != text_at]

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, dropped, texts = [], [], []
            for t, marks in zip(batch.column(text_at).to_pylist(), batch.column("marks").to_pylist(), strict=True):
                lines = (t or "").split("\n")
                gone = set(marks or ())
                kept = [x for x, d in zip(lines, digests(t), strict=True) if d not in gone] if gone else lines
                counts.append(len(lines))
                dropped.append(len(lines) - len(kept))
                texts.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in others], pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()),
                 pa.array(texts, pa.string())], [*others, "n_lines", "n_dropped", "kept_text"])

    schema = StructType([f for f in flat.schema.fields if f.name != text_at]).add("n_lines", "long").add("n_dropped", "long").add("kept_text", "string")
    return joined.mapInArrow(trimmed(rebuilt), schema)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of their texts, ``n_chars`` made to fit; other columns as they are."""
    names = docs.columns
    done = drop_lines(docs, doc_id, text)
    new = {text: F.col("kept_text"), "n_chars": F.char_length("kept_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return done.select(*[new.get(n, F.col(f"c{i}")).alias(n) for i, n in enumerate(names)])
