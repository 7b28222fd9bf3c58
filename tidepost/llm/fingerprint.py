"""Order MinHash: fingerprints that follow edit distance, also of each text's edited version.

The k-mers of a text are its runs of ``KMER`` words, numbered by occurrence so that a repeat counts as
an item of its own. For each of ``TUPLES`` orders the two smallest items are chosen, put back into
text order, and hashed to one cell of the fingerprint. With J the likeness of two item sets, a cell
agrees with probability J * J (less where shared items stand in another order), so the share p of equal
cells is reported as 2J / (1 + J), J = sqrt(p): the part of the items that the texts share.

A text is edited with the beginning of the document that follows it by id. Rows go once through a
shuffle by ranges of the id; the first row of a range goes to the range before as well, so each task
reads its rows in order and holds two at a time. The range bounds, one id per task, come from a shuffle
of the ids alone.

Defined cases: null text is empty; a text of fewer words than a k-mer is one item, a text without words
is one too (its white space); null ids come first; rows with equal ids follow each other by text; one
row follows itself; no rows give no rows; other columns are not carried, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepost.llm.words import groups, mix, seeds, words

KMER = 3
TUPLES = 96
_BLOCK = 1 << 12

_STEP = np.uint64(0xD6E8FEB86659FD93)
_ORDERS = (seeds(TUPLES, 11) | np.uint64(1)).astype(np.uint32)[:, None]
_SHIFTS = seeds(TUPLES, 12).astype(np.uint32)[:, None]
_ROWS = np.arange(TUPLES)

SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _times_before(keys: np.ndarray) -> np.ndarray:
    """How often each key stood before."""
    times = np.zeros(len(keys), np.uint64)
    ordered = np.sort(keys)
    repeated = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(repeated):
        slot = np.minimum(np.searchsorted(repeated, keys), len(repeated) - 1)
        at = np.flatnonzero(repeated[slot] == keys)
        by = at[np.argsort(keys[at], kind="stable")]
        same = keys[by]
        first = np.concatenate([[True], same[1:] != same[:-1]])
        begin = np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
        times[by] = (np.arange(len(by)) - begin).astype(np.uint64)
    return times


def _smallest_two(items: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Per order the positions of the two smallest items, in text order (twice the same if there is one)."""
    short = (items >> np.uint64(32)).astype(np.uint32)
    best = np.full((TUPLES, 2), np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(short), _BLOCK):
        part = short[None, a:a + _BLOCK]
        ranks = space[:, :part.shape[1]]
        np.multiply(part, _ORDERS, out=ranks)
        ranks += _SHIFTS
        found = [best]
        for _ in range(2):
            at = ranks.argmin(axis=1)
            value = (ranks[_ROWS, at].astype(np.uint64) << np.uint64(32)) | (at + a).astype(np.uint64)
            ranks[_ROWS, at] = np.uint32(0xFFFFFFFF)
            found.append(value[:, None])
        best = np.sort(np.hstack(found), axis=1)[:, :2]
    at = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if len(items) == 1:
        at[:] = 0
    return np.sort(at, axis=1)


def cells(texts: pa.Array) -> np.ndarray:
    """The fingerprints of texts, ``TUPLES`` 16-bit cells each."""
    out = np.zeros((len(texts), TUPLES), np.uint16)
    space = np.zeros((TUPLES, _BLOCK), np.uint32)
    for group in groups(texts):
        found = words(group)
        hashes, whole = found.runs(KMER)
        of = np.repeat(np.arange(len(group), dtype=np.uint64), found.counts())
        times = _times_before(hashes ^ mix(of + np.uint64(1)))  # counted within each text
        items = np.where(times > 0, mix(hashes + times * np.uint64(0x9E3779B97F4A7C15)), hashes)
        for i in range(len(group)):
            a, b = found.bounds[i], found.bounds[i + 1]
            if b - a >= KMER:
                own = items[a:b - KMER + 1]
            else:
                own = mix(np.array([found.hashes[a:b].dot(seeds(b - a, 5)) + np.uint64(b - a)], np.uint64))
            at = _smallest_two(own, space)
            out[group.first + i] = (mix(own[at[:, 0]] * _STEP + mix(own[at[:, 1]])) >> np.uint64(48)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    jaccard = math.sqrt(np.count_nonzero(a == b) / TUPLES)
    return 2 * jaccard / (1 + jaccard)


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, then the row that follows them (``follower``; only the first one counts)."""
    import hashlib

    kept: tuple | None = None  # the row whose follower is not known yet: id, text, cells
    for batch in batches:
        own = np.array(batch.column("follower").to_pylist(), bool)
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        take = len(ids)
        if own.any():
            take = int(own.argmax()) + 1  # the first follower ends it
        marks = cells(pa.array(texts[:take], pa.large_string()))
        rows = ([kept] if kept else []) + list(zip(ids[:take], texts[:take], marks, strict=True))
        pairs = list(zip(rows, rows[1:], strict=False))
        changed = [edited(a[1], b[1]) for a, b in pairs]
        edits = cells(pa.array(changed, pa.large_string()))
        yield pa.RecordBatch.from_arrays([
            pa.array([a[0] for a, _ in pairs], pa.int64()),
            pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
            pa.array([a[2].astype(">u2").tobytes().hex() for a, _ in pairs], pa.string()),
            pa.array([e.astype(">u2").tobytes().hex() for e in edits], pa.string()),
            pa.array([likeness(a[2], e) for (a, _), e in zip(pairs, edits, strict=True)], pa.float64()),
            pa.array([likeness(a[2], b[2]) for a, b in pairs], pa.float64()),
        ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        if own.any():
            return
        kept = rows[-1] if rows else None


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: fingerprints of its text and its edited text, and their likeness."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = (rows.select("doc_id").filter("doc_id is not null").repartitionByRange(tasks, "doc_id")
              .groupBy(F.spark_partition_id().alias("range")).agg(F.min("doc_id").alias("low")))
    bounds = sorted(r.low for r in ranges.collect())
    own = F.coalesce(sum(((F.col("doc_id") >= b).cast("int") for b in bounds[1:]), F.lit(0)), F.lit(0))
    last = max(len(bounds) - 1, 0)
    heads = F.col("doc_id").isin(bounds[1:]) if len(bounds) > 1 else F.lit(False)
    first = F.col("doc_id").isNull() | (F.col("doc_id") == bounds[0]) if bounds else F.lit(True)
    places = F.array_compact(F.array(
        F.struct(own.alias("range"), F.lit(False).alias("follower")),
        F.when(first, F.struct(F.lit(last).alias("range"), F.lit(True).alias("follower"))),
        F.when(heads, F.struct((own - 1).alias("range"), F.lit(True).alias("follower")))))
    return (rows.select("doc_id", "text", F.inline(places))
            .repartitionById(last + 1, "range").drop("range")
            .sortWithinPartitions("follower", F.col("doc_id").asc_nulls_first(), "text")
            .mapInArrow(_fingerprint_rows, SCHEMA))
