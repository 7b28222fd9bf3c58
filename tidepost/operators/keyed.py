"""Keyed-table semantics as joins: latest row per key, upsert, partial update, ingest skips.

Hot keys: rows of one key are folded by an aggregate, which combines before the shuffle, so a key
with a large share of all rows reaches its reducer as one row per map task. The joins then run on
keys that are unique on both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepost.settings import MAX_SCORE


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  last: bool = False) -> DataFrame:
    """One row per key: the one with the smallest (``last``: largest) ``order`` values.

    Among equals the hash of the whole row decides, so that runs agree.
    """
    pick = F.max_by if last else F.min_by
    chosen = pick(F.struct(*[F.col(c) for c in df.columns]),
                  F.struct(*[F.col(c) for c in order], F.xxhash64(*df.columns).alias("_tie")))
    return df.groupBy(*keys).agg(chosen.alias("_row")).select("_row.*")


def drop_duplicates_keep_first(df: DataFrame, subset: Sequence[str], ordinal: str,
                               keep: Sequence[str] | None = None) -> DataFrame:
    """Keep the first row (by ``ordinal``) of rows equal in ``subset``; NULL equals NULL.

    Grouping is by a digest of the subset, so that wide text is not carried as a shuffle key.
    ``keep`` names the columns wanted afterwards; only those are shuffled (default: all).
    """
    marked = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"),
                                  F.col(c).cast("string")), F.lit("-")) for c in subset]
    keep = list(df.columns if keep is None else keep)
    digest = F.sha2(F.concat_ws("|", *marked), 256).alias("_digest")
    keyed = df.select(digest, F.col(ordinal).alias("_ordinal"), *keep)
    return first_per_key(keyed, ["_digest"], ["_ordinal"]).select(*keep)


def _keys(incoming: DataFrame, key: str) -> DataFrame:
    """The distinct keys of a batch, read as one column: Spark can tell from the size of that
    column whether to broadcast it, and then does not move the store."""
    return incoming.select(key).distinct()


def upsert_replace(store: DataFrame, incoming: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Whole-row replace, last write wins; columns the new row lacks become NULL."""
    return replace_rows(store, first_per_key(incoming, [key], order, last=True), _keys(incoming, key), key)


def replace_rows(store: DataFrame, fresh: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """:func:`upsert_replace` by rows that are one per key already; ``keys`` are the keys they have."""
    kept = store.join(keys, key, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True).select(
        *store.columns, *[c for c in fresh.columns if c not in store.columns])


def update_columns(store: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Set the update's columns on the rows whose key it has (also to NULL); others stay.

    ``updates`` holds one row per key.
    """
    names = [c for c in updates.columns if c != key]
    patch = updates.select(key, F.struct(*names).alias("_set"))
    joined = store.join(patch, key, "left")
    return joined.select(*[
        F.when(F.col("_set").isNotNull(), F.col(f"_set.{c}")).otherwise(F.col(c)).alias(c)
        if c in names else F.col(c) for c in store.columns])


def _stored_hits(store: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored keys that an incoming batch mentions: the store is scanned for its key only, and
    not moved at all while the batch is small enough for Spark to broadcast."""
    return store.select(key).join(_keys(incoming, key), key, "left_semi")


def new_rows(incoming: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is not stored yet."""
    return incoming.join(_stored_hits(store, incoming, key), key, "left_anti")


def rows_to_fetch(incoming: DataFrame, store: DataFrame, key: str,
                  required: Sequence[str] = ("titles", "desc")) -> DataFrame:
    """Incoming rows that are not stored, or stored without all ``required`` texts."""
    complete = store
    for name in required:
        complete = complete.filter(F.length(F.col(name)) > 0)
    return new_rows(incoming, complete, key)


def unscored(store: DataFrame, score: str = MAX_SCORE) -> DataFrame:
    """Incremental scan: rows without a score."""
    return store.filter(F.col(score).isNull())
