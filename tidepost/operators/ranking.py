"""Sorting, top-k, crawl budgets and exact ranks that no single task has to hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepost.operators.keyed import first_per_key, new_rows
from tidepost.settings import PAGE_SIZE, SOURCE_CAP


def rank_by_score(df: DataFrame, score: str, tie: str, threshold: float | None = None) -> DataFrame:
    """Rows at or above the threshold, best first; ties by ``tie`` (also what splits hot scores
    between the ranges of the distributed sort)."""
    if threshold is not None:
        df = df.filter(F.col(score) >= threshold)
    return df.orderBy(F.desc(score), F.asc(tie))


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The ``n`` first rows by ``order``; each task sends its own ``n`` first rows at most."""
    return df.orderBy(*order).limit(n)


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The ``n`` first rows per group by ``order``, with their ``rank``.

    Spark limits each task's rows per group before the shuffle, so a hot group is cut down by all
    the tasks that hold it.
    """
    outer = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(outer)).filter(F.col("rank") <= n)


def crawl_budget(candidates: DataFrame, store: DataFrame, *, query: str, key: str,
                 order: Sequence[Column], max_pages: int, page_size: int = PAGE_SIZE,
                 source_cap: int = SOURCE_CAP) -> DataFrame:
    """What one crawl run would fetch per query.

    A query lists at most ``source_cap`` results; stored ones are skipped and do not count; the
    first ``max_pages * page_size`` of the rest are taken.
    """
    listed = top_n_per_group(candidates, [query], order, source_cap).drop("rank")
    fresh = new_rows(listed, store, key)
    return top_n_per_group(fresh, [query], order, max_pages * page_size)


def merge_queries(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row per key over overlapping queries: the query that comes first keeps it."""
    return first_per_key(df, [key], [ordinal])


def seeded_order(key: str, seed: int) -> Column:
    """A reproducible shuffle order: the md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def seeded_rank(df: DataFrame, group: str, key: str, seed: int, digits: int = 3) -> DataFrame:
    """Exact ``position`` (from 1) in seeded order within a group, and the ``group_size``.

    Ranks are taken within (group, leading hash digits), which are even whatever the group sizes
    are, and shifted by the sizes of the ranges before, of which there are 16**digits per group.
    """
    hashed = (df.withColumn("_hash", seeded_order(key, seed))
                .withColumn("_range", F.substring("_hash", 1, digits)))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (hashed.groupBy(group, "_range").agg(F.count("*").alias("_n"))
              .select(F.col(group).alias("_group"), F.col("_range").alias("_of"),
                      F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                      F.sum("_n").over(Window.partitionBy(group)).alias("group_size")))
    within = Window.partitionBy(group, "_range").orderBy("_hash", key)
    ranked = hashed.withColumn("_at", F.row_number().over(within))
    return (ranked.join(ranges, F.col(group).eqNullSafe(F.col("_group"))
                        & (F.col("_range") == F.col("_of")))
            .withColumn("position", (F.col("_before") + F.col("_at")).cast("long"))
            .drop("_hash", "_range", "_at", "_group", "_of", "_before"))


def stratified_holdout(df: DataFrame, label: str, key: str, seed: int = 0,
                       fraction: float = 0.25) -> DataFrame:
    """``is_test`` marks the given fraction of every class, in seeded order."""
    ranked = seeded_rank(df, label, key, seed)
    size = F.floor(F.col("group_size") * F.lit(fraction) + F.lit(0.5))
    return ranked.withColumn("is_test", F.col("position") <= size).drop("position", "group_size")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """``fold`` 0..folds-1, class sizes per fold equal but for one row."""
    ranked = seeded_rank(df, label, key, seed)
    size = F.expr(f"group_size div {folds}")
    larger = F.col("group_size") % folds
    in_larger = larger * (size + 1)
    fold = F.when(F.col("position") <= in_larger, F.floor((F.col("position") - 1) / (size + 1))) \
            .otherwise(larger + F.floor((F.col("position") - 1 - in_larger) / F.greatest(size, F.lit(1))))
    return ranked.withColumn("fold", fold.cast("int")).drop("position", "group_size")
