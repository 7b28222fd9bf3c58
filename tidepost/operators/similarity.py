"""Scoring documents against a small set of anchor profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepost.functions.vectors import cosine_scores, score_columns
from tidepost.operators.ranking import rank_by_score, top_n, top_n_per_group
from tidepost.settings import MAX_SCORE, SCORE_PREFIX


def anchor_vectors(profiles: DataFrame, name: str = "profile",
                   vector: str = "embedding") -> dict[str, list[float]]:
    """Profile name to vector, in name order. Profiles are configuration, a row each, not data."""
    rows = profiles.select(name, vector).collect()
    return {row[0]: [float(x) for x in row[1]] for row in sorted(rows, key=lambda row: row[0])}


def score_profiles(df: DataFrame, anchors: Mapping[str, Sequence[float]],
                   vector: str = "embedding") -> DataFrame:
    """``score_<profile>`` per profile and ``similarity_score``, the best of them."""
    names = list(anchors)
    scored = df.withColumn("_scores", cosine_scores(F.col(vector), [anchors[n] for n in names]))
    scored = scored.withColumns(score_columns(F.col("_scores"), names)).drop("_scores")
    usable = [F.nanvl(F.col(SCORE_PREFIX + n), F.lit(None)) for n in names]
    return scored.withColumn(MAX_SCORE, F.greatest(*usable) if len(usable) > 1 else usable[0])


def long_scores(scored: DataFrame, key: str, names: Sequence[str], with_best: bool = False) -> DataFrame:
    """(key, profile, score) rows, without the wide text; ``with_best`` adds the best score as a
    profile of its own."""
    columns = {n: SCORE_PREFIX + n for n in names} | ({MAX_SCORE: MAX_SCORE} if with_best else {})
    pairs = F.array(*[F.struct(F.lit(name).alias("profile"), F.col(column).alias("score"))
                      for name, column in columns.items()])
    return scored.select(key, F.inline(pairs))


def top_lists(long: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` best rows per profile, with their rank."""
    return top_n_per_group(long, ["profile"], [F.desc("score"), F.asc(key)], n)


def top_overall(scored: DataFrame, key: str, n: int = 10) -> DataFrame:
    return top_n(scored, [F.desc(MAX_SCORE), F.asc(key)], n)


def top_per_profile(scored: DataFrame, key: str, names: Sequence[str], n: int = 3) -> DataFrame:
    return top_lists(long_scores(scored, key, names), key, n)


def ranked(scored: DataFrame, key: str, threshold: float | None = 0.0) -> DataFrame:
    """At least one profile reaches the threshold; best first."""
    return rank_by_score(scored, MAX_SCORE, key, threshold)
