"""The incremental ranking run: score what is unscored, write back, report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepost.operators import keyed, similarity
from tidepost.operators.embedding import Embedder, embed_documents
from tidepost.session import cut_lineage
from tidepost.settings import MAX_SCORE, SCORE_PREFIX
from tidepost.sources.csv import write_report
from tidepost.sources.keyed_table import KeyedTable


_VECTOR = "_embedding"


def scored_rows(store: DataFrame, anchors: Mapping[str, Sequence[float]], embedder: Embedder | None = None,
                text: str = "desc") -> DataFrame:
    """The whole rows that have no score, with their scores."""
    todo = keyed.unscored(store)
    if embedder is None:
        return similarity.score_profiles(todo, anchors)
    return similarity.score_profiles(embed_documents(todo, embedder, text, _VECTOR), anchors, _VECTOR).drop(_VECTOR)


def score_unscored(store: DataFrame, anchors: Mapping[str, Sequence[float]], key: str = "job_id",
                   embedder: Embedder | None = None, text: str = "desc") -> DataFrame:
    """Scores of the rows that have none: (key, score_<profile>..., similarity_score).

    Rows bring an ``embedding`` column, or an embedder makes it from their text.
    """
    return scored_rows(store, anchors, embedder, text).select(key, *[SCORE_PREFIX + name for name in anchors], MAX_SCORE)


def report_rows(scored: DataFrame, key: str, names: Sequence[str], overall: int = 10,
                per_profile: int = 3) -> DataFrame:
    """(list, rank, key, score): the overall best and the best per profile.

    Both lists come out of one pass over the scores, the overall list being one more "profile".
    """
    lists = similarity.long_scores(scored, key, names, with_best=True)
    limit = F.when(F.col("profile") == MAX_SCORE, overall).otherwise(per_profile)
    top = similarity.top_lists(lists, key, max(overall, per_profile)).filter(F.col("rank") <= limit)
    return top.select(F.col("profile").alias("list"), "rank", key, "score")


@dataclass
class RankingRun:
    """Scores of one run, materialised once, and what was made of them."""

    scores: DataFrame
    report: DataFrame
    csv_path: str | None


def run(table: KeyedTable, anchors: Mapping[str, Sequence[float]], *, embedder: Embedder | None = None,
        report_folder: str | None = None, run_ts: str | None = None) -> RankingRun:
    """Score the unscored rows of a keyed table, update it, and report; nothing to do is fine.

    The scored rows are written once, as the table's next change, which counts when the report is there; report and
    scores are read from it, so that no text is joined to its scores again.
    """
    if report_folder is not None and run_ts is None:
        raise ValueError("a report needs an explicit run_ts")
    names, key = list(anchors), table.key
    columns = [*[SCORE_PREFIX + name for name in names], MAX_SCORE]
    scored = scored_rows(table.read(), anchors, embedder)
    # A row without a key is scored, but neither stored nor reported.
    keyless, with_key = scored.filter(F.col(key).isNull()), scored.filter(F.col(key).isNotNull())
    number, rows = table.stage(with_key)
    if rows.select(columns).dtypes != with_key.select(columns).dtypes:
        rows = with_key  # the table keeps scores in a type of its own; report and scores do not
    scores = cut_lineage(rows.select(key, *columns).unionByName(keyless.select(key, *columns)))
    csv_path = None
    if report_folder is not None:
        facts = [c for c in with_key.columns if c != key and c not in columns]
        ranked = similarity.ranked(rows.select(key, *facts, *columns), key, None)
        csv_path = write_report(ranked, report_folder, run_ts)
    table.publish(number)
    return RankingRun(scores, report_rows(scores, key, names), csv_path)
