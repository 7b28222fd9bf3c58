"""Mixing to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token weights are raked until their
sums by source, by language and by topic have the target shares of ``KEPT_SHARE`` of all tokens; a cell's
weight over its tokens is the probability with which its documents are kept. No document is repeated, so
a cell's weight is at most its tokens: what is too scarce for its target is kept whole, and all other
categories have their shares in expectation.

Categories without a target of their own are one category, ``OTHER``, that gets what the targets leave. Where
they leave nothing it keeps its own share of the tokens, and the targets divide the rest: having no target is
no reason to go. Only a target of 0, for a category or for ``OTHER`` by name, takes rows away. So the table of
cells is bounded by the targets given, whatever the input, and only that table (sums of all documents) comes
to the driver. Sums are folded before the shuffle.

Defined cases: null category is ``OTHER``; null or empty text has no tokens and goes with its cell's
probability, a cell without tokens is kept; targets of categories that hold no tokens are left out and the
rest scaled up; rows with one id are kept or dropped together; a null id is an id; no rows give no rows;
other columns stay, also when their names clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


OTHER = "(other)"
SWEEPS = 200
TOLERANCE = 1e-9
# Of all tokens, so many are kept if every category has enough.
KEPT_SHARE = 0.5
SEED = 20240101

# A document's topic is the first of these that its text shows.
TOPIC_PATTERNS = {
    "licence": r"(?i)\blicen[cs]ed?\b|copyright",
    "contact": r"\w@[\w-]++\.\w|\+?\d[\d ()-]{8,}\d",
}
PROSE = "prose"


@dataclass(frozen=True)
class Targets:
    """Shares of the kept tokens by source, language and topic; each adds up to at most 1.

    ``OTHER`` may be among them; without it, it gets the rest, or its own share if there is no rest.
    """

    source: dict[str, float] = field(default_factory=lambda: {f"src{i}": 0.05 for i in range(20)})
    lang: dict[str, float] = field(default_factory=lambda: {"en": 0.55, "fr": 0.17, "de": 0.17, "es": 0.11})
    topic: dict[str, float] = field(default_factory=lambda: {"licence": 0.03, "contact": 0.04, PROSE: 0.93})

    def margins(self) -> list[tuple[str, dict[str, float]]]:
        return [("source", self.source), ("lang", self.lang), ("topic", self.topic)]


def topic_of(text: Column) -> Column:
    out = F.lit(PROSE)
    for name, pattern in reversed(TOPIC_PATTERNS.items()):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def token_count(text: Column) -> Column:
    """Words, the unit of weight here."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _category(column: Column, targets: dict[str, float]) -> Column:
    return F.when(column.isin(list(targets)), column).otherwise(F.lit(OTHER))


def _shares(own: dict[str, float], targets: dict[str, float]) -> dict[str, float]:
    """The target share of each category of one margin, from its ``own`` share of the tokens."""
    if OTHER not in own or OTHER in targets:
        return {name: targets.get(name, 0.0) for name in own}
    left = 1.0 - sum(targets.values())
    if left > TOLERANCE:
        return {name: targets.get(name, left) for name in own}
    listed = sum(targets.get(name, 0.0) for name in own)
    return {name: own[OTHER] if name == OTHER else targets[name] / (listed or 1.0) * (1.0 - own[OTHER]) for name in own}


def rake(cells: dict[tuple[str, ...], float], targets: list[dict[str, float]],
         kept_share: float = 0.0) -> dict[tuple[str, ...], float]:
    """Weights of the cells whose sums along each margin have the target shares (total 1).

    Each sweep scales the cells to one margin after the other, until nothing moves. With a
    ``kept_share`` no weight exceeds what its cell can give to that share of all tokens.
    """
    keys = [k for k, v in cells.items() if v > 0]
    if not keys:
        return {}
    weights = np.array([cells[k] for k in keys], float)
    weights /= weights.sum()
    most = weights / kept_share if kept_share > 0 else np.full(len(weights), np.inf)
    margins = []
    for axis, shares in enumerate(targets):
        names = sorted({k[axis] for k in keys})
        own = {n: float(sum(w for k, w in zip(keys, weights, strict=True) if k[axis] == n)) for n in names}
        wanted = _shares(own, shares)
        share = np.array([wanted[n] for n in names])
        if share.sum() <= 0:
            continue
        index = {n: i for i, n in enumerate(names)}
        margins.append((np.array([index[k[axis]] for k in keys]), share / share.sum()))
    for _ in range(SWEEPS):
        before = weights.copy()
        for of, share in margins:
            sums = np.bincount(of, weights, len(share))
            weights = np.minimum(weights * (share / np.where(sums > 0, sums, 1))[of], most)
        if np.abs(weights - before).max() < TOLERANCE:
            break
    return dict(zip(keys, weights.tolist(), strict=True))


def calibrated(docs: DataFrame, targets: Targets, doc_id: str = "doc_id", text: str = "text", source: str = "source",
               lang: str = "lang", kept_share: float = KEPT_SHARE) -> DataFrame:
    """All columns of ``docs`` under positional names c0, c1, ..., and cell, n_tokens, probability, kept."""
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {n: F.col(f"c{names.index(n)}") for n in (doc_id, text, source, lang)}
    raw = {"source": at[source], "lang": at[lang], "topic": topic_of(F.coalesce(at[text], F.lit("")))}
    marked = flat.withColumns({**{name: _category(raw[name], shares) for name, shares in targets.margins()},
                               "n_tokens": token_count(at[text])})
    axes = [name for name, _ in targets.margins()]
    sums = marked.groupBy(*axes).agg(F.sum("n_tokens").alias("tokens")).collect()
    cells = {tuple(r[a] for a in axes): float(r.tokens) for r in sums}
    weights = rake(cells, [shares for _, shares in targets.margins()], kept_share)
    budget = kept_share * sum(cells.values())
    rates = {k: min(w * budget / cells[k], 1.0) for k, w in weights.items()}
    table = docs.sparkSession.createDataFrame(
        [(*k, float(rates.get(k, 1.0))) for k in cells] or [(*[OTHER] * len(axes), 1.0)],
        ", ".join(f"{a} string" for a in axes) + ", probability double")
    # A number in [0, 1) from the id alone: retries and repeated rows decide alike.
    draw = F.pmod(F.xxhash64(F.lit(SEED), at[doc_id].cast("string")), F.lit(1 << 40)) / float(1 << 40)
    return marked.join(F.broadcast(table), axes, "left").withColumn("kept", draw < F.col("probability"))


def mix(docs: DataFrame, targets: Targets | None = None) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns."""
    done = calibrated(docs, targets or Targets()).filter("kept")
    return done.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)])
