"""Quality rules, and verdicts on whole hosts from their documents' rule failures.

Measures of one document are taken in Arrow batches (no shuffle). The rule failures of a host are
sums, folded before the shuffle, so a host with a third of all rows costs no more than another. Its
failure rate is shrunk towards the mean of all hosts by a beta prior fitted to the hosts' rates by
moments; a host whose shrunk rate for a rule is too high is rejected and its documents go, also those
that keep the rules themselves.

Defined cases: null text has no words (and fails); null host is a host of its own; no rows give no
rows; repeated rows are judged alike; columns of the input that clash with results are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidepost.llm.store import trimmed, written
from tidepost.llm.words import Group, Words, groups, words

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# A host goes if its shrunk failure rate for a rule is over this.
MAX_HOST_RATE = 0.5
# Hosts' rates say nothing about the spread below this many hosts; then the prior weighs this much.
DEFAULT_PRIOR_WEIGHT = 20.0

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_SPACES = " \t\n\x0b\x0c\r"


def _repeat_words(group: Group, found: Words) -> np.ndarray:
    """Words inside windows that stand at least twice in their text."""
    hashes, whole = found.runs(WINDOW_WORDS)
    at = np.flatnonzero(whole)
    if len(at) == 0:
        return np.zeros(len(group), np.int64)
    text = np.repeat(np.arange(len(group), dtype=np.uint64), found.counts())[at]
    keys = hashes[at] ^ (text * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    covered = np.zeros(len(found.hashes) + 1, np.int32)
    if len(twice):
        slot = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        starts = at[twice[slot] == keys]
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + WINDOW_WORDS, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    return inside[found.bounds[1:]] - inside[found.bounds[:-1]]


def _dup_lines(raw: bytes) -> int:
    if b"\n" not in raw:
        return 0
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines))


def measure_batch(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measures of every text, in order."""
    parts: dict[str, list[np.ndarray]] = {name: [] for name in MEASURES}
    for group in groups(texts):
        found = words(group)
        inner = np.zeros(len(group.data), bool)
        steps = np.zeros(len(group.data) + 1, np.int8)
        steps[found.starts] += 1
        steps[found.ends] -= 1
        inner = np.cumsum(steps[:-1], dtype=np.int8) > 0
        raw = group.data.tobytes()
        parts["n_words"].append(found.counts())
        parts["word_chars"].append(group.per_text(inner & ((group.data & 0xC0) != 0x80)))
        parts["n_symbols"].append(group.per_text(_SYMBOL[group.data]))
        parts["n_dup_lines"].append(np.array([_dup_lines(raw[a:b]) for a, b in
                                              zip(group.offsets[:-1], group.offsets[1:], strict=True)], np.int64))
        parts["n_repeat_words"].append(_repeat_words(group, found))
    return {name: np.concatenate(p).astype(np.int64) if p else np.zeros(0, np.int64) for name, p in parts.items()}


def measures(docs: DataFrame, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """The columns of ``keep`` and the measures of each row's text; a text that is kept travels once."""
    read = text if text in keep and dict(docs.dtypes)[text] == "string" else "__text"
    columns = [c.alias(name) for name, c in keep.items()]
    source = docs.select(*columns, *([] if read == text else [F.col(text).cast("string").alias(read)]))
    schema = source.drop("__text").schema
    for name in MEASURES:
        schema = schema.add(name, "long")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(name, batch.column(name)) for name in batch.schema.names if name != "__text"]
            counts = measure_batch(batch.column(read))
            yield pa.RecordBatch.from_arrays([a for _, a in kept] + [pa.array(counts[m]) for m in MEASURES],
                                             [name for name, _ in kept] + list(MEASURES))

    return source.mapInArrow(trimmed(measured), schema)


def rules() -> dict[str, Column]:
    """Whether a document fails each rule. The first two are the base rules."""
    n = F.col("n_words")
    return {
        "short": n < MIN_WORDS,
        "repetitive": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n,
        "odd_word_length": (n > 0) & ((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        "symbols": 10 * F.col("n_symbols") > 3 * n,
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * n,
    }


BASE_RULES = ("short", "repetitive")


def _failures(measured: DataFrame) -> DataFrame:
    """Documents and failures of each rule per host; folded before the shuffle."""
    return measured.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), *[
        F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(r) for r, c in rules().items()])


def host_verdicts(failures: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: failure rates shrunk by a beta prior, and whether the host is rejected.

    The prior of a rule has the mean and the spread of the hosts' rates: with mean m and variance v
    its weight is m(1-m)/v - 1. Only the prior, one row of numbers, comes to the driver.
    """
    names = list(rules())
    prior = failures.agg(*[x for r in names for x in (
        (F.sum(r) / F.sum("host_docs")).alias(f"mean_{r}"),
        F.var_samp(F.col(r) / F.col("host_docs")).alias(f"var_{r}"))]).first()
    rates, over = [], F.lit(False)
    for r in names:
        mean, spread = prior[f"mean_{r}"] or 0.0, prior[f"var_{r}"] or 0.0
        weight = max(mean * (1 - mean) / spread - 1, 1.0) if spread > 0 else DEFAULT_PRIOR_WEIGHT
        rates.append(((F.col(r) + mean * weight) / (F.col("host_docs") + weight)).alias(f"rate_{r}"))
        over = over | (F.col(f"rate_{r}") > max_rate)
    return failures.select("host", "host_docs", *rates).withColumn("host_rejected", over)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per row: measures, failed rules, the host's verdict and ``kept``."""
    measured = written(measures(docs, {"doc_id": F.col(doc_id), "host": F.col(host)}, text), "measures")
    hosts = host_verdicts(_failures(measured)).select(F.col("host").alias("__host"), "host_rejected")
    checks = {r: F.coalesce(c, F.lit(False)) for r, c in rules().items()}
    base = checks[BASE_RULES[0]] | checks[BASE_RULES[1]]
    failed = F.concat_ws(",", *[F.when(c, F.lit(r)) for r, c in checks.items()])
    return (measured.join(hosts, F.col("host").eqNullSafe(F.col("__host")), "left")
            .select("doc_id", "host", *MEASURES, base.alias("base_failed"), failed.alias("failed_rules"),
                    "host_rejected", ((failed == "") & ~F.col("host_rejected")).alias("kept")))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows that keep all rules and whose host is not rejected, with all their columns.

    Texts are read twice and not shuffled: once for the hosts' failures, once for the rows' own.
    """
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text_at, host_at = f"c{names.index(text)}", f"c{names.index(host)}"
    failures = written(_failures(measures(flat, {"host": F.col(host_at)}, text_at)), "host-failures")
    bad = host_verdicts(failures).filter("host_rejected").select(F.col("host").alias("__host"))
    rows = measures(flat, {c: F.col(c) for c in flat.columns}, text_at)
    for failed in rules().values():
        rows = rows.filter(~F.coalesce(failed, F.lit(False)))
    kept = rows.drop(*MEASURES).join(bad, F.col(host_at).eqNullSafe(F.col("__host")), "left_anti")
    return kept.toDF(*names)
