"""License scans by a positional index of rare licence words. DataFrame functions only.

Templates are short licence passages, each with a mandatory key phrase. One pass over the texts keeps the
places of the words that templates or phrases hold, nothing else; document frequencies of these words come
from all documents. The index has the words' positions in each template. Of a template's words that a file has,
the rarest (highest IDF) are looked up: their places in the file, minus their positions in the template, are
where it would begin; where enough of them agree and the key phrase stands in its position, the file has
the label.
The score is the share of the best placed template's indexed words that stand where they belong.

Base phrases are found the same way, by places of consecutive words, and always give their label.

Defined cases: null or empty text has no words and no labels; texts are scanned whole; a phrase counts at
every place it stands, overlaps included; repeated rows are scanned alike; no rows give no rows; other
columns are not carried.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidepost.llm.store import written

# Base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words that every text has; they are in the index only where a key phrase needs them.
FUNCTION_WORDS = frozenset("a an and any are as at be by for from if in is it not of on or that the this to under with you".split())
# Of a file's rarest words of a template so many are looked up, and so many must agree on its place.
RAREST = 4
AGREEING = 2


@dataclass(frozen=True)
class Template:
    label: str
    phrase: str
    text: str

    @property
    def word_list(self) -> list[str]:
        return self.text.split()

    @property
    def phrase_at(self) -> int:
        words, phrase = self.word_list, self.phrase.split()
        return next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)


TEMPLATES = (
    Template("mit", "mit license", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge",
             "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("apache", "apache license", "licensed under the apache license version 2 0"),
    Template("gpl", "general public license", "this work is licensed under the gnu general public license version 3"),
    Template("lgpl", "lesser general public license", "under the terms of the gnu lesser general public license"),
    Template("agpl", "affero general public license", "under the terms of the gnu affero general public license"),
    Template("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    Template("cc-by-nc", "attribution noncommercial",
             "licensed under the creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by", "commons attribution", "licensed under the creative commons attribution 4 0 international license"),
    Template("bsd", "source and binary forms",
             "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("mpl", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    Template("isc", "isc license", "released under the isc license"),
)


def _indexed(t: Template) -> dict[int, str]:
    """Positions of a template's words that the index may hold."""
    phrase = range(t.phrase_at, t.phrase_at + len(t.phrase.split()))
    return {i: w for i, w in enumerate(t.word_list) if w not in FUNCTION_WORDS or i in phrase}


def vocabulary() -> list[str]:
    words = {w for t in TEMPLATES for w in _indexed(t).values()}
    return sorted(words | {w for p in BASE_PHRASES for w in p.split()})


def places(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_words, and the places of licence words as (w, p)."""
    known = vocabulary()
    words = F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD), F.lit(0))
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.lower(F.get("words", i)).isin(known))
    hits = F.when(F.size("words") > 0, F.transform(at, lambda i: F.struct(
        F.translate(F.get("words", i), _UPPER, _LOWER).alias("w"), i.alias("p"))))
    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), words.alias("words"))
            .select("doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits")))


def rarities(found: DataFrame) -> dict[str, float]:
    """IDF of each licence word over all documents; as many rows as the vocabulary has words."""
    known = vocabulary()
    total = found.count()
    rows = (found.select(F.explode(F.array_distinct(F.col("hits.w"))).alias("w")).groupBy("w").count()
            .filter(F.col("w").isin(known)).collect())
    seen = {r.w: r["count"] for r in rows}
    return {w: math.log((1 + total) / (1 + seen.get(w, 0))) for w in known}


def _column(word: str) -> str:
    return f"at_{word}"


def _minus(i: int, place: Column) -> Column:
    return place - i


def _is(word: str, hit: Column) -> Column:
    return hit.w == word


def _starts(words: dict[int, str]) -> Column:
    """Places from which all these words stand at these distances."""
    shifted = [F.transform(F.col(_column(w)), partial(_minus, i)) for i, w in words.items()]
    return reduce(F.array_intersect, shifted)


def _agreed(begins: Column, start: Column) -> Column:
    """Whether enough of the file's rarest words place the template at ``start``."""
    return F.size(F.filter(begins, lambda x: F.array_contains(x, start))) >= F.least(F.size(begins), F.lit(AGREEING))


def _share(index: dict[int, str], start: Column) -> Column:
    """The share of a template's words that stand in their places if it begins at ``start``."""
    return reduce(lambda a, b: a + b, [F.array_contains(F.col(_column(w)), start + i).cast("int")
                                       for i, w in index.items()]) / len(index)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts and places of base phrases, labels and score."""
    found = written(places(docs, doc_id, text), "licence-words")
    idf = rarities(found)
    empty = F.array().cast("array<int>")
    per_word = {_column(w): F.coalesce(F.transform(F.filter("hits", partial(_is, w)), lambda x: x.p), empty)
                for w in vocabulary()}
    base = {f"base_{label}": _starts(dict(enumerate(phrase.split()))) for phrase, label in BASE_PHRASES.items()}
    rows = found.withColumns(per_word).withColumns(base)

    matched, scores, marks = {}, [], []
    for k, t in enumerate(TEMPLATES):
        index = _indexed(t)
        rarest_first = sorted(index.items(), key=lambda item: (-idf[item[1]], item[0]))
        phrase = {t.phrase_at + i: w for i, w in enumerate(t.phrase.split())}
        begins = F.array(*[_starts({i: w}) for i, w in rarest_first])
        matched[f"rarest_{k}"] = F.slice(F.filter(begins, lambda x: F.size(x) > 0), 1, RAREST)
        matched[f"phrase_{k}"] = _starts(phrase)
    rows = rows.withColumns(matched)
    for k, t in enumerate(TEMPLATES):
        index = _indexed(t)
        share = F.transform(F.col(f"phrase_{k}"), partial(_share, index))
        scores.append(F.coalesce(F.array_max(share), F.lit(0.0)))
        here = F.filter(F.col(f"phrase_{k}"), partial(_agreed, F.col(f"rarest_{k}")))
        marks.append(F.when(F.size(here) > 0, F.lit(t.label)))
    base_marks = [F.when(F.size(c) > 0, F.lit(c.removeprefix("base_"))) for c in base]
    n_base = reduce(lambda a, b: a + b, [F.size(c) for c in base])
    lows, highs = [F.array_min(c) for c in base], [F.array_max(c) for c in base]
    return rows.select(
        "doc_id", "n_words", n_base.cast("long").alias("n_base"), F.least(*lows).cast("long").alias("first_word"),
        F.greatest(*highs).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_compact(F.array(*base_marks))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*base_marks, *marks)))), ",").alias("labels"),
        F.greatest(*scores).alias("score"))
