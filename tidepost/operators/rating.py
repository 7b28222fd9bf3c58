"""Work around a model's rating of postings: prompts out, replies in, cost."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.functions.text import parse_rating
from tidepost.operators.frames import with_defaults
from tidepost.operators.keyed import first_per_key
from tidepost.settings import COST_PER_1K_TOKENS, RATING_PROMPT

_FIELDS = ("companies", "titles", "location", "desc")


def prompt(profile: str, criteria: str) -> Column:
    """The rating prompt of a row; profile and criteria are filled in as constants."""
    values = {"profile": F.lit(profile), "criteria": F.lit(criteria),
              **{name: F.col(name) for name in _FIELDS}}
    pieces = re.split(r"\{(\w+)\}", RATING_PROMPT)
    return F.concat(*[values[piece] if i % 2 else F.lit(piece) for i, piece in enumerate(pieces)])


def build_prompts(df: DataFrame, key: str, profile: str, criteria: str) -> DataFrame:
    full = with_defaults(df, {name: "" for name in _FIELDS})
    return full.select(key, prompt(profile, criteria).alias("prompt"))


def attach_ratings(postings: DataFrame, replies: DataFrame, key: str, reply: str = "raw",
                   order: Sequence[str] = ()) -> DataFrame:
    """``rating`` from landed replies, 0 where there is none or it is no integer.

    Of several replies to a posting the last by ``order`` counts (then by the reply itself), so
    postings are never multiplied. ``rating_valid`` tells whether the reply kept to 1..10.
    """
    last = first_per_key(replies, [key], [*order, reply], last=True)
    parsed = postings.join(last.drop(*order), key, "left").withColumn("rating", parse_rating(F.col(reply)))
    return parsed.withColumn("rating_valid", F.col("rating").between(1, 10))


def token_cost(replies: DataFrame, tokens: str = "total_tokens",
               per_1k: float = COST_PER_1K_TOKENS) -> DataFrame:
    total = F.coalesce(F.sum(tokens), F.lit(0))
    return replies.agg(total.alias("total_tokens"), (total / 1000 * F.lit(per_1k)).alias("cost"))
