"""Texts to vectors: a user's model behind one hook, and a built-in hashed bag of words."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.functions.text import filled
from tidepost.functions.vectors import bag_matrix, hashed_counts, model_embedding, white_space_spans, windowed_embedding
from tidepost.settings import ANCHOR_TEMPLATE, EMBED_CONTEXT, EMBED_SUFFIX, QUERY_PREFIX

Embedder = Callable[[Column], Column]


def document_input(text: Column) -> Column:
    """What a model is given for a document."""
    return F.concat(filled(text), F.lit(EMBED_SUFFIX))


def query_input(text: Column) -> Column:
    """What a model is given for a query."""
    return F.concat(F.lit(QUERY_PREFIX), filled(text), F.lit(EMBED_SUFFIX))


def anchor_text(text: str, criteria: str) -> str:
    """Profile text and criteria as one query text."""
    return ANCHOR_TEMPLATE.format(text=text, criteria=criteria)


def hashed_words(dimensions: int = 64) -> Embedder:
    """Words fall into md5 buckets; the vector is the unit-length bucket count."""

    def embed(text: Column) -> Column:
        return hashed_counts(F.lower(filled(text)), dimensions)

    return embed


def with_model(load_model: Callable[[], Callable[[list[str]], np.ndarray]],
               as_query: bool = False) -> Embedder:
    """An embedder around a model that each worker task loads for itself."""

    def embed(text: Column) -> Column:
        return model_embedding(query_input(text) if as_query else document_input(text), load_model)

    return embed


def with_windows(load_model: Callable[[], Callable[[list[str]], np.ndarray]],
                 load_spans: Callable[[], Callable[[str], Sequence[tuple[int, int]]]] = lambda: white_space_spans,
                 as_query: bool = False, context: int = EMBED_CONTEXT, overlap: int = 256,
                 budget: int = 4 * EMBED_CONTEXT) -> Embedder:
    """As :func:`with_model`, for texts of any length: windows of the model's context, pooled to one vector.

    ``load_spans`` loads the model's own tokenizer as a function from a text to its tokens' character spans.
    """

    def embed(text: Column) -> Column:
        return windowed_embedding(filled(text), load_model, load_spans, context=context, overlap=overlap, budget=budget,
                                  prefix=QUERY_PREFIX if as_query else "", suffix=EMBED_SUFFIX)

    return embed


def hashed_windows(dimensions: int = 64, context: int = EMBED_CONTEXT, overlap: int = 256) -> Embedder:
    """:func:`hashed_words` of each window, pooled: words count by what stands near them, not in the whole text."""

    def load() -> Callable[[list[str]], np.ndarray]:
        return lambda texts: bag_matrix(pa.array(texts, pa.string()), dimensions)

    def embed(text: Column) -> Column:
        return windowed_embedding(F.lower(filled(text)), load, lambda: white_space_spans, context=context, overlap=overlap,
                                  budget=max(4 * context, 1 << 18))

    return embed


def embed_documents(df: DataFrame, embedder: Embedder, text: str = "desc",
                    vector: str = "embedding") -> DataFrame:
    return df.withColumn(vector, embedder(F.col(text)))


def embed_anchors(df_of: DataFrame, texts: Mapping[str, str], criteria: str,
                  embedder: Embedder) -> DataFrame:
    """(profile, embedding) for profile texts; ``df_of`` only supplies the session."""
    rows = [(name, anchor_text(text, criteria)) for name, text in texts.items()]
    profiles = df_of.sparkSession.createDataFrame(rows, "profile string, text string")
    return profiles.select("profile", embedder(F.col("text")).alias("embedding"))
