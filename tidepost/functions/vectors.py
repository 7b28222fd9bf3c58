"""Dense vectors in array columns: Arrow batches in, numpy arithmetic, Arrow batches out."""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepost.functions.batches import slices, trimmed

# Bytes of texts whose words are coded at once.
SLICE_BYTES = 1 << 22

# The functions below run in Python workers; sent by value they need no package installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _as_matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Non-null rows as a float64 matrix, and their positions in the batch."""
    present = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)[present]
    if len(present) and not (lengths == width).all():
        raise ValueError(f"vectors must all have {width} entries")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(present), width), present


def _as_lists(rows: np.ndarray, present: np.ndarray, size: int) -> pa.Array:
    """Matrix rows back to a list array of ``size`` entries, NULL where no row is present."""
    lengths = np.zeros(size, dtype=np.int32)
    lengths[present] = rows.shape[1]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    mask = np.ones(size, dtype=bool)
    mask[present] = False
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()), mask=pa.array(mask))


def cosine_scores(vector: Column, anchors: Sequence[Sequence[float]]) -> Column:
    """``array<double>``: cosine with every anchor, times 100, two decimals half-even.

    One matrix product per Arrow batch: the anchors travel once per task, the documents are never
    multiplied into (document, anchor) rows. A zero vector on either side scores 0.
    """
    matrix = np.asarray(anchors, dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0).T
    width = matrix.shape[1]

    @F.arrow_udf("array<double>")
    def scores(vectors: pa.Array) -> pa.Array:
        rows, present = _as_matrix(vectors, width)
        lengths = np.linalg.norm(rows, axis=1, keepdims=True)
        rows = np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths != 0)
        return _as_lists(np.round(rows @ unit * 100, 2), present, len(vectors))

    return scores(vector)


def bag_matrix(texts: pa.Array, width: int) -> np.ndarray:
    """L2-normalised counts of each text's white-space tokens by md5 bucket.

    Splitting and coding run over the whole batch, each distinct token is hashed once, and counting is one
    ``bincount``.
    """
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    buckets = np.array([int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % width if word else -1
                        for word in words], dtype=np.int64)
    bucket = buckets[coded.indices.to_numpy(zero_copy_only=False)]
    row = np.repeat(np.arange(len(lists)), lengths)
    cells = (row * width + bucket)[bucket >= 0]
    counts = np.bincount(cells, minlength=len(lists) * width).astype(np.float64)
    counts = counts.reshape(len(lists), width)
    norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0)


def hashed_counts(text: Column, width: int) -> Column:
    """``array<double>``: :func:`bag_matrix` of each text, over slices of a batch."""

    def sliced(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [bag_matrix(texts[some], width) for some in slices(pc.binary_length(texts).fill_null(0).to_numpy(), SLICE_BYTES)]
            yield _as_lists(np.concatenate([np.zeros((0, width)), *rows]), np.arange(len(texts)), len(texts))

    @F.arrow_udf("array<double>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from trimmed(sliced)(batches)

    return counted(text)


def model_embedding(text: Column, load_model: Callable[[], Callable[[list[str]], np.ndarray]]) -> Column:
    """``array<double>`` from a user's embedding model.

    ``load_model`` runs once per task on the worker and returns a function from texts to an
    (n, d) matrix; texts arrive in Arrow batches.
    """

    @F.arrow_udf("array<double>")
    def embedded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load_model()
        for batch in batches:
            matrix = np.asarray(model(batch.to_pylist()), dtype=np.float64)
            yield _as_lists(matrix, np.arange(len(batch)), len(batch))

    return embedded(text)


def white_space_spans(text: str) -> list[tuple[int, int]]:
    """Where the words of a text begin and end."""
    return [m.span() for m in re.finditer(r"\S+", text)]


def token_windows(spans: Sequence[tuple[int, int]], room: int, overlap: int) -> list[tuple[int, int, int]]:
    """(begin, end, tokens) of windows of at most ``room`` tokens, each sharing ``overlap`` with the one before."""
    last = max(len(spans) - room, 0)
    firsts = range(0, last + room - overlap, room - overlap) if last else [0]
    parts = [spans[a:a + room] for a in firsts]
    return [(part[0][0], part[-1][1], len(part)) if part else (0, 0, 0) for part in parts]


def windowed_embedding(text: Column, load_model: Callable[[], Callable[[list[str]], np.ndarray]],
                       load_spans: Callable[[], Callable[[str], Sequence[tuple[int, int]]]], *,
                       context: int, overlap: int, budget: int, prefix: str = "", suffix: str = "") -> Column:
    """``array<double>`` from a model that reads ``context`` tokens at once; longer texts are read in windows.

    ``load_spans`` gives a function from a text to its tokens' character spans. ``prefix`` and ``suffix`` stand
    around each window and take their part of the context. A window is cut at token ends; a text of one window
    is given as it is. The model is called with windows of like length, as many as ``budget`` tokens hold when all
    are as long as the longest. A text's vector is the mean of its windows', weighted by their tokens, so it
    depends on neither the Arrow batch nor the budget. A null or empty text is one empty window.
    """
    if not 0 <= overlap < context or budget < 1:
        raise ValueError("overlap must be less than context, and the budget positive")

    @F.arrow_udf("array<double>")
    def embedded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, spans = load_model(), load_spans()
        around = len(spans(prefix)) + len(spans(suffix))
        room = context - around
        if room <= overlap:
            raise ValueError("the template leaves no room in the context")
        for batch in batches:
            owners, parts, sizes = [], [], []
            for row, whole in enumerate(batch.to_pylist()):
                whole = whole or ""
                cuts = token_windows(spans(whole), room, overlap)
                for a, b, tokens in cuts:
                    owners.append(row)
                    parts.append(prefix + (whole[a:b] if len(cuts) > 1 else whole) + suffix)
                    sizes.append(tokens)
            costs, weights = np.array(sizes) + max(around, 1), np.maximum(sizes, 1)
            order = np.argsort(-costs, kind="stable")
            matrix, at = None, 0
            while at < len(order):  # longest first: the first of a call says how many fit
                some = order[at:at + max(budget // int(costs[order[at]]), 1)]
                rows = np.asarray(model([parts[i] for i in some]), dtype=np.float64)
                matrix = np.zeros((len(order), rows.shape[1])) if matrix is None else matrix
                matrix[some] = rows
                at += len(some)
            if matrix is None:
                yield pa.array([], pa.list_(pa.float64()))
                continue
            begins = np.searchsorted(owners, np.arange(len(batch)))
            single = np.diff([*begins, len(owners)]) == 1
            pooled = np.add.reduceat(matrix * weights[:, None], begins) / np.add.reduceat(weights, begins)[:, None]
            pooled[single] = matrix[begins[single]]
            yield _as_lists(pooled, np.arange(len(batch)), len(batch))

    return embedded(text)


def score_columns(scores: Column, names: Sequence[str]) -> Mapping[str, Column]:
    """``score_<name>`` columns out of the array :func:`cosine_scores` gives."""
    return {f"score_{name}": scores[i] for i, name in enumerate(names)}
