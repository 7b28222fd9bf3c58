"""Packing by non-negative least squares over the histogram of lengths.

Each document's ids are cut into full windows and a tail. The tails' lengths, at most ``WINDOW`` kinds, are
all that the driver sees. Shallow combinations of lengths that fill a window exactly are enumerated, their
repeat counts solve a non-negative least squares problem against the histogram, and are rounded to what
is there. Lengths left over are packed greedily, largest first with the best fitting fillers; what would
still waste more than ``SLACK`` ids is cut into powers of two, which fill windows, or sequences of a power
of two, without padding.

A tail then only needs its rank among the tails of its length: ranges of ranks are dealt to patterns, and
sequence id and offset follow by arithmetic in the task that holds the row. Tokens are made once; every
piece that a plan may need (windows, tail, powers of two) has its checksum from that one pass.

Defined cases: null or empty text has the closing id alone; repeated rows are packed one by one; no rows
give no rows; other columns are not carried.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidepost.llm.store import trimmed, written

WINDOW = 4096
CLOSING_ID = 2
SLACK = 32
SOLVER_STEPS = 100
PARTNERS = 8
DEPTH = 6
# Words whose ids a task remembers; beyond it the memory starts anew, which changes no result.
CACHED_WORDS = 1_500_000
RANK_ROWS = 50_000
# The vocabulary's mark for the end of a part of a word; stops that are parts of their own.
WORD_END = "</w>"
STOPS = frozenset(".,;:!?")


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> tuple[Any, dict[bytes, bytes], np.ndarray]:
    """The tokenizer, the words known so far (kept between a worker's tasks), and which ids end a part of a word."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = Tokenizer.from_file(path)
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, i in tokenizer.get_vocab().items():
        ends[i] = token.endswith(WORD_END)
    return tokenizer, {}, ends


class WordIds:
    """Ids of texts as bytes, word by word; words are what ASCII white space parts.

    The vocabulary's own splitting never crosses white space, so the ids of a text are those of its words.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known, self.ends = _tokenizer(path)
        self.closing = np.array([CLOSING_ID], "<u4").tobytes()

    def _learn(self, words: list[bytes]) -> None:
        """Encode new words, many in one call.

        Letters alone are one part, letters and a stop are two, and a part ends with an id that says so; where the
        number of such ids is as expected, they tell the words apart.
        """
        kinds: dict[int, list[tuple[bytes, str]]] = {0: [], 1: [], 2: []}
        for w in words:
            text = w.decode("utf-8")
            parts = 1 if text.isalpha() else 2 if text[-1] in STOPS and text[:-1].isalpha() else 0
            kinds[parts].append((w, text))
        for parts, own in kinds.items():
            for a in range(0, len(own), 2_000):
                some = own[a:a + 2_000]
                if parts:
                    code = self.tokenizer.encode_batch_fast([" ".join(t for _, t in some)], add_special_tokens=False)[0]
                    ids = np.array(code.ids, "<u4")
                    stops = np.flatnonzero(self.ends[ids])[parts - 1::parts] + 1
                    if len(stops) == len(some) and len(ids) == stops[-1] and self.ends[ids].sum() == parts * len(some):
                        self._remember(some, ids, np.concatenate([[0], stops]))
                        continue
                self._learn_by_place(some)

    def _learn_by_place(self, words: list[tuple[bytes, str]]) -> None:
        """Encode words whose parts are not known, and find each one's ids by where they stand."""
        code = self.tokenizer.encode(" ".join(t for _, t in words), add_special_tokens=False)
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for _, t in words])])
        at = np.array([a for a, _ in code.offsets], np.int64)
        self._remember(words, np.array(code.ids, "<u4"), np.searchsorted(at, starts))

    def _remember(self, words: list[tuple[bytes, str]], ids: np.ndarray, bounds: np.ndarray) -> None:
        raw, cuts = ids.tobytes(), (4 * bounds).tolist()
        self.known.update(zip([w for w, _ in words], map(raw.__getitem__, map(slice, cuts[:-1], cuts[1:])), strict=True))

    def batch(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """The ids of each UTF-8 text."""
        known = self.known
        split = [(t or b"").split() for t in texts]
        every = set(chain.from_iterable(split))
        fresh = every.difference(known)
        if len(known) + len(fresh) > CACHED_WORDS:
            known.clear()
            fresh = every
        self._learn(list(fresh))
        for words in split:
            yield b"".join(map(known.__getitem__, words)) + self.closing


def power_cuts(length: int) -> list[int]:
    """Powers of two that add up to ``length``, largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def tokenized(docs: DataFrame, doc_id: str, text: str, encoder: Callable[[], Any], window: int) -> DataFrame:
    """Per document: number of ids, checksums of its full windows, of its tail, and of the tail's powers of two."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            totals, windows, tails, parts = [], [], [], []
            for ids in (x for a in range(0, batch.num_rows, 500)
                        for x in encode.batch(batch.column("text").slice(a, 500).cast(pa.binary()).to_pylist())):
                total = len(ids) // 4
                full = total // window
                tail = ids[4 * full * window:]
                sums, at = [], 0
                for size in power_cuts(len(tail) // 4):
                    sums.append(zlib.crc32(tail[at:at + 4 * size]))
                    at += 4 * size
                totals.append(total)
                windows.append([zlib.crc32(ids[4 * i * window:4 * (i + 1) * window]) for i in range(full)])
                tails.append(zlib.crc32(tail))
                parts.append(sums)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(windows, longs), pa.array(tails, pa.int64()),
                 pa.array(parts, longs)], ["doc_id", "doc_tokens", "window_sums", "tail_sum", "part_sums"])

    return rows.mapInArrow(trimmed(encoded), "doc_id long, doc_tokens long, window_sums array<long>, tail_sum long, "
                                    "part_sums array<long>")


def solve_nnls(patterns: list[tuple[int, ...]], histogram: np.ndarray, steps: int = SOLVER_STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that make sum(x * pattern) come near the histogram (least squares).

    Multiplicative steps keep x from becoming negative and never make the error larger.
    """
    width = max(len(p) for p in patterns)
    at = np.zeros((len(patterns), width), np.int64)
    for i, p in enumerate(patterns):
        at[i, :len(p)] = p  # length 0 is a bin that counts for nothing
    target = histogram.astype(float).copy()
    target[0] = 0
    x = np.full(len(patterns), 1.0)
    wanted = target[at].sum(axis=1)
    for _ in range(steps):
        made = np.bincount(at.ravel(), np.repeat(x, width), len(histogram))
        made[0] = 0
        x *= wanted / np.maximum(made[at].sum(axis=1), 1e-9)
    return x


def filling_patterns(histogram: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Exact fillings: one length once or repeated, closed by at most two others that are there."""
    present = np.flatnonzero(histogram[:window])
    present = present[present > 0]
    there = np.zeros(window + 1, bool)
    there[present] = True
    out: set[tuple[int, ...]] = set()
    for a in present:
        for m in range(1, DEPTH + 1):
            gap = window - m * int(a)
            if gap < 0:
                continue
            head = (int(a),) * m
            if gap == 0:
                out.add(head)
                continue
            if there[gap]:
                out.add(tuple(sorted((*head, gap))))
            low = present[present <= gap // 2]
            low = low[there[gap - low]]
            if len(low):  # fillers spread over all sizes, the most frequent ones first among equals
                best = low[np.argsort(-np.minimum(histogram[low], histogram[gap - low]), kind="stable")[:PARTNERS]]
                out.update(tuple(sorted((*head, int(b), gap - int(b)))) for b in best)
    return sorted(p for p in out if len(p) <= DEPTH)


@dataclass
class Plan:
    """What the driver decides from the histogram alone.

    ``slots``: rows (length, first rank, ranks per sequence, number of sequences, first sequence, offsets of
    the ranks in a sequence). ``cut``: of each length, the rank from which tails are cut into powers of two.
    """

    slots: list[tuple[int, int, int, int, int, tuple[int, ...]]]
    cut: np.ndarray
    n_sequences: int


def make_plan(histogram: np.ndarray, window: int) -> Plan:
    """``histogram[l]``: how many tails have ``l`` ids (1 <= l < window)."""
    left = histogram.astype(np.int64).copy()
    used = np.zeros_like(left)
    slots: list[tuple[int, int, int, int, int, tuple[int, ...]]] = []
    sequences = 0

    def take(pattern: tuple[int, ...], repeats: int) -> None:
        nonlocal sequences
        offsets: dict[int, list[int]] = {}
        at = 0
        for length in pattern:
            offsets.setdefault(length, []).append(at)
            at += length
        for length, places in offsets.items():
            slots.append((length, int(used[length]), len(places), repeats, sequences, tuple(places)))
            used[length] += repeats * len(places)
            left[length] -= repeats * len(places)
        sequences += repeats

    def possible(pattern: tuple[int, ...], wanted: int) -> int:
        for length in set(pattern):
            wanted = min(wanted, int(left[length]) // pattern.count(length))
        return wanted

    patterns = filling_patterns(left, window)
    if patterns:
        counts = solve_nnls(patterns, left)
        for i in np.argsort(-counts, kind="stable"):
            n = possible(patterns[i], int(round(counts[i])))
            if n > 0:
                take(patterns[i], n)
        for pattern in patterns:  # what rounding has left
            n = possible(pattern, int(left.max()))
            if n > 0:
                take(pattern, n)
    # Residuals: the largest length first, filled up with the largest that still fit.
    stuck = np.zeros(len(left), bool)
    while True:
        free = np.flatnonzero((left > 0) & ~stuck)
        if len(free) == 0:
            break
        longest = int(free[-1])
        pattern, gap = [longest], window - longest
        rest = left.copy()
        rest[longest] -= 1
        while gap > 0:
            fits = np.flatnonzero(rest[:gap + 1])
            if len(fits) == 0:
                break
            filler = int(fits[-1])
            n = min(int(rest[filler]), gap // filler)
            pattern += [filler] * n
            rest[filler] -= n
            gap -= n * filler
        if gap > SLACK:
            stuck[longest] = True
        else:
            take(tuple(pattern), possible(tuple(pattern), int(left.max())))
    return Plan(slots, used.copy(), sequences)


class _Places:
    """Where a tail goes, by its length and its rank among the tails of that length."""

    def __init__(self, plan: Plan, histogram: np.ndarray, window: int):
        self.cut, self.window = plan.cut, window
        by_length: dict[int, list[tuple]] = {}
        for slot in plan.slots:
            by_length.setdefault(slot[0], []).append(slot)
        self.slots = {length: sorted(slots, key=lambda s: s[1]) for length, slots in by_length.items()}
        self.firsts = {length: np.array([s[1] for s in slots]) for length, slots in self.slots.items()}
        # Powers of two: how many pieces of a size come from shorter tails, and where its sequences begin.
        bits = window.bit_length()
        cut_rows = histogram - plan.cut
        has = (np.arange(len(histogram))[:, None] >> np.arange(bits)) & 1
        pieces = cut_rows[:, None] * has
        self.before = np.cumsum(pieces, axis=0) - pieces
        self.pieces = pieces.sum(axis=0)
        self.first_sequence, at = [], plan.n_sequences
        for b in range(bits):
            per = max(window >> b, 1)
            self.first_sequence.append(at)
            at += int(self.pieces[b]) // per + bin(int(self.pieces[b]) % per).count("1")
        self.n_sequences = at

    def tail(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the tail, length, sequence, offset) of each piece."""
        if rank < self.cut[length]:
            slot = self.slots[length][int(np.searchsorted(self.firsts[length], rank, "right")) - 1]
            _, first, per, _, sequence, offsets = slot
            return [(0, length, sequence + (rank - first) // per, offsets[(rank - first) % per])]
        out, start = [], 0
        for size in power_cuts(length):
            b = size.bit_length() - 1
            n = int(self.before[length, b]) + rank - int(self.cut[length])
            per, total = self.window // size, int(self.pieces[b])
            sequence = self.first_sequence[b] + n // per
            offset = n % per
            if n >= total - total % per:  # the last ones: sequences of a power of two pieces
                sequence = self.first_sequence[b] + total // per
                for group in power_cuts(total % per):
                    if offset < group:
                        break
                    offset -= group
                    sequence += 1
            out.append((start, size, sequence, offset * size))
            start += size
        return out


SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None,
         window: int = WINDOW) -> DataFrame:
    """One row per piece: where it begins in its document and where it lies in which sequence."""
    path = tokenizer or public_tokenizer()
    made = written(tokenized(docs, doc_id, text, lambda: WordIds(path), window), "tokenized").withColumn(
        "tail", (F.col("doc_tokens") % window).cast("int"))
    # At most ``window`` rows, whatever the input.
    bins = made.groupBy("tail").agg(F.count(F.lit(1)).alias("n"), F.max("doc_tokens").alias("longest")).collect()
    histogram = np.zeros(window + 1, np.int64)
    for row in bins:
        histogram[row.tail] = row.n
    windows_each = max((row.longest // window for row in bins), default=0)
    row_bases = np.cumsum(histogram) - histogram
    tails = histogram.copy()
    tails[0] = 0
    places = _Places(make_plan(tails, window), tails, window)

    # Ranks among equal lengths: rows are dealt to buckets, the buckets' sizes are added up.
    buckets = int(histogram.max()) // RANK_ROWS + 1
    dealt = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tail_sum", "doc_tokens"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("tail").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("tail", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "tail", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("tail", "bucket").orderBy("doc_id", "tail_sum", "doc_tokens")
    ranked = (dealt.withColumn("number", F.row_number().over(order)).join(bases, ["tail", "bucket"])
              .select("doc_id", "doc_tokens", "window_sums", "tail_sum", "part_sums", "tail",
                      (F.col("base") + F.col("number") - 1).alias("rank")))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                length, rank, total = r["tail"], r["rank"], r["doc_tokens"]
                first = places.n_sequences + (int(row_bases[length]) + rank) * windows_each
                for i, checksum in enumerate(r["window_sums"]):
                    out.append((r["doc_id"], i * window, window, checksum, total, first + i, 0))
                if length:
                    pieces = places.tail(length, rank)
                    sums = [r["tail_sum"]] if rank < places.cut[length] else r["part_sums"]
                    for (start, size, sequence, offset), checksum in zip(pieces, sums, strict=True):
                        out.append((r["doc_id"], total - length + start, size, checksum, total, sequence, offset))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(trimmed(placed), SCHEMA)
