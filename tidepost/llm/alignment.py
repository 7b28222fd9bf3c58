"""Alignment of two tokenizers' tokens over the same bytes, and of their ids over a corpus.

Tokenizer A is a byte-level BPE (``tokenizers``), B a BPE of pieces with byte fallback (``sentencepiece``).
A encodes a space and the text, B the text, before which it puts that space itself. Their spans are coarse cuts:
character offsets of A, byte spans of B's proto. Where several tokens share a character or have an empty span, the
lengths of their decoded bytes say where they end inside the coarse cut; a coarse cut that its tokens' bytes do
not fill is an encoding that does not round-trip. Offsets where both end a token cut the tokens into groups.

Texts are cut into units at each space or line feed that stands between characters that are no white space.
Both tokenizers start a token there whatever stands around (``Pair`` checks B's vocabulary for it), so a unit's
tokens and groups are worked out once per worker and remembered; new units of a block are encoded in one go.

A block of documents names its distinct linked id pairs and how many of its documents hold each. Pairs are
counted over blocks, and only (block, pair) rows move; then each block gets the counts of its own pairs back
and adds them up for its documents. No pair table is broadcast, and a pair that every document holds is one row a block.

Defined cases: a row is a document, whatever its id; null and empty texts, and texts that either encoding does not
give back byte for byte, have no tokens: zeros and ''. Equal texts are counted each. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidepost.llm.store import ship, written

BLOCK_CHARS = 1 << 22
# Units, and bytes of their groups, beyond which a worker forgets the rarer ones; characters encoded in one go.
MEMO_UNITS = 400_000
MEMO_BYTES = 1 << 26
CHAIN_CHARS = 1 << 18

_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_MARK = "▁"


def _byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the others
    follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Pair:
    """Two tokenizers and what has been learnt of their units."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = _byte_alphabet()
        self.bytes_a = {}
        for token, i in self.a.get_vocab().items():
            known = all(c in alphabet for c in token)
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if known else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode()
                        for i, p in enumerate(pieces)}
        crossing = [p for p in pieces if "\n" in p or re.search(f"[^{_MARK}]{_MARK}", p)]
        if crossing:
            raise ValueError(f"pieces go over the cuts of units: {crossing[:3]}")
        self.lengths_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        self.lengths_a[list(self.bytes_a)] = [len(x) for x in self.bytes_a.values()]
        self.lengths_b = np.array([len(self.bytes_b[i]) for i in range(len(pieces))], np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.size = 0
        # Per unit: tokens of A and B, groups, links and where its links start (``good`` False: does not round-trip).
        self.stats = np.zeros((1024, 5), np.int64)
        self.good = np.zeros(1024, bool)
        # Documents in which a unit was met, and the length of all group texts.
        self.used = np.zeros(1024, np.int64)
        self.weight = 0
        self.pairs = np.zeros(4096, np.int64)
        self.n_pairs = 0

    def encode_a(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, byte ends in the coarse cuts) of A over ``text``."""
        found = self.a.encode(text, add_special_tokens=False)
        ends = np.array(found.offsets, np.int64).reshape(-1, 2)[:, 1]
        if not text.isascii():
            points = np.frombuffer(text.encode("utf-32-le"), "<u4")
            sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            ends = np.concatenate([[0], np.cumsum(sizes)])[ends]
        return np.array(found.ids, np.int64), ends

    def encode_b(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, byte ends in the coarse cuts) of B over ``text``, which begins with the space that B adds itself."""
        pieces = self.b.encode(text[1:], return_type="proto").pieces
        found = np.array([(p.id, p.begin, p.end) for p in pieces], np.int64).reshape(-1, 3)
        # Bytes of one character have empty spans but for the last: they belong to the cut that it ends.
        ends = np.where(found[:, 1] < found[:, 2], found[:, 2], np.iinfo(np.int64).max)
        return found[:, 0], np.minimum.accumulate(ends[::-1])[::-1] + 1

    @staticmethod
    def refined(coarse: np.ndarray, lengths: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
        """(exact byte ends, whether the tokens' bytes fill their coarse cut).

        A coarse cut ends with the last token whose span ends there; tokens before it in the cut, inside a multibyte
        character or without a span, end where their decoded bytes do, counted from the cut before.
        """
        run = np.concatenate([[0], np.cumsum(lengths)])
        at = np.flatnonzero(np.diff(coarse, append=total + 1) > 0)
        firsts = np.concatenate([[0], at + 1])[:len(at)]
        before = np.concatenate([[0], coarse[at]])[:len(at)]
        cut = np.repeat(np.arange(len(at)), at - firsts + 1)
        ends = run[1:] - run[firsts][cut] + before[cut]
        filled = run[at + 1] - run[firsts] == coarse[at] - before
        return ends, filled[cut]

    def learn(self, units: list[str]) -> None:
        """Encode new units: those without white space at their end in chains, the others by themselves.

        Before them stands a unit of its own with the space that B adds.
        """
        chain, size = [" x"], 0
        for unit in units:
            if unit[-1].isspace():
                self._learn_text([" x", unit])
                continue
            chain.append(unit)
            size += len(unit)
            if size > CHAIN_CHARS:
                self._learn_text(chain)
                chain, size = [" x"], 0
        if size:
            self._learn_text(chain)

    def _learn_text(self, units: list[str]) -> None:
        text = "".join(units)
        raw = text.encode()
        unit_ends = np.cumsum([len(u.encode()) for u in units])
        sides = []
        good = np.ones(len(units), bool)
        for (ids, coarse), lengths, decoded in ((self.encode_a(text), self.lengths_a, self.bytes_a),
                                                (self.encode_b(text), self.lengths_b, self.bytes_b)):
            ends, filled = self.refined(coarse, lengths[ids], len(raw))
            unit = np.minimum(np.searchsorted(unit_ends, ends), len(units) - 1)
            # Units are cut where tokens are, and their bytes are those of their tokens.
            reached = np.searchsorted(ends, unit_ends, "right") > np.searchsorted(ends, unit_ends)
            good &= reached & np.concatenate([[True], reached[:-1]])
            good[unit[~filled]] = False
            tokens = [decoded[i] for i in ids.tolist()]
            if b"".join(tokens) != raw:
                own = [b""] * len(units)
                for u, token in zip(unit.tolist(), tokens):
                    own[u] += token
                good &= np.array([x == u.encode() for x, u in zip(own, units)])
            sides.append((ids, ends, unit))
        self._align(units, good, *sides)

    def _align(self, units, good, side_a, side_b) -> None:
        """Groups and links of all units at once, kept by unit; the first one is not asked for."""
        (ids_a, ends_a, unit_a), (ids_b, ends_b, unit_b) = [
            tuple(x[good[side[2]]] for x in side) for side in (side_a, side_b)]
        shared = ends_a[ends_b[np.minimum(np.searchsorted(ends_b, ends_a), max(len(ends_b) - 1, 0))] == ends_a] if len(ends_b) else ends_a
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        # A's token i overlaps the tokens of B from the first that ends after its start to the first that ends at or after its end.
        # Units left out have no tokens on either side, so a start before them changes nothing.
        first = np.searchsorted(ends_b, np.concatenate([[0], ends_a])[:-1], "right")
        count = np.searchsorted(ends_b, ends_a, "left") - first + 1
        row = np.repeat(np.arange(len(ids_a)), count)
        column = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        links = (ids_a[row] << 32) | ids_b[column]
        n = len(units)
        stats = np.stack([
            np.bincount(unit_a, minlength=n), np.bincount(unit_b, minlength=n),
            np.bincount(unit_a[np.diff(group_a, append=len(shared)) > 0], minlength=n), np.bincount(unit_a[row], minlength=n)], axis=1)
        text_a, text_b = _grouped(ids_a, group_a, len(shared)), _grouped(ids_b, group_b, len(shared))
        texts = [f"{x}|{y}" for x, y in zip(text_a, text_b)]
        groups_end = np.cumsum(stats[:, 2])
        links_end = np.cumsum(stats[:, 3])
        dropped = links_end[0]
        self._room(n - 1, len(links) - dropped)
        at = slice(self.size, self.size + n - 1)
        self.stats[at, :4] = stats[1:]
        self.stats[at, 4] = self.n_pairs + (links_end - stats[:, 3])[1:] - dropped
        self.good[at] = good[1:]
        self.used[at] = 0
        self.pairs[self.n_pairs:self.n_pairs + len(links) - dropped] = links[dropped:]
        self.n_pairs += len(links) - dropped
        self.known.update(zip(units[1:], range(self.size, self.size + n - 1)))
        self.size += n - 1
        bounds = [0, *groups_end.tolist()]
        self.texts.extend(";".join(texts[x:y]).encode() for x, y in zip(bounds[1:-1], bounds[2:]))

    def _room(self, units: int, links: int) -> None:
        while self.size + units > len(self.stats):
            self.stats, self.good, self.used = (np.concatenate([x, np.zeros_like(x)]) for x in (self.stats, self.good, self.used))
        while self.n_pairs + links > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])

    def shrink(self) -> None:
        """Keep the units of most documents, up to half the room, and forget the others."""
        used = self.used[:self.size]
        keep = np.flatnonzero(used > 1)
        room = MEMO_UNITS // 2
        if len(keep) > room:
            keep = np.sort(keep[np.argpartition(-used[keep], room)[:room]])
        if (weight := np.cumsum([len(self.texts[i]) for i in keep.tolist()])).size:
            keep = keep[weight <= MEMO_BYTES // 2]
        names = list(self.known)
        texts, stats, good, pairs, own = self.texts, self.stats[keep], self.good[keep], self.pairs, self.used[keep]
        self.forget()
        counts = stats[:, 3]
        ends = np.cumsum(counts)
        self._room(len(keep), int(counts.sum()))
        links = np.repeat(stats[:, 4] - (ends - counts), counts) + np.arange(counts.sum())
        self.n_pairs = len(links)
        self.pairs[:self.n_pairs] = pairs[links]
        stats[:, 4] = ends - counts
        self.size = len(keep)
        self.stats[:self.size], self.good[:self.size], self.used[:self.size] = stats, good, own // 2
        self.known = {names[i]: j for j, i in enumerate(keep.tolist())}
        self.texts = [texts[i] for i in keep.tolist()]
        self.weight = sum(map(len, self.texts))

    def units_of(self, text: str | None) -> list[str]:
        """The units of a space and the text; none where the text has no tokens for certain."""
        if not text or _MARK in text:
            return []
        return _CUT.split(" " + text)

    def numbers(self, documents: list[list[str]]) -> list[np.ndarray]:
        """The numbers of each document's units; new ones are learnt, of older ones some may be forgotten first."""
        if self.size > MEMO_UNITS or self.weight > MEMO_BYTES:
            self.shrink()
        found = [list(map(self.known.get, units)) for units in documents]
        new = {u for units, own in zip(documents, found) if None in own for u, i in zip(units, own) if i is None}
        if new:
            before = self.size
            self.learn(list(new))
            self.weight += sum(map(len, self.texts[before:]))
        return [np.array(list(map(self.known.get, units)) if None in own else own, np.int64)
                for units, own in zip(documents, found)]


def _grouped(ids: np.ndarray, group: np.ndarray, n: int) -> list[str]:
    """Ids of each of ``n`` groups joined by commas."""
    out = [""] * n
    last = -1
    for i, g in zip(ids.tolist(), group.tolist()):
        if g == last:
            out[g] += f",{i}"
        else:
            out[g] = str(i)
            last = g
    return out


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair_of(path_a: str, path_b: str) -> Pair:
    """The pair of a worker process, which keeps what it has learnt from task to task."""
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


def aligned(pair: Pair, texts: list[str | None]) -> tuple[list[list], list[np.ndarray], list[np.ndarray]]:
    """([n_a, n_b, n_groups, n_links, digest] per text, its distinct pairs, how often each is linked)."""
    rows, pairs, times = [], [], []
    nothing = np.zeros(0, np.int64)
    for at in pair.numbers([pair.units_of(t) for t in texts]):
        if not len(at) or not pair.good[at].all():
            rows.append([0, 0, 0, 0, ""])
            pairs.append(nothing)
            times.append(nothing)
            continue
        pair.used[at] += 1
        stats = pair.stats[at]
        sums = stats[:, :4].sum(axis=0).tolist()
        digest = hashlib.sha256(b";".join([pair.texts[i] for i in at.tolist()])).hexdigest()
        own = np.repeat(stats[:, 4] - (np.cumsum(stats[:, 3]) - stats[:, 3]), stats[:, 3]) + np.arange(sums[3])
        distinct, count = np.unique(pair.pairs[own], return_counts=True)
        rows.append([*sums, digest])
        pairs.append(distinct)
        times.append(count)
    return rows, pairs, times


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of slices of about ``BLOCK_CHARS``; a longer text is a block of its own."""
    texts, start, size = [], 0, 0
    for i, text in enumerate(batch.column(1).to_pylist()):
        length = len(text or "")
        if texts and size + length > BLOCK_CHARS:
            yield start, texts
            texts, start, size = [], i, 0
        texts.append(text)
        size += length
    if texts:
        yield start, texts


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0)]).astype(kind)))


def align(df: DataFrame, key: str, text: str, path_a: str, path_b: str) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row; see the module's text.

    A pair's count is the number of rows that hold it linked; ``n_best`` are links whose count is the highest
    of their A id, ``count_sum`` adds up the counts of all links.
    """
    spark = df.sparkSession
    ship(spark)
    kind = dict(df.dtypes)[key]
    columns = ["block", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times", "pairs", "documents"]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair = pair_of(path_a, path_b)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start, texts in _blocks(batch):
                n = len(texts)
                rows, pairs, times = aligned(pair, texts)
                distinct, at = np.unique(np.concatenate([*pairs, np.zeros(0, np.int64)]), return_inverse=True)
                sizes = [len(p) for p in pairs]
                counts = np.bincount(at, minlength=len(distinct))
                stats = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, pa.int64()), batch.column(0).slice(start, n), *[pa.array(s, pa.int64()) for s in stats[:4]],
                     pa.array(stats[4], pa.string()), _lists(np.split(at, np.cumsum(sizes)[:-1]), np.int32), _lists(times, np.int32),
                     pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))], columns)
                # The block's own row comes after those of its documents.
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.nulls(1, batch.column(0).type), *[pa.nulls(1, pa.int64())] * 4,
                     pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())),
                     _lists([distinct], np.int64), _lists([counts], np.int32)], columns)
                block += 1

    schema = (f"block long, key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              "at array<int>, times array<int>, pairs array<long>, documents array<int>")
    # Written once: blocks and their pairs must be those of one and the same run of a task.
    both = written(df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(encoded, schema), "aligned")
    asked = both.filter("pairs is not null").select(
        "block", F.posexplode(F.arrays_zip("pairs", "documents")).alias("i", "x")).select(
        "block", "i", F.col("x.pairs").alias("pair"), F.col("x.documents").alias("documents"))
    counts = asked.groupBy("pair").agg(F.sum("documents").alias("count"))
    # An id of A is linked with at most as many ids as B has.
    highest = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))
    counted = written(counts.withColumn("best", F.col("count") == highest), "pair-counts")
    answers = asked.select("block", "i", "pair").join(counted, "pair").select(F.col("block").alias("of"), "i", "count", "best")
    documents = both.filter("pairs is null").select("block", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times")

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("i").to_numpy())
        count = right.column("count").to_numpy()[order]
        best = right.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
        left = left.combine_chunks()
        n_best, count_sum = [], []
        for chunk in left.to_batches():
            at, times = (chunk.column(c) for c in ("at", "times"))
            ends = np.concatenate([[0], np.cumsum(np.diff(at.offsets.to_numpy()))])
            own, often = at.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            for values, out in ((best, n_best), (count, count_sum)):
                run = np.concatenate([[0], np.cumsum(values[own] * often)])
                out.append(run[ends[1:]] - run[ends[:-1]])
        return pa.table([left.column("key"), *[left.column(c) for c in ("n_a", "n_b", "n_groups", "n_links")],
                         pa.array(np.concatenate([*n_best, np.zeros(0)]).astype(np.int64)),
                         pa.array(np.concatenate([*count_sum, np.zeros(0)]).astype(np.int64)), left.column("groups_sha256")],
                        ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    out = (f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return documents.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(summed, out)


def id_links(df: DataFrame, text: str, path_a: str, path_b: str) -> DataFrame:
    """(a, b, documents): linked id pairs of the corpus and how many rows hold each, as for a map between vocabularies."""
    ship(df.sparkSession)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        for batch in batches:
            for _, texts in _blocks(batch):
                _, pairs, _ = aligned(pair, texts)
                distinct, counts = np.unique(np.concatenate([*pairs, np.zeros(0, np.int64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(counts)], ["pair", "n"])

    found = df.select(F.lit(0).alias("key"), F.col(text).alias("text")).mapInArrow(linked, "pair long, n long")
    return found.groupBy("pair").agg(F.sum("n").alias("documents")).select(
        F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "documents")
