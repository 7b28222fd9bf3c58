"""Near-duplicates by SetSketch registers: band, estimate by likelihood, verify on full sets.

A document's set is its distinct runs of words. Each register of its sketch is the truncated logarithm
(base ``BASE``) of the least of the set's values in one order, values being exponentially spaced; so
sketches merge by maximum, and equal registers are likelier the more two sets share. Documents whose
``ROWS`` registers of a band are equal are candidates. The likeness of a candidate pair is estimated
from the counts of greater, lesser and equal registers together with the known set sizes; pairs far
below the threshold go, all others are verified on their full sets.

Equal sets are one node from the start. In each bucket all nodes are tried against one centre (another
one per band), and the links found are contracted to components. From then on only pairs of different
components are tried: first against the node of a bucket that shares most with other components, then
pair by pair. What two nodes can share is bounded by how many of a node's elements stand in other
components at all, and by the bits of their signatures that differ; this rules out nearly all pairs of a
large group of loose copies inside the join, before they are made. No link between different components is missed.

Defined cases: null or empty texts have an empty set, linked with nothing; texts of fewer words than a
run have one element; rows with equal sets are linked; a null id takes part in links but does not give
its component a name; no rows give no rows; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepost.llm.bloom import Filters, key_filter
from tidepost.llm.components import components
from tidepost.llm.store import trimmed, written
from tidepost.llm.words import groups, mix, seeds, words

ROWS = 5
BASE = 1.02
RATE = 20.0
# A pair at the threshold shares no band with at most this probability.
MISS = 1e-7
# Estimates this many standard errors below the threshold are not verified.
SPARE_ERRORS = 6.0
# Bits of a node's signature, in 64s. Small against a set it rules out less, but never a link.
SIGNATURE_LONGS = 32
# Size of the filter that sieves texts; a larger input only lets more texts through.
SIEVE_BITS = 1 << 26
_BLOCK = 1 << 11


def bands_for(percent: int) -> int:
    """Bands needed so that a pair at the threshold is missed with probability ``MISS`` at most."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def sets(texts: pa.Array, k: int, fold_case: bool = True) -> Iterator[np.ndarray]:
    """The set of each text: sorted distinct 64-bit hashes of its runs of ``k`` words."""
    for group in groups(texts):
        found = words(group, fold_case)
        hashes, _ = found.runs(k)
        for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True):
            if b - a >= k:
                yield np.unique(hashes[a:b - k + 1])
            elif b > a:
                yield mix(np.array([found.hashes[a:b].dot(seeds(b - a, 5)) + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


class Sketcher:
    """Registers of sets. Sketches of parts merge by maximum."""

    def __init__(self, size: int):
        self.orders = (seeds(size, 21) | np.uint64(1)).astype(np.uint32)[:, None]
        self.shifts = seeds(size, 22).astype(np.uint32)[:, None]
        self.space = np.zeros((size, _BLOCK), np.uint32)

    def registers(self, elements: np.ndarray) -> np.ndarray:
        short = (elements >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.orders), 0xFFFFFFFF, np.uint32)
        for a in range(0, len(short), _BLOCK):
            part = short[None, a:a + _BLOCK]
            values = self.space[:, :part.shape[1]]
            np.multiply(part, self.orders, out=values)
            values += self.shifts
            np.minimum(least, values.min(axis=1), out=least)
        spaced = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0 ** 32) / RATE
        return np.clip(np.floor(1 - np.log(spaced) / math.log(BASE)), 0, 65535).astype("<u2")


def likeness(greater: np.ndarray, less: np.ndarray, equal: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The Jaccard index of greatest joint likelihood, given the register counts and the set sizes."""
    u = na / (na + nb)
    v = 1 - u
    top = np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    best, where = np.full(len(u), -np.inf), np.zeros(len(u))
    for share in np.linspace(0, 1, 129):
        j = top * share
        more, fewer = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        score = (greater * np.log(more + tiny) + less * np.log(fewer + tiny)
                 + equal * np.log(np.maximum(1 - more - fewer, tiny)))
        better = score > best
        best, where = np.where(better, score, best), np.where(better, j, where)
    return where


def sketches(docs: DataFrame, doc_id: str, text: str, k: int, percent: int) -> DataFrame:
    """Per row: id, a hash of the text, set size, digest of the set (null: empty) and registers."""
    size = ROWS * bands_for(percent)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_key"),
                       F.col(text).cast("string").alias("text"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(size)
        for batch in batches:
            counts, digests, registers = [], [], []
            for elements in sets(batch.column("text"), k):
                counts.append(len(elements))
                some = len(elements) > 0
                digests.append(hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if some else None)
                registers.append(sketcher.registers(elements).tobytes() if some else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(counts, pa.int64()),
                 pa.array(digests, pa.binary()), pa.array(registers, pa.binary())],
                ["doc_id", "text_key", "n_shingles", "node", "registers"])

    return rows.mapInArrow(trimmed(sketched), "doc_id long, text_key long, n_shingles long, node binary, registers binary")


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose estimate is not far below the threshold."""
    size = ROWS * bands_for(percent)
    floor = percent / 100 - SPARE_ERRORS * math.sqrt(percent / 100 * (1 - percent / 100) / size)
    side = nodes.select("node", "registers")
    both = (pairs.join(side.toDF("a", "ra"), "a").join(side.toDF("b", "rb"), "b")
            .select("a", "b", "na", "nb", "ra", "rb"))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, size)
                      for c in ("ra", "rb"))
            estimate = likeness((ra > rb).sum(1), (ra < rb).sum(1), (ra == rb).sum(1),
                                batch.column("na").to_numpy(), batch.column("nb").to_numpy())
            yield batch.filter(pa.array(estimate >= floor)).select(["a", "b"])

    return both.mapInArrow(trimmed(likely), "a binary, b binary")


def _texts(nodes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, text) for the given nodes. Other rows are sieved out before the shuffle by a filter of fixed size."""
    wanted = written(nodes.select("node", F.col("row.doc_id").alias("wanted_id"), F.col("row.text_key").alias("wanted_key")),
                     "wanted-texts")
    sieve = docs.sparkSession.sparkContext.broadcast(key_filter(wanted.select("wanted_key"), SIEVE_BITS))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_key"),
                       F.col(text).cast("string").alias("text"))

    def sieved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Filters.reading(sieve.value, SIEVE_BITS)
        for batch in batches:
            yield batch.filter(pa.array(table.suspects(batch.column("text_key").to_numpy().view(np.uint64))))

    found = rows.mapInArrow(trimmed(sieved), rows.schema).hint("merge")
    return written(found.join(wanted.hint("merge"), (F.col("text_key") == F.col("wanted_key"))
                              & F.col("doc_id").eqNullSafe(F.col("wanted_id")))
                   .select("node", "text").dropDuplicates(["node"]), "node-texts")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose full sets are alike enough."""
    both = (pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").sortWithinPartitions("a"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            # A centre is in many pairs and they lie together: its set is made once.
            left = batch.column("a").to_pylist()
            new = [i == 0 or left[i] != left[i - 1] for i in range(len(left))]
            firsts = sets(batch.column("ta").filter(pa.array(new)), k)
            good, mine = [], np.zeros(0, np.uint64)
            for is_new, other in zip(new, sets(batch.column("tb"), k), strict=True):
                mine = next(firsts) if is_new else mine
                shared = len(np.intersect1d(mine, other, assume_unique=True))
                good.append(100 * shared >= percent * (len(mine) + len(other) - shared))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    return both.mapInArrow(trimmed(exact), "a binary, b binary")


def _shared_elements(nodes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(node, m): how many of a node's elements stand in a node of another component too.

    ``m`` bounds what a node can share with any node of another component.
    """
    source = texts.join(nodes, "node").select("node", F.xxhash64("root").alias("root"), "text")

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, elements in enumerate(sets(batch.column("text"), k)):
                at = pa.array(np.full(len(elements), i))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(at), batch.column("root").take(at), pa.array(elements.view(np.int64))],
                    ["node", "root", "element"])

    elements = source.mapInArrow(trimmed(exploded), "node binary, root long, element long")
    mixed = written(elements.groupBy("element").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y")
                    .select("element"), "mixed-elements")
    return elements.join(mixed, "element").groupBy("node").agg(F.count(F.lit(1)).alias("m"))


def _signatures(nodes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(node, s0, s1, ...): a bitmap of the elements' hashes.

    A bit that one node has and another has not stands for at least one element they do not share.
    """
    names = [f"s{i}" for i in range(SIGNATURE_LONGS)]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = np.zeros((batch.num_rows, 64 * SIGNATURE_LONGS), np.uint8)
            for i, elements in enumerate(sets(batch.column("text"), k)):
                maps[i, (elements % np.uint64(64 * SIGNATURE_LONGS)).astype(np.int64)] = 1
            packed = np.packbits(maps, axis=1).view("<i8")
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), *[pa.array(np.ascontiguousarray(packed[:, i])) for i in range(SIGNATURE_LONGS)]],
                ["node", *names])

    return texts.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(
        trimmed(signed), "node binary, " + ", ".join(f"{n} long" for n in names))


def _unshared(one: str, other: str) -> Column:
    """Elements of one node that another cannot have, by their signatures (name suffixes)."""
    return reduce(lambda a, b: a + b, [
        F.bit_count(F.col(f"s{i}{one}").bitwiseAND(F.bitwise_not(F.col(f"s{i}{other}")))) for i in range(SIGNATURE_LONGS)])


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Bucket members with their components, of buckets that hold several."""
    labelled = written(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "labelled")
    mixed = labelled.groupBy("key").agg(F.min(F.xxhash64("root")).alias("x"), F.max(F.xxhash64("root")).alias("y")).filter(
        "x <> y").select("key")
    return labelled.join(written(mixed, "mixed-keys"), "key")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3,
                    percent: int = 85) -> DataFrame:
    """Per row: id, hash of the text, set size, component (its least id) and whether the row is kept."""
    bands = bands_for(percent)
    rows = written(sketches(docs, doc_id, text, k, percent), "sketches")
    nodes = written(rows.filter("node is not null").groupBy("node").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("least_id"),
        F.min(F.struct("doc_id", "text_key")).alias("row"), F.min("n_shingles").alias("n"),
        F.min("registers").alias("registers")), "nodes")
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.xxhash64(
        j, F.col("registers").substr(j * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    banded = nodes.select(F.explode(keys).alias("key"), "node", "n")
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    members = written(banded.join(written(shared, "shared-keys").hint("merge"), "key"), "buckets")
    texts = _texts(nodes.join(members.select("node").distinct(), "node", "left_semi"), docs, doc_id, text)

    def fits(na: str, nb: str) -> Column:
        return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)

    def verified(pairs: DataFrame) -> DataFrame:
        likely = written(_estimated(pairs.distinct(), nodes, percent), "likely")
        return written(_verified(likely, texts, k, percent), "verified")

    # First, each node against one centre of its bucket, drawn anew for each bucket.
    centres = written(members.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key"), "node", "n")).alias("c")).select(
        "key", F.col("c.node").alias("a"), F.col("c.n").alias("na")), "centres")
    links = verified(members.join(centres, "key").filter("node <> a").filter(fits("n", "na"))
                     .select("a", F.col("node").alias("b"), "na", F.col("n").alias("nb")))
    roots = components(links)

    # Then only pairs of different components. What a node shares with other components bounds its likeness.
    waiting = _open(members, roots)
    counts = written(_shared_elements(waiting.select("node", "root").distinct(), texts, k), "shared-elements")

    def alike(na: Column, nb: Column, at_most: Column) -> Column:
        return 100 * at_most >= percent * (na + nb - at_most)

    def hopeful(waiting: DataFrame) -> DataFrame:
        """Members that some node of their bucket's least size could still be alike to."""
        sized = waiting.join(counts, "node")
        least = sized.groupBy("key").agg(F.min("n").alias("least_n"))
        return sized.join(least, "key").filter(alike(F.col("n"), F.greatest("least_n", "m"), F.col("m"))).drop("least_n")

    # Again one centre per bucket, the one that shares most: it lies in the middle of a group of copies.
    first = written(hopeful(waiting), "hopeful")
    middles = written(first.groupBy("key").agg(F.max(F.struct(F.col("m") / F.col("n"), "node", "n", "m", "root")).alias("c")).select(
        "key", F.col("c.node").alias("a"), F.col("c.n").alias("na"), F.col("c.m").alias("ma"), F.col("c.root").alias("ra")), "middles")
    more = verified(first.join(middles, "key").filter("root <> ra").filter(fits("n", "na"))
                    .filter(alike(F.col("n"), F.col("na"), F.least("m", "ma")))
                    .select("a", F.col("node").alias("b"), "na", F.col("n").alias("nb")))
    links = links.unionByName(more)
    roots = components(links)
    # What is left, pair by pair.
    last = hopeful(_open(members, roots))
    last = written(last.join(written(_signatures(last.select("node").distinct(), texts, k), "signatures"), "node"), "hopeful")
    right = last.toDF(*[c if c == "key" else f"{c}_b" for c in last.columns])
    rest = verified(last.join(right, "key").filter("root < root_b").filter(fits("n", "n_b"))
                    .filter(alike(F.col("n"), F.col("n_b"), F.least("m", "m_b")))
                    .filter(alike(F.col("n"), F.col("n_b"), F.least(F.col("n") - _unshared("", "_b"),
                                                                    F.col("n_b") - _unshared("_b", ""))))
                    .select(F.col("node").alias("a"), F.col("node_b").alias("b"), F.col("n").alias("na"),
                            F.col("n_b").alias("nb")))
    if not rest.isEmpty():
        roots = components(links.unionByName(rest))

    named = nodes.join(roots, "node", "left").filter("root is not null or n_rows > 1").withColumn(
        "root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    special = written(named.select("node", "root").join(written(names, "names"), "root")
                      .select("node", "component_id", F.col("root").alias("component")), "components")
    return (rows.select("doc_id", "text_key", "n_shingles", "node").join(special, "node", "left")
            .withColumn("component_id", F.coalesce("component_id", "doc_id"))
            .select("doc_id", "text_key", "n_shingles", "component_id", "component",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5,
                percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of the least id (of equal ids, the least text hash)."""
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    id_at, text_at = f"c{names.index(doc_id)}", f"c{names.index(text)}"

    def row_key(i: Column, text_key: Column) -> Column:
        return F.concat_ws(":", i.cast("string"), text_key.cast("string"))

    found = near_duplicates(flat, id_at, text_at, k, percent)
    alone = found.filter("component is null").select("doc_id", "text_key", F.lit(False).alias("grouped"))
    chosen = (found.filter("component is not null and kept").groupBy("component").agg(
        F.min(F.struct("doc_id", "text_key")).alias("row")).select("row.doc_id", "row.text_key", F.lit(True).alias("grouped")))
    wanted = written(alone.unionByName(chosen).select(
        row_key(F.col("doc_id"), F.col("text_key")).alias("row_key"), "grouped").distinct(), "kept-rows")
    keyed = flat.withColumn("row_key", row_key(F.col(id_at).cast("long"), F.xxhash64(F.col(text_at).cast("string"))))
    # Equal rows are one group too; the window needs no shuffle of its own after the join.
    numbered = keyed.hint("merge").join(wanted.hint("merge"), "row_key").withColumn(
        "number", F.row_number().over(Window.partitionBy("row_key").orderBy("grouped")))
    return numbered.filter("number = 1 or not grouped").select(*flat.columns).toDF(*names)
