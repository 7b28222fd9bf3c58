"""WARC archives: written as text files, read back by verifying the chain of record boundaries.

Writing: a digest per row first (no payload moves), then one record per row. Of rows with equal payloads
one is the response, the others are revisits without payload that name it. Each task writes one file.

Reading: files are split like any text, at every occurrence of the magic that begins a record. Where a
piece begins is the sum of the pieces before it, so every occurrence becomes a candidate with the offset its
header names for its successor. A payload may hold the magic, or whole records, so candidates prove nothing:
from the file's start the chain is followed by pointer jumping, first inside each split and then, by
doubling, over splits. Only candidates it reaches are records. A record made of several pieces is put
together again from them; all others stay where they were read.

Defined cases: null payload is empty; null uri is left out; rows with equal key and equal payload that hold
the response's key are all responses; a null key never names a response, and is a revisit if a row with the
same payload has a key; other columns are not carried; no rows give an archive without records.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidepost.llm.store import written
from tidepost.session import scratch_path

MAGIC = "WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
KEY_URN = "urn:row:"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_HEX_TO_32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four base-32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), *_HEX_TO_32)


def write_archive(rows: DataFrame, path: str, key: str, uri: str, payload: str, date: str = "2024-01-01T00:00:00Z",
                  least_bytes: int = 0) -> None:
    """One record per row; payloads of at least ``least_bytes`` are stored once."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    source = rows.select(F.col(key).cast("long").alias("key"), F.col(uri).cast("string").alias("uri"), body.alias("body"))
    digests = source.select("key", base32_sha1(F.col("body")).alias("digest"), F.length("body").alias("size"))
    shared = written(digests.filter(F.col("size") >= least_bytes).groupBy("digest")
                     .agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("first")).filter("n > 1 and first is not null")
                     .select("digest", "first"), "shared-payloads")
    planned = (source.withColumn("digest", base32_sha1(F.col("body"))).join(shared, "digest", "left")
               .withColumn("revisit", F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))))
    # A line break in a uri would end its header; it is written percent-encoded.
    safe_uri = F.replace(F.replace(F.col("uri"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(_HTTP), F.length("body").cast("string"), F.lit("\r\n\r\n"))
    block_bytes = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.length("body"))
    head = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.coalesce(F.concat(F.lit(f"\r\nWARC-Record-ID: <{KEY_URN}"), F.col("key").cast("string"), F.lit(">")), F.lit("")),
        F.when(F.col("revisit"), F.concat(F.lit(f"\r\nWARC-Refers-To: <{KEY_URN}"), F.col("first").cast("string"),
                                          F.lit(">\r\nWARC-Profile: "),
                                          F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
               ).otherwise(F.lit("")),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), safe_uri), F.lit("")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block_bytes.cast("string"),
        F.lit("\r\n\r\n"), http)
    record = F.concat(head.cast("binary"), F.when(F.col("revisit"), F.lit("").cast("binary")).otherwise(F.col("body")))
    planned.select(record.cast("string").alias("value")).write.option("lineSep", RECORD_END).text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """Everything between magics: file, split, number inside the split, bytes.

    The first piece of a file is what stands before its first magic (nothing, in an archive).
    """
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                       F.col("_metadata.file_size").alias("file_size"), F.monotonically_increasing_id().alias("place"),
                       F.col("value").cast("binary").alias("bytes"))


def _local_exits(rows: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a split the offset at which the chain from it leaves the split."""
    rows = rows.sort_values("at", ascending=False)
    exits: dict[int, int] = {}
    for at, to in zip(rows["at"], rows["successor"], strict=True):
        exits[at] = exits.get(to, to)
    return rows.assign(exit=[exits[at] for at in rows["at"]])[["file", "split", "at", "successor", "exit"]]


def _local_chain(rows: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a split on the chain from where it is entered."""
    successors = dict(zip(rows["at"], rows["successor"], strict=True))
    reached, at = [], rows["entry"].iloc[0]
    while at in successors:
        reached.append(at)
        at = successors[at]
    return pd.DataFrame({"file": rows["file"].iloc[0], "at": reached})


def record_starts(candidates: DataFrame) -> DataFrame:
    """(file, at) of true records among candidates (file, split, at, successor).

    Inside a split the chain is followed by the task that holds it. Over splits, reached offsets are
    doubled: in each round all known steps are composed with themselves.
    """
    local = written(candidates.groupBy("file", "split").applyInPandas(
        _local_exits, "file string, split long, at long, successor long, exit long"), "exits")
    steps = local.select("file", "at", F.col("exit").alias("to"))
    reached = written(candidates.select("file").distinct().withColumn("at", F.lit(0).cast("long")), "reached")
    while True:
        more = written(reached.join(steps, ["file", "at"]).select("file", F.col("to").alias("at"))
                       .join(local.select("file", "at"), ["file", "at"], "left_semi")
                       .join(reached, ["file", "at"], "left_anti").distinct(), "reached")
        if more.isEmpty():
            break
        reached = written(reached.unionByName(more), "reached")
        ahead = steps.select("file", F.col("at").alias("to"), F.col("to").alias("next"))
        steps = written(steps.join(ahead, ["file", "to"], "left")
                        .select("file", "at", F.coalesce("next", "to").alias("to")), "steps")
    entries = local.join(reached, ["file", "at"], "left_semi").groupBy("file", "split").agg(F.min("at").alias("entry"))
    return (local.join(entries, ["file", "split"]).groupBy("file", "split")
            .applyInPandas(_local_chain, "file string, at long"))


def _fields(content: Column) -> dict[str, Column]:
    """What a record's bytes after the magic say; positions are in bytes."""
    head = F.substring_index(content.cast("string"), RECORD_END, 1)

    def header(name: str) -> Column:
        return F.nullif(F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))

    urn = rf"<{KEY_URN}(-?\d+)>"
    length = header("Content-Length").try_cast("long")
    block_at = F.octet_length(head) + len(RECORD_END)
    block = F.substring(content, block_at + 1, F.coalesce(length, F.lit(0)).cast("int"))
    http = F.substring_index(block.cast("string"), RECORD_END, 1)
    payload = F.substring(block, F.octet_length(http) + len(RECORD_END) + 1, F.length(block))
    return {
        "record_bytes": F.when(length >= 0, block_at + length + len(RECORD_END)),
        "record_type": header("WARC-Type"),
        "key": F.regexp_extract(header("WARC-Record-ID"), urn, 1).try_cast("long"),
        "refers_to": F.regexp_extract(header("WARC-Refers-To"), urn, 1).try_cast("long"),
        "uri": header("WARC-Target-URI"),
        "named_digest": F.regexp_replace(header("WARC-Payload-Digest"), "^sha1:", ""),
        "payload": payload,
    }


_RECORD = ("record_type", "key", "refers_to", "uri", "named_digest", "payload_bytes", "payload_digest")


def _described(rows: DataFrame, with_payload: bool) -> DataFrame:
    """``rows`` with the fields of their ``bytes`` in place of them."""
    fields = _fields(F.col("bytes"))
    out = rows.select(*[c for c in rows.columns if c != "bytes"], F.length("bytes").alias("n"),
                      *[c.alias(name) for name, c in fields.items()])
    out = out.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})
    return out if with_payload else out.drop("payload")


def read_archive(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record below ``path``; ``payload_digest`` and ``payload_bytes`` are of the bytes read."""
    magic = len(MAGIC)
    found = written(_described(pieces(spark, path), False), "pieces")
    # Offsets: sums of the pieces before, first inside a split, then of the splits before.
    inside = Window.partitionBy("file", "split").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = (found.groupBy("file", "split").agg(F.sum(F.col("n") + magic).alias("total"))
             .select("file", "split", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")))
    placed = written(found.withColumn("inside", F.coalesce(F.sum(F.col("n") + magic).over(inside), F.lit(0)))
                     .join(bases, ["file", "split"])
                     .withColumn("at", (F.col("base") + F.col("inside") - magic).cast("long"))
                     .withColumn("successor", F.col("at") + magic + F.col("record_bytes"))
                     .drop("inside", "base"), "placed")
    possible = placed.filter((F.col("at") >= 0) & (F.col("record_bytes") <= F.col("file_size"))
                             & (F.col("successor") <= F.col("file_size")))
    starts = written(record_starts(possible.select("file", "split", "at", "successor")), "starts")
    records = placed.join(starts, ["file", "at"])
    whole = F.col("record_bytes") <= F.col("n")
    complete = records.filter(whole).select("file", "split", "place", "at", *_RECORD)
    # Records whose payload holds the magic: put together from their pieces.
    cut = written(records.filter(~whole).select("file", F.col("at").alias("start"), "successor"), "cut-records")
    if cut.isEmpty():
        joined = None
    else:
        parts = written(placed.select("file", "split", "place", "at").join(cut, "file")
                        .filter((F.col("at") >= F.col("start")) & (F.col("at") < F.col("successor")))
                        .drop("successor"), "parts")
        again = pieces(spark, path).join(parts, ["file", "split", "place"])
        texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("bytes").cast("string").alias("b")))),
                                         lambda x: x.b), MAGIC)
        joined = _described(again.groupBy("file", "start").agg(texts.cast("binary").alias("bytes"))
                            .withColumnRenamed("start", "at"), with_payload)
    if with_payload:
        bodies = _described(pieces(spark, path), True).select("file", "split", "place", "payload")
        complete = complete.join(bodies, ["file", "split", "place"])
    wanted = ["file", "at", *_RECORD] + (["payload"] if with_payload else [])
    out = complete.select(*wanted)
    return out if joined is None else out.unionByName(joined.select(*wanted))


def round_trip(rows: DataFrame, key: str, uri: str, payload: str) -> DataFrame:
    """Write ``rows`` as an archive, read it back, and give each record its full payload's size and digest."""
    spark = rows.sparkSession
    path = scratch_path(spark, "archive")
    write_archive(rows, path, key, uri, payload)
    records = written(read_archive(spark, path), "records")
    # A payload's size goes by its digest: a key may stand on records of several payloads, or be missing.
    stored = records.filter("record_type = 'response'").groupBy(F.col("payload_digest").alias("named_digest")).agg(
        F.max("payload_bytes").alias("stored_bytes"))
    revisits = records.filter("record_type = 'revisit'").drop("payload_bytes").join(stored, "named_digest", "left")
    return (records.filter("record_type = 'response'").select("key", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to")
            .unionByName(revisits.select("key", "uri", F.col("stored_bytes").alias("payload_bytes"),
                                         F.col("named_digest").alias("payload_digest"), "record_type", "refers_to")))
