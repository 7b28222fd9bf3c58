"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepost.llm import (alignment, fingerprint, gridcodes, license, linededup, mixing, packing, quality, secrets, setsketch,
                          template, urlfilter, warc)
from tidepost.llm.store import ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = shipped
    return f


@_query
def op8_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "failed_rules", "host_rejected")


@_query
def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@_query
def op1_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op6_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept")


@_query
def op9_bloom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(F.col("c0").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@_query
def op4_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@_query
def op2_raked_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixing.calibrated(docs, mixing.Targets()).select(
        F.col("c0").alias("doc_id"), "source", "lang", "topic", "n_tokens", "probability", "kept")


@_query
def op3_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.extract(table(spark, sf_dir, "pages"))


def list_changes(pages: DataFrame) -> DataFrame:
    """Dated list changes about the hosts of ``pages``, drawn from their names by md5."""
    hosts = pages.select(urlfilter.host_of(F.col("url")).alias("host")).filter("host is not null").distinct()
    drawn = hosts.withColumn("v", F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int"))
    category = (F.when(F.col("host").rlike("casino|bets"), "gambling").when(F.col("host").rlike("pills"), "pharma")
                .when(F.col("host").rlike("adult"), "adult").when(F.col("host").rlike("spam|ads"), "spam")
                .otherwise("watch"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("v") % 200)
    entry = drawn.select(
        F.when(F.col("v") % 3 == 0, "domain").when(F.col("v") % 3 == 1, "host").otherwise("prefix").alias("kind"),
        F.when(F.col("v") % 3 == 2, F.concat("host", F.lit("/en"))).otherwise(F.col("host")).alias("value"),
        category.alias("category"), day.alias("day"), "v")
    change = [("add", 0, F.lit(True)), ("remove", 60, F.col("v") % 4 != 0), ("add", 90, F.col("v") % 5 == 0)]
    return entry.select("kind", "value", "category", F.inline(F.filter(F.array(*[
        F.struct(F.lit(action).alias("action"), F.date_add("day", after).alias("at"), when.alias("holds"))
        for action, after, when in change]), lambda x: x.holds))).drop("holds")


@_query
def op5_dated_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"),
                                                         (F.col("page_id") % 366).cast("int")).alias("fetched_at"))
    return urlfilter.judge(captures, list_changes(pages)).withColumnRenamed("key", "page_id").withColumn(
        "fetched_at", F.col("fetched_at").cast("string"))


@_query
def op7_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


@_query
def op13_grid_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = gridcodes.compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return rows.select(F.col("key").alias("vec_id"), gridcodes.hex_codes(F.col("codes")).alias("code"), "error",
                       "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


@_query
def op12_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), "doc_id", "text", *paths).withColumnRenamed("key", "doc_id")


@_query
def op11_secret_lexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), "doc_id", "text").drop("found").withColumnRenamed("key", "doc_id")
