"""Keyword bins of any size: phrases as a table, found by an index on each phrase's rarest word.

A phrase is in a text when all its words are. Each phrase is posted under its rarest word, by the number of
texts that have the word; a text's words meet only these postings. A candidate that is found asks for its other
words, one by one and rarest first, so that most candidates end with the first question. Texts and phrases meet by word,
as integers, never each text with each phrase.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepost.functions.text import lowered_tokens
from tidepost.session import scratch_path


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def phrase_table(phrases: DataFrame, bin_name: str = "bin", phrase: str = "phrase") -> DataFrame:
    """(phrase_id, bin, copies, words) of the distinct word sets of each bin; phrases without words have none."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.col(phrase)), "\\s+"), lambda w: w != "")))
    sets = phrases.select(F.col(bin_name).alias("bin"), words.alias("words")).filter(F.size("words") > 0)
    counted = sets.groupBy("bin", "words").agg(F.count("*").alias("copies"))
    return counted.withColumn("phrase_id", F.monotonically_increasing_id())


def word_hits(df: DataFrame, key: str, text: str, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, word), (word, word_id, texts)): the dictionary's words as integers, and where they stand, each once a text."""
    known = _written(table.select(F.explode("words").alias("word")).distinct()
                     .withColumn("word_id", F.monotonically_increasing_id()), "dictionary-words")
    tokens = df.select(F.col(key).alias("key"), F.explode(F.array_distinct(lowered_tokens(F.col(text)))).alias("word"))
    hits = _written(tokens.join(known, "word").select("key", F.col("word_id").alias("word")), "dictionary-hits")
    texts = hits.groupBy("word").agg(F.count("*").alias("texts"))
    return hits, known.join(texts.withColumnRenamed("word", "word_id"), "word_id", "left").fillna(0, ["texts"])


def phrase_hits(df: DataFrame, key: str, text: str, phrases: DataFrame, bin_name: str = "bin",
                phrase: str = "phrase") -> DataFrame:
    """(key, bin, phrase_id, copies) for every phrase whose words all stand in the text."""
    table = _written(phrase_table(phrases, bin_name, phrase), "phrases")
    hits, words = word_hits(df, key, text, table)
    spread = table.select("phrase_id", F.explode("words").alias("word")).join(words, "word")
    # Rarest first; among equals the smaller number.
    ordered = _written(spread.groupBy("phrase_id").agg(
        F.array_sort(F.collect_list(F.struct("texts", "word_id"))).alias("asked"))
        .join(table.drop("words"), "phrase_id")
        .select("phrase_id", "bin", "copies", F.col("asked.word_id").alias("asked")), "postings")
    longest = ordered.agg(F.max(F.size("asked")).alias("n")).first().n or 0
    found = hits.join(ordered.withColumn("word", F.element_at("asked", 1)), "word").drop("word")
    done = found.filter(F.size("asked") == 1)
    for i in range(2, longest + 1):
        left = found.filter(F.size("asked") >= i).withColumn("word", F.element_at("asked", F.lit(i)))
        found = _written(left.join(hits, ["key", "word"], "left_semi").drop("word"), "candidates")
        done = done.unionByName(found.filter(F.size("asked") == i))
    return done.select("key", "bin", "phrase_id", "copies")


def keyword_hits(df: DataFrame, key: str, text: str, phrases: DataFrame, bins: Sequence[str], prefix: str = "keyword_",
                 bin_name: str = "bin", phrase: str = "phrase") -> DataFrame:
    """(key, ``keyword_<bin>``...): phrases of each bin whose every word occurs in the text, a phrase as often as its
    bin lists it. Keys are unique; texts without a hit have zeros."""
    per_bin = phrase_hits(df, key, text, phrases, bin_name, phrase).groupBy(F.col("key").alias("_key")).pivot("bin", list(bins)).agg(
        F.sum("copies"))
    joined = df.select(key).join(per_bin, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.select(key, *[F.coalesce(F.col(f"`{b}`"), F.lit(0)).cast("long").alias(prefix + b) for b in bins])
