"""URL filters by dated lists: every capture is judged by the list as it was when the page was fetched.

List entries are dated changes (add or remove of a host, a domain with its subdomains, or a path prefix).
Per entry key the changes become validity intervals: from an add to the next change. A capture has one key
per level of its host and of its path, as deep as the longest entry of the lists; keys are equi-joined with
the intervals and the fetch time picks those that hold. The join carries keys only; verdicts are folded per
capture.

Defined cases: null url or fetch time matches nothing; the last of equal-dated changes wins by order of
action (remove after add); repeated changes are one; an add never removed holds for ever; repeated captures
are judged each; no entries or no captures give unblocked, or no, rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepost.llm.store import written


def host_of(url: Column) -> Column:
    """Lower-case host of a url, without user, port and trailing dot."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:\d*)?$", ""))
    return F.nullif(host, F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*([^?#]*)", 1)


def intervals(changes: DataFrame) -> DataFrame:
    """(kind, value, category, valid_from, valid_to) from dated changes (kind, value, category, action, at)."""
    key = Window.partitionBy("kind", "value", "category").orderBy("at")
    state = (changes.filter("at is not null and value is not null")
             .groupBy("kind", "value", "category", "at").agg(F.max("action").alias("action")))  # remove > add
    turned = state.withColumn("before", F.lag("action").over(key)).filter(~F.col("action").eqNullSafe(F.col("before")))
    return (turned.withColumn("valid_to", F.lead("at").over(key)).filter("action = 'add'")
            .select("kind", "value", "category", F.col("at").alias("valid_from"), "valid_to"))


def _keys(url: Column, host_levels: int, path_levels: int) -> Column:
    """Every (kind, value) that could name the url in lists whose longest entries have so many levels."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.least(F.size(labels), F.lit(max(host_levels, 1)))
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(labels, -i, i), ".").alias("value")))
    parts = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    depth = F.least(F.size(parts), F.lit(path_levels))
    steps = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    prefixes = F.transform(steps, lambda i: F.struct(
        F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("value")))
    exact = F.array(F.struct(F.lit("host").alias("kind"), host.alias("value")))
    return F.when(host.isNotNull(), F.concat(exact, domains, prefixes)).otherwise(
        F.array().cast("array<struct<kind:string,value:string>>"))


def judge(captures: DataFrame, changes: DataFrame, key: str = "page_id", url: str = "url",
          fetched: str = "fetched_at") -> DataFrame:
    """Per capture: host, whether it was listed when fetched, the categories and the number of entries."""
    rows = captures.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(fetched).alias("fetched_at"))
    valid = written(intervals(changes), "intervals")
    # No key is longer than the longest entry that the lists hold.
    levels = valid.agg(F.max(F.when(F.col("kind") == "domain", F.size(F.split("value", r"\.")))).alias("host"),
                       F.max(F.when(F.col("kind") == "prefix", F.size(F.split("value", "/")) - 1)).alias("path")).first()
    keys = _keys(F.col("url"), levels.host or 0, levels.path or 0)
    asked = rows.select("url", "fetched_at").distinct()  # equal captures are asked once
    hits = (asked.select("url", "fetched_at", F.inline(keys)).join(valid, ["kind", "value"])
            .filter((F.col("fetched_at") >= F.col("valid_from"))
                    & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))))
    verdicts = hits.groupBy("url", "fetched_at").agg(
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.count(F.lit(1)).alias("n_entries"))
    return (rows.join(verdicts, ["url", "fetched_at"], "left")
            .select("key", "url", host_of(F.col("url")).alias("host"), "fetched_at", F.col("n_entries").isNotNull().alias("blocked"),
                    F.coalesce("categories", F.lit("")).alias("categories"), F.coalesce("n_entries", F.lit(0)).alias("n_entries")))
