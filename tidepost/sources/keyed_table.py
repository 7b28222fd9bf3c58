"""A keyed posting table kept as Parquet folders.

``snapshot=<n>`` holds one row per key, ``changes=<n>`` the whole new rows of one write. Reading
lays the changes after the newest snapshot over it; writing never touches a folder that is being
read. A write may carry a tag, and a tag counts once, which makes retried streaming batches safe.
A folder whose writer made sure of one row per key says so in its key column's metadata; its rows are
read as they lie, and a later write of a key is told by keys and write numbers alone.
One writer at a time is assumed. Of several rows of a key the last written counts; a table with
``by_order`` goes by the declared order first, so that late older rows do not replace newer ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepost.operators import keyed
from tidepost.operators.frames import evolve_schema
from tidepost.settings import posting_schema

# Metadata of the key column in folders that hold one row per key.
ONE_PER_KEY = "one_row_per_key"
_UNMARKED = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | None = None,
                 key: str = "job_id", order: Sequence[str] = ("scraped_at",), by_order: bool = False):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema, self.key, self.order = schema or posting_schema(), key, list(order)
        self.by_order = by_order

    def _finished(self, kind: str) -> dict[int, str]:
        """Complete folders of one kind: number to folder name."""
        jvm = self.spark._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}=*/_SUCCESS")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern)
        names = [status.getPath().getParent().getName() for status in found or []]
        return {int(name.split("=")[1].split("-")[0]): name for name in sorted(names)}

    def _state(self) -> tuple[int, list[int]]:
        snapshot = max(self._finished("snapshot"), default=-1)
        return snapshot, sorted(n for n in self._finished("changes") if n > snapshot)

    def _load(self, kind: str, number: int) -> tuple[DataFrame, bool]:
        """A folder's rows, and whether it is known to hold one per key."""
        path = f"{self.path}/{self._finished(kind)[number]}"
        schema = self.spark.read.parquet(path).schema
        once = ONE_PER_KEY in schema[self.key].metadata
        plain = T.StructType([T.StructField(f.name, f.dataType, f.nullable) for f in schema])
        return self.spark.read.schema(plain).parquet(path), once

    def read(self) -> DataFrame:
        """One row per key. Columns an older folder lacks are NULL; columns that only the folders
        have (from a wider schema) stay."""
        snapshot, changes = self._state()
        base = (self._load("snapshot", snapshot)[0] if snapshot >= 0
                else self.spark.createDataFrame([], self.schema))
        if not changes:
            return evolve_schema(base, self.schema)
        loaded = {n: self._load("changes", n) for n in changes}
        parts = [part.withColumn("_write", F.lit(n)) for n, (part, _) in loaded.items()]
        merged = parts[0]
        for part in parts[1:]:
            merged = merged.unionByName(part, allowMissingColumns=True)
        if self.by_order:
            both = base.withColumn("_write", F.lit(-1)).unionByName(merged, allowMissingColumns=True)
            latest = keyed.first_per_key(both, [self.key], [*self.order, "_write"], last=True)
        else:
            loose = [n for n, (_, once) in loaded.items() if not once]
            latest = self._last_writes(merged, loose, len(changes))
            if snapshot >= 0:
                latest = keyed.replace_rows(base, latest, merged.select(self.key).distinct(), self.key)
        return evolve_schema(latest.drop("_write"), self.schema)

    def _last_writes(self, merged: DataFrame, loose: list[int], writes: int) -> DataFrame:
        """The row of each key's last write. Rows of the ``loose`` writes may repeat a key within one."""
        if loose:
            is_loose = F.col("_write").isin(loose)
            one = keyed.first_per_key(merged.filter(is_loose), [self.key], ["_write"], last=True)
            merged = one if len(loose) == writes else merged.filter(~is_loose).unionByName(one)
        if len(loose) == writes or writes == 1:
            return merged
        last = merged.groupBy(F.col(self.key).alias("_key")).agg(
            F.max("_write").alias("_last"), F.count("*").alias("_n")).filter("_n > 1")
        outdated = F.col(self.key).eqNullSafe(F.col("_key")) & (F.col("_write") < F.col("_last"))
        return merged.join(last, outdated, "left_anti")

    def _next_number(self) -> int:
        return max([*self._finished("changes"), *self._finished("snapshot")], default=-1) + 1

    def _write(self, rows: DataFrame, tag: str | None, once: bool = False) -> int:
        """Write one change folder. A tag names the write, and a tag already written is skipped."""
        if tag is not None:
            for number, name in self._finished("changes").items():
                if name == f"changes={number}-{tag}":
                    return number
        number = self._next_number()
        name = f"changes={number}" + (f"-{tag}" if tag is not None else "")
        self._in_schema(rows, once).write.mode("overwrite").parquet(f"{self.path}/{name}")
        return number

    def _in_schema(self, rows: DataFrame, once: bool) -> DataFrame:
        """Rows as a change folder holds them; ``once``: the caller knows that no key repeats."""
        rows = evolve_schema(rows, self.schema)
        return rows.withMetadata(self.key, {ONE_PER_KEY: True}) if once else rows

    def stage(self, rows: DataFrame) -> tuple[int, DataFrame]:
        """Write whole new rows, one per key, as a change that does not count before it is published.

        Returns its number and the rows as written. A change that is never published is overwritten by the next write.
        """
        number = self._next_number()
        path = f"{self.path}/changes={number}"
        self._in_schema(rows, once=True).write.mode("overwrite").options(**_UNMARKED).parquet(path)
        return number, self.spark.read.schema(self._in_schema(rows, once=False).schema).parquet(path)

    def publish(self, number: int) -> None:
        """Let a staged change count: it gets the mark of a finished write."""
        if number != self._next_number():
            raise RuntimeError(f"{self.path} was written to after change {number} was staged")
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/changes={number}/_SUCCESS")
        mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(mark, True).close()

    def upsert(self, rows: DataFrame, tag: str | None = None, scraped_at: object = None) -> int:
        """Replace whole rows by key; what the new row does not have is NULL afterwards.

        ``scraped_at`` stamps rows that do not say when they were fetched, as pages do not.
        """
        known = rows.select(*[c for c in rows.columns if c in self.schema.names])
        if scraped_at is not None:
            stamp = F.lit(scraped_at).cast(self.schema["scraped_at"].dataType)
            known = known.withColumn("scraped_at", F.coalesce("scraped_at", stamp) if "scraped_at" in known.columns else stamp)
        missing = [c for c in self.order if c not in known.columns]
        known = known.withColumns({c: F.lit(None).cast(self.schema[c].dataType) for c in missing})
        return self._write(keyed.first_per_key(known, [self.key], self.order, last=True), tag, once=True)

    def update(self, updates: DataFrame, tag: str | None = None) -> int:
        """Set columns of existing rows; unknown keys are ignored."""
        stored = self.read()
        names = [c for c in updates.columns if c != self.key]
        new = updates.select(self.key, *[F.col(c).alias(f"_set_{c}") for c in names])
        columns = [*stored.columns, *[c for c in names if c not in stored.columns]]
        return self._write(stored.join(new, self.key).select(
            *[F.col(f"_set_{c}").alias(c) if c in names else F.col(c) for c in columns]), tag)

    def compact(self) -> int:
        """Fold the changes into a new snapshot."""
        snapshot, changes = self._state()
        if not changes:
            return snapshot
        number = changes[-1]
        self.read().write.mode("overwrite").parquet(f"{self.path}/snapshot={number}")
        return number

    def unscored(self) -> DataFrame:
        return keyed.unscored(self.read())

    def new_rows(self, incoming: DataFrame) -> DataFrame:
        return keyed.new_rows(incoming, self.read(), self.key)

    def rows_to_fetch(self, incoming: DataFrame) -> DataFrame:
        return keyed.rows_to_fetch(incoming, self.read(), self.key)
