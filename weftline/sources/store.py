"""A keyed store: rows by key and step in bucketed, sorted runs.

Every write is a run, dealt and sorted by key once; what reads the store by key (the latest row of each key, joins with
another store of as many buckets, compaction) finds its rows dealt already and exchanges none. A lookup reads the
buckets of its keys alone. Of rows with one key and step, the one of the latest run counts; compaction merges the runs
into a new generation, which the log publishes in one stroke.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.versions import Versions

RUN = "_run"


class KeyStore:
    """schema must hold key and step; steps order a key's rows."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, step: str, buckets: int = 16) -> None:
        self.spark, self.root, self.key, self.step, self.buckets = spark, root.rstrip("/"), key, step, buckets
        self.schema = f"{schema}, {RUN} bigint"
        self.columns = [f.name for f in spark.createDataFrame([], schema).schema]
        self.log = Versions(spark, self.root)
        if not self.log.list():
            self.log.publish(uuid.uuid4().hex)
        self._open()

    def _open(self) -> None:
        """The published generation as a table of this session."""
        self.folder = self.log.entry()["folders"][0]
        self.name = self._table(self.folder)
        self.run = (self.rows().agg(F.max(RUN)).first()[0] or 0) + 1

    def _table(self, folder: str) -> str:
        name = f"weftline_store_{folder}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({self.schema}) USING parquet CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/_data/{folder}'"
        )
        return name

    def rows(self) -> DataFrame:
        """All runs as they are."""
        return self.spark.table(self.name)

    def put(self, rows: DataFrame) -> None:
        """A run of rows."""
        dealt = rows.select(*self.columns, F.lit(self.run).cast("long").alias(RUN)).repartition(self.buckets, self.key).sortWithinPartitions(self.key)
        dealt.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        self.run += 1

    def _last(self, rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
        rest = [c for c in self.columns if c not in keys]
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_x"))
        return best.select(*[F.col(c) if c in keys else F.col(f"_x.{c}").alias(c) for c in self.columns])

    def steps(self, where: Column | None = None) -> DataFrame:
        """Each key's rows, one a step."""
        rows = self.rows() if where is None else self.rows().filter(where)
        return self._last(rows, [self.key, self.step], [RUN])

    def latest(self) -> DataFrame:
        """Each key's row of the last step."""
        return self._last(self.rows(), [self.key], [self.step, RUN])

    def lookup(self, *keys) -> DataFrame:
        """The last rows of these keys, from their buckets."""
        return self._last(self.rows().filter(F.col(self.key).isin(list(keys))), [self.key], [self.step, RUN])

    def beside(self, other: KeyStore, n: int = 1) -> DataFrame:
        """This store's step s - n beside the other's step s, as (key, step, before, now): buckets meet where they lie."""
        pack = lambda s, name: s.steps().select(F.col(s.key).alias("key"), F.col(s.step).alias("step"), F.struct(*[c for c in s.columns if c not in (s.key, s.step)]).alias(name))
        # a map a key, as stores lie by key alone: what is joined on more would be dealt again
        before = pack(self, "before").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("step", "before"))).alias("_steps"))
        met = pack(other, "now").join(before, "key").withColumn("before", F.try_element_at("_steps", F.col("step") - n))
        return met.filter("before is not null").select("key", "step", "before", "now")

    def compact(self, steps: bool = True) -> None:
        """The runs merged: of each key all steps, or the last alone. Readers have the old generation until the new one is
        whole."""
        merged = (self.steps() if steps else self.latest()).withColumn(RUN, F.lit(self.run).cast("long"))
        folder = uuid.uuid4().hex
        name = self._table(folder)
        merged.sortWithinPartitions(self.key).write.insertInto(name)
        self.log.publish(folder, base=self.log.entry()["version"])
        self._open()
