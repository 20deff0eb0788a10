"""Derived tables kept up to date batch by batch.

What a build derives is stored as partial aggregates: sums and counts, least and greatest values. A table lies in
buckets by the hash of its keys. A batch is aggregated on its own, merged with the stored rows of the buckets
it touches, and these are written as new versions beside the old ones; last of all goes the batch's list of the
version of every bucket, which makes the batch count. So a batch that failed half-way or comes
again changes nothing twice, buckets that it doesn't touch are neither read nor written, and readers see
whole batches only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portmesh.operators import rollups as roll
from portmesh.tables import Model, partition_columns

#: Buckets of a table. The list of their versions is this long.
BUCKETS = 64


@dataclass(frozen=True)
class Kept:
    """A table of partial aggregates below ``root``: its keys, and which columns are added, least or greatest."""

    root: str
    name: str
    keys: Sequence[str]
    sums: Sequence[str] = ()
    lows: Sequence[str] = ()
    highs: Sequence[str] = ()
    buckets: int = BUCKETS

    @property
    def _lists(self) -> str:
        return f"{self.root}/{self.name}/lists"

    def versions(self, spark: SparkSession) -> tuple[int, dict[int, int]]:
        """The last batch that counts (-1: none) and the batch that wrote each bucket's rows."""
        try:
            lists = spark.read.parquet(self._lists)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
                return -1, {}
            raise
        last = lists.agg(F.max("batch")).first()[0]
        if last is None:
            return -1, {}
        found = lists.where(F.col("batch") == last).collect()  # a row per bucket
        return last, {r["bucket"]: r["version"] for r in found if r["bucket"] >= 0}

    def _rows(self, spark: SparkSession, versions: dict[int, int]) -> DataFrame | None:
        if not versions:
            return None
        folder = f"{self.root}/{self.name}/rows"
        paths = [f"{folder}/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        return spark.read.parquet(*paths)

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The rows as of the last batch; None before any."""
        return self._rows(spark, self.versions(spark)[1])

    def merge(self, partial: DataFrame, batch: int) -> bool:
        """Add a batch, numbered from 0 in rising order; False if it was there already."""
        spark = partial.sparkSession
        last, versions = self.versions(spark)
        if batch <= last:
            return False
        columns = [*self.keys, *self.sums, *self.lows, *self.highs]
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        merged = self._merged(partial.select(*columns)).withColumn("bucket", bucket)
        touched = [r[0] for r in merged.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        old = self._rows(spark, {b: v for b, v in versions.items() if b in touched})
        if old is not None:
            both = merged.drop("bucket").unionByName(old.select(*columns))
            merged = self._merged(both).withColumn("bucket", bucket)
        if touched:
            merged.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(
                f"{self.root}/{self.name}/rows/version={batch}"
            )
        now = {-1: batch} | versions | dict.fromkeys(touched, batch)
        listed = spark.createDataFrame([(b, v) for b, v in now.items()], "bucket int, version long")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self._lists}/batch={batch}")
        return True

    def _merged(self, rows: DataFrame) -> DataFrame:
        parts = [(F.sum, self.sums), (F.min, self.lows), (F.max, self.highs)]
        return rows.groupBy(*self.keys).agg(*(f(c).alias(c) for f, names in parts for c in names))


class KeptModel:
    """The derived tables of a run whose events and states arrive in batches.

    ``parts`` are the given partitions of its devices and ``columns`` the numeric state columns to average; states need
    ``id``, ``epoch`` and ``init``.
    """

    def __init__(self, root: str, parts: DataFrame, columns: Sequence[str], buckets: int = BUCKETS):
        self.parts, self.path, self.columns = parts, partition_columns(parts), list(columns)
        sums = [f"{kind}_{c}" for c in self.columns for kind in ("n", "sum")]
        self.counts = Kept(root, "message_counts", ["dev"], ["messages_sent", "messages_received"], buckets=buckets)
        self.ranges = Kept(root, "value_ranges", ["state"], lows=["min"], highs=["max"], buckets=1)
        self.time = Kept(root, "time", ["name"], highs=["max"], buckets=1)
        self.states = Kept(root, "state_sums", [*self.path, "epoch", "init"], sums, buckets=buckets)

    def add(self, batch: int, events: DataFrame | None = None, states: DataFrame | None = None) -> list[str]:
        """Add a batch to every table that it has rows for; the names of the tables it changed."""
        done = []

        def merge(kept: Kept, partial: DataFrame) -> None:
            if kept.merge(partial, batch):
                done.append(kept.name)

        if events is not None:
            merge(self.counts, roll.message_counts(events))
            merge(self.ranges, roll.value_ranges(events))
            merge(self.time, events.groupBy(F.lit("time").alias("name")).agg(F.max("time").alias("max")))
        if states is not None:
            sums = [x for c in self.columns for x in (F.count(c).alias(f"n_{c}"), F.sum(F.col(c).cast("double")).alias(f"sum_{c}"))]
            placed = states.join(self.parts.select("id", *self.path), "id")
            merge(self.states, placed.groupBy(*self.path, "epoch", "init").agg(*sums))
        return done

    def model(self, spark: SparkSession, limit: float = 100.0, properties: DataFrame | None = None) -> Model:
        """The tables as a build of all batches would have them."""
        tables: dict[str, DataFrame] = {"device_partitions": self.parts}
        counts = self.counts.read(spark)
        if counts is not None:
            names = ["messages_sent", "messages_received"]
            top = counts.agg(*[F.max(c).cast("double").alias(c) for c in names])
            busiest = reduce(
                DataFrame.unionByName,
                [top.select(F.lit(c).alias("state"), F.lit(0.0).alias("min"), F.col(c).alias("max")) for c in names],
            )
            ranges = self.ranges.read(spark)
            tables["value_ranges"] = busiest if ranges is None else ranges.select("state", "min", "max").unionByName(busiest)
            last = F.ceil(F.least(F.lit(float(limit)), "max")).cast("bigint").alias("max")
            levels = spark.createDataFrame([("level", len(self.path) + 1)], "name string, max long")
            tables["meta"] = self.time.read(spark).select("name", last).unionByName(levels)
        sums = self.states.read(spark)
        if sums is not None:
            means = [(F.sum(f"sum_{c}") / F.sum(f"n_{c}")).alias(c) for c in self.columns]
            levels = []
            for level, part in enumerate(self.path):
                parent = roll.parent_id(F.col(part))
                own = sums.groupBy(part, "epoch", "init").agg(*means)
                levels.append(own.select(F.lit(level).alias("level"), parent.alias("parent"), F.col(part).alias("partition_id"), "epoch", "init", *self.columns))
            tables["state_rollup"] = reduce(DataFrame.unionByName, levels)
        if properties is not None:
            sent = None if counts is None else counts.select("dev", "messages_sent", "messages_received")
            tables["property_rollup"] = roll.property_rollup(properties, self.parts, sent)
        return Model(**tables)
