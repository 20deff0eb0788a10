"""Model tables as Parquet folders."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portmesh.tables import LEVELLED, Model

MODES = ("overwrite", "ignore", "errorifexists", "append")
# Levelled tables are laid out by these columns, so that readers skip files and row groups.
RANGE_KEY = "parent"


def save_table(df: DataFrame, path: str, name: str, mode: str = "errorifexists") -> None:
    """Write one table; tables with a level get one folder per level."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if name in LEVELLED and RANGE_KEY in df.columns:
        by = ["level", RANGE_KEY]
        df = df.repartitionByRange(*by).sortWithinPartitions(*by)
    writer = df.write.mode(mode)
    if name in LEVELLED:
        writer = writer.partitionBy("level")
    writer.parquet(f"{path}/{name}")


def save_model(model: Model, path: str, mode: str = "errorifexists", together: int = 4) -> None:
    """Write all tables of a model, up to ``together`` at a time, as they do not depend on each
    other."""
    with ThreadPoolExecutor(together) as pool:
        jobs = [
            pool.submit(inheritable_thread_target(df.sparkSession)(save_table), df, path, name, mode)
            for name, df in model.tables().items()
        ]
        for job in jobs:
            job.result()


def load_model(spark: SparkSession, path: str, names: list[str]) -> Model:
    """Tables written by ``save_model``; partition pruning applies to ``level``."""
    loaded = {}
    for name in names:
        df = spark.read.parquet(f"{path}/{name}")
        loaded[name] = df.withColumn("level", F.col("level").cast("int")) if name in LEVELLED else df
    return Model(**loaded)
