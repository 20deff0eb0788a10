"""Snapshots as pixel tables and answers as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portmesh.functions.style import heat_channels


def raster(
    states: DataFrame,
    positions: DataFrame,
    value: Column,
    low: float,
    high: float,
    keys: tuple[str, ...] = ("epoch", "init"),
) -> DataFrame:
    """Pixels (keys, x, y, r, g, b): every device's heat colour at its place, from (0, 0).

    ``positions(id, x, y)``; devices without a value have no pixel.
    """
    corner = positions.agg(F.min("x").alias("x"), F.min("y").alias("y"))
    placed = states.join(positions, "id").withColumn("_v", value).filter(F.col("_v").isNotNull())
    r, g, b = heat_channels(F.col("_v"), low, high)
    return placed.select(
        *keys,
        (F.col("x") - corner.select("x").scalar()).cast("bigint").alias("x"),
        (F.col("y") - corner.select("y").scalar()).cast("bigint").alias("y"),
        r.alias("r"),
        g.alias("g"),
        b.alias("b"),
    )


def as_json(df: DataFrame, alias: str = "json") -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct("*")).alias(alias))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)
