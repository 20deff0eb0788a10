"""State snapshots of devices and edges from XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portmesh.functions.scalars import is_init, parse_int, sampled, within_limit
from portmesh.sources.xml_graph import TEXT, _struct
from portmesh.sources.xml_scan import parsed, scan_elements

DEVICE = _struct(_id=TEXT, _rts=TEXT, S=TEXT)
EDGE = _struct(_id=TEXT, _firings=TEXT, S=TEXT, Q=_struct(M=T.ArrayType(TEXT)))


def _snapshots(
    spark: SparkSession,
    path: str,
    member: str,
    schema: T.StructType,
    max_epoch: float | None,
    granularity: int,
) -> DataFrame:
    """Elements of snapshots of any size: a row is one device or edge, and knows the opening tag of its
    snapshot."""
    raw = scan_elements(spark, path, member, "GraphSnapshot", "graphInstId sequenceNumber orchestratorTime")
    header = lambda i: F.get("around", F.lit(i))
    time = header(2).cast("double")
    kept = raw.filter(sampled(F.floor(time), granularity))
    if max_epoch is not None:
        kept = kept.filter(within_limit(time, max_epoch))
    sequence = header(1).cast("bigint")
    return parsed(kept, member, schema).select(
        header(0).alias("graph_id"),
        sequence.alias("sequence"),
        F.floor(time).cast("bigint").alias("epoch"),
        is_init(time, sequence).alias("init"),
        F.struct(*(F.col(f.name) for f in schema)).alias("_item"),
    )


def read_device_states(
    spark: SparkSession, path: str, max_epoch: float | None = None, granularity: int = 0
) -> DataFrame:
    """Device states: one row per device element, state as brace-less JSON text.

    Keeps epochs divisible by ``10 ** granularity`` up to ``max_epoch``. A missing ready mask is 0.
    """
    rows = _snapshots(spark, path, "DevS", DEVICE, max_epoch, granularity)
    return rows.select(
        F.col("_item._id").alias("id"),
        "graph_id",
        "sequence",
        "epoch",
        "init",
        F.coalesce(parse_int(F.col("_item._rts"), 16), F.lit(0)).alias("rts"),
        F.col("_item.S").alias("state"),
    )


def read_edge_states(
    spark: SparkSession, path: str, max_epoch: float | None = None, granularity: int = 0
) -> DataFrame:
    """Edge states with firings (hexadecimal in the file) and the queue of messages in flight."""
    rows = _snapshots(spark, path, "EdgeS", EDGE, max_epoch, granularity)
    queue = F.coalesce(F.col("_item.Q.M"), F.array().cast("array<string>"))
    return rows.select(
        F.col("_item._id").alias("id"),
        "graph_id",
        "sequence",
        "epoch",
        "init",
        F.coalesce(parse_int(F.col("_item._firings"), 16), F.lit(0)).alias("firings"),
        F.col("_item.S").alias("state"),
        queue.alias("messages"),
        F.size(queue).cast("bigint").alias("queued"),
    )
