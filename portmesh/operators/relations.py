"""Joins between devices, edges, partitions, states and events, and ordered selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portmesh.functions.scalars import edge_id
from portmesh.operators.skew import ROWS_PER_RUN, last_known


def devices_with_types(devices: DataFrame, device_types: DataFrame) -> DataFrame:
    """Devices with the row of their type; devices of unknown type are left to the checks."""
    return devices.join(device_types.withColumnRenamed("id", "type"), "type")


def resolve_edges(edges: DataFrame, devices: DataFrame, ports: DataFrame) -> DataFrame:
    """Edges with the types of both ends and the message types of both ports.

    The left joins keep edges whose ends or ports do not exist, with NULLs, for the checks.
    """
    kind = devices.select("id", "type")
    out_ports = ports.filter(F.col("direction") == "output").select(
        F.col("device_type").alias("source_type"),
        F.col("name").alias("source_port"),
        F.col("message_type"),
    )
    in_ports = ports.filter(F.col("direction") == "input").select(
        F.col("device_type").alias("target_type"),
        F.col("name").alias("target_port"),
        F.col("message_type").alias("target_message_type"),
    )
    return (
        edges.join(kind.toDF("source", "source_type"), "source", "left")
        .join(kind.toDF("target", "target_type"), "target", "left")
        .join(out_ports, ["source_type", "source_port"], "left")
        .join(in_ports, ["target_type", "target_port"], "left")
    )


def edges_with_partitions(
    edges: DataFrame, parts: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Edges with the given partition columns of their source and of their target.

    Only the end points and the named columns reach the two joins. A hub that owns many edges makes
    one skewed partition on the edge side only, which adaptive execution splits.
    """
    columns = list(columns)
    near = parts.select(F.col("id").alias("source"), *[F.col(c).alias(f"source_{c}") for c in columns])
    far = parts.select(F.col("id").alias("target"), *[F.col(c).alias(f"target_{c}") for c in columns])
    return edges.join(near, "source").join(far, "target")


def states_of_partition(
    states: DataFrame, properties: DataFrame, parts: DataFrame, partition: str, column: str
) -> DataFrame:
    """States with properties for the devices of one partition."""
    members = parts.filter(F.col(column) == partition).select("id")
    wanted = states.join(members, "id", "left_semi")
    return wanted.join(properties, "id")


def events_of_partition(
    events: DataFrame, parts: DataFrame, partition: str, column: str, start: float, end: float
) -> DataFrame:
    """Events of the devices of one partition with ``start <= time <= end``."""
    members = parts.filter(F.col(column) == partition).select(F.col("id").alias("dev"))
    return events.filter(F.col("time").between(start, end)).join(members, "dev", "left_semi")


def message_pairs(events: DataFrame) -> DataFrame:
    """Every receive with its send: both ends, times, latency and the message body of the send."""
    has = set(events.columns)
    optional = lambda name: F.col(name) if name in has else F.lit(None).cast("string")
    sends = events.filter(F.col("type") == "send").select(
        F.col("id").alias("send_id"),
        F.col("dev").alias("source"),
        optional("port").alias("source_port"),
        F.col("time").alias("send_time"),
        optional("m").alias("message"),
    )
    recvs = events.filter(F.col("type") == "recv").select(
        F.col("id").alias("recv_id"),
        F.col("send_id"),
        F.col("dev").alias("target"),
        optional("port").alias("target_port"),
        F.col("time").alias("recv_time"),
    )
    return recvs.join(sends, "send_id").withColumn(
        "latency", F.col("recv_time") - F.col("send_time")
    )


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Undirected one-hop neighbours of a set of devices, one row per edge.

    Each edge is looked at from both ends; an edge from a device to itself appears once.
    """
    ends = edges.select(
        F.explode(
            F.when(
                F.col("source") == F.col("target"),
                F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("neighbour"))),
            ).otherwise(
                F.array(
                    F.struct(F.col("source").alias("id"), F.col("target").alias("neighbour")),
                    F.struct(F.col("target").alias("id"), F.col("source").alias("neighbour")),
                )
            )
        ).alias("n"),
        edge_id().alias("edge"),
    ).select("n.id", "n.neighbour", "edge")
    return ends.join(ids.select("id").distinct(), "id", "left_semi")


#: Snapshots whose keys stand in one list next to a device.
SNAPSHOTS_PER_BLOCK = 1000


def complete_snapshot(
    states: DataFrame,
    devices: DataFrame,
    defaults: dict[str, object],
    epochs: DataFrame | None = None,
    keys: Sequence[str] = ("epoch", "init"),
    snapshots_per_block: int = SNAPSHOTS_PER_BLOCK,
) -> DataFrame:
    """Every device in every snapshot: missing states take ``defaults``, a missing mask is 0.

    The grid of devices and snapshots is the result's own size. Snapshots are dealt by a hash into blocks of
    about ``SNAPSHOTS_PER_BLOCK``; a device is joined with each block and the block's list is exploded next
    to it, so no row holds the list of all snapshots.
    """
    epochs = states.select(*keys).distinct() if epochs is None else epochs
    blocks = F.greatest(F.lit(1), F.ceil(epochs.agg(F.count("*")).scalar() / snapshots_per_block)).cast("int")
    listed = (
        epochs.select(F.struct(*keys).alias("_s"), F.pmod(F.xxhash64(*keys), blocks).cast("int").alias("_b"))
        .groupBy("_b")
        .agg(F.collect_list("_s").alias("_l"))
    )
    grid = (
        devices.select("id", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_b"))
        .join(listed, "_b")
        .select("id", F.explode("_l").alias("_s"))
        .select("id", *[F.col(f"_s.{k}").alias(k) for k in keys])
    )
    known = grid.join(states, ["id", *keys], "left")
    filled = [
        F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else F.col(c)
        for c in states.columns
        if c not in {"id", *keys}
    ]
    return known.select("id", *keys, *filled)


def state_at(events: DataFrame, time: float, columns: Sequence[str]) -> DataFrame:
    """Latest values of each device at or before one time."""
    order = F.struct("time", "seq")
    return (
        events.filter(F.col("time") <= time)
        .groupBy("dev")
        .agg(*[F.max_by(c, order).alias(c) for c in columns])
    )


def state_as_of(
    events: DataFrame,
    probes: DataFrame,
    columns: Sequence[str],
    rows_per_run: int = ROWS_PER_RUN,
) -> DataFrame:
    """For every probe (dev, time): values of the device's latest event at or before that time."""
    packed = F.struct(*columns)
    # The event that wins among equal times is chosen before ordering, which merges copies.
    facts = (
        events.groupBy("dev", "time")
        .agg(F.max_by(packed, "seq").alias("_state"))
        .select("dev", "time", "_state", F.lit(0).alias("_probe"))
    )
    asked = probes.groupBy("dev", "time").agg(F.count(F.lit(1)).alias("_copies"))
    asked = asked.select("dev", "time", F.lit(1).alias("_probe"), "_copies")
    both = facts.unionByName(asked, allowMissingColumns=True)
    counted = events.select("dev", "time").unionByName(probes.select("dev", "time"))
    known = last_known(
        both, ["dev"], "time", ["_probe"], F.col("_state"), "_latest", rows_per_run, counted
    ).filter(F.col("_probe") == 1)
    answers = known.select("dev", "time", *[F.col(f"_latest.{c}").alias(c) for c in columns])
    return probes.join(answers, ["dev", "time"], "left")


# -- ordered selections -----------------------------------------------------------------------------


def sends_in_order(events: DataFrame) -> DataFrame:
    return events.filter(F.col("type") == "send").orderBy("time", "id")


def device_events(events: DataFrame, device: str) -> DataFrame:
    """Events of one device in the numeric order of their ids."""
    return events.filter(F.col("dev") == device).orderBy(
        F.expr("try_cast(id as bigint)"), "id"
    )


def first_events(events: DataFrame, n: int) -> DataFrame:
    """The first ``n`` events in time order."""
    return events.orderBy("time", "id").limit(n)


def first_by_id(events: DataFrame) -> DataFrame:
    """One row per event id: the earliest by time, then seq. Copies merge before the shuffle."""
    rest = [c for c in events.columns if c not in {"id", "time", "seq"}]
    rank = [c for c in ("time", "seq") if c in events.columns]
    first = F.min(F.struct(*rank, *rest)).alias("_first")
    return (
        events.groupBy("id")
        .agg(first)
        .select(*[F.col("id") if c == "id" else F.col(f"_first.{c}").alias(c) for c in events.columns])
    )


def interior_and_border(interior: DataFrame, border: DataFrame) -> DataFrame:
    """Interior rows followed by border rows, missing columns as NULL, duplicates kept."""
    return interior.unionByName(border, allowMissingColumns=True)


def compatible_ports(ports: DataFrame) -> DataFrame:
    """Output and input ports that carry the same message type."""
    outs = ports.filter(F.col("direction") == "output").select(
        F.col("device_type").alias("source_type"), F.col("name").alias("source_port"), "message_type"
    )
    ins = ports.filter(F.col("direction") == "input").select(
        F.col("device_type").alias("target_type"), F.col("name").alias("target_port"), "message_type"
    )
    return outs.join(ins, "message_type")


