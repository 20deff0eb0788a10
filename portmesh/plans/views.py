"""The read views on a built model. All return lazy DataFrames; filters reach the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portmesh.functions.typed import field_lists
from portmesh.operators import relations as rel
from portmesh.operators import rollups as roll
from portmesh.sinks.clustered import inside
from portmesh.tables import Model, partition_columns


def _level(part_id: str) -> int:
    return len(part_id.split("_")) - 1


def _depth(model: Model) -> int:
    return len(partition_columns(model.device_partitions))


def _children(df: DataFrame, part_id: str) -> DataFrame:
    """Rows of the level of ``part_id`` below it: the level is a storage folder, the parent the sort
    key of its files."""
    return df.filter((F.col("level") == _level(part_id)) & (F.col("parent") == part_id))


def _of_devices(model: Model, table: str, part_id: str, device: str = "id") -> DataFrame:
    """Rows of the devices of a partition; of a clustered model only their cells are read."""
    df, column = getattr(model, table), f"partition_{_level(part_id) - 1}"
    if model.cells is not None:
        return inside(df, model.cells, part_id, column)
    members = model.device_partitions.filter(F.col(column) == part_id).select(F.col("id").alias(device))
    return df.join(members, device, "left_semi")


def drill_down(
    model: Model, part_id: str, init: int = 1, epoch: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges below a partition at one epoch.

    Interior nodes are the child partitions with their averages, or the devices themselves when the
    partition is a leaf; border nodes are the foreign partitions they are connected to.
    """
    level = _level(part_id)
    now = (F.col("init") == init) & (F.col("epoch") == epoch)
    if level < _depth(model):
        states = _children(model.state_rollup, part_id).filter(now)
        properties = _children(model.property_rollup, part_id)
        repeated = [c for c in properties.columns if c in states.columns and c != "partition_id"]
        interior = (
            states.join(properties.drop(*repeated), "partition_id")
            .drop("level")
            .withColumnRenamed("partition_id", "id")
        )
    else:
        states = _of_devices(model, "device_states", part_id).filter(now)
        properties = model.device_properties
        if model.cells is not None:
            properties = _of_devices(model, "device_properties", part_id)
        repeated = [c for c in properties.columns if c in states.columns and c != "id"]
        interior = states.join(properties.drop(*repeated), "id").withColumn("parent", F.lit(part_id))
    interior = interior.withColumn("kind", F.lit("interior"))
    edges = (
        _children(model.partition_edges, part_id)
        .filter(F.col("source") != F.col("target"))
        .select("source", "target", "count")
    )
    if level == 0:
        return interior, edges
    crossing = _children(model.border_edges, part_id)
    border = crossing.select(F.col("lower").alias("id"), F.lit("border").alias("kind")).distinct()
    outside = crossing.select(
        F.col("higher").alias("source"), F.col("lower").alias("target"), "count"
    )
    return rel.interior_and_border(interior, border), rel.interior_and_border(edges, outside)


def rollup_history(model: Model, part_id: str, start: int, end: int) -> DataFrame:
    """Averages of the child partitions from one epoch before ``start`` to one after ``end``."""
    return _children(model.state_rollup, part_id).filter(
        F.col("epoch").between(start - 1, end + 1)
    )


def event_window(
    model: Model, part_id: str, start: float, end: float, last_recv_only: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Sends in time order and receives of a partition's devices, one time unit beyond each end.

    ``last_recv_only`` keeps the last receive of each send instead of all.
    """
    found = _of_devices(model, "events", part_id, "dev").filter(F.col("time").between(start - 1, end + 1))
    recvs = found.filter(F.col("type") == "recv")
    if last_recv_only:
        rest = [c for c in recvs.columns if c != "send_id"]
        last = F.max_by(F.struct(*rest), F.struct("time", "id")).alias("_last")
        recvs = recvs.groupBy("send_id").agg(last).select("send_id", "_last.*")
    return rel.sends_in_order(found), recvs


def stepper(model: Model, part_id: str) -> DataFrame:
    """All epochs of a partition's children, or of its devices when it is a leaf."""
    level = _level(part_id)
    if level < _depth(model):
        return _children(model.state_rollup, part_id).withColumnRenamed("partition_id", "id")
    return _of_devices(model, "device_states", part_id)


def catalogue(model: Model) -> dict[str, DataFrame]:
    """What a reader needs before the first view: levels, last time, ranges, fields and names."""
    return {
        "meta": model.meta,
        "value_ranges": model.value_ranges,
        "field_lists": field_lists(model.type_fields),
        "ports": roll.distinct_ports(model.ports),
        "message_types": roll.distinct_message_types(model.ports),
    }


def border_partitions(model: Model, part_id: str) -> DataFrame:
    """Foreign partitions next to a partition: the ones to load or cache next."""
    crossing = _children(model.border_edges, part_id)
    return crossing.select(F.col("lower").alias("partition_id")).distinct()
