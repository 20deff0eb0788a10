"""From the tables of a run to the whole model: partitions, roll-ups, ranges and meta data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portmesh.functions.scalars import sampled, within_limit
from portmesh.functions.typed import merged_spec, specs_of, widen
from portmesh.operators import rollups as roll
from portmesh.operators.partitioning import partition_hierarchy
from portmesh.operators.relations import edges_with_partitions
from portmesh.session import checkpoint
from portmesh.sinks.clustered import load_clustered, save_clustered
from portmesh.sinks.tables import load_model, save_model
from portmesh.sources.xml_graph import read_devices, read_edges, read_graph_types, read_graphs
from portmesh.sources.xml_log import read_events
from portmesh.sources.xml_snapshots import read_device_states, read_edge_states
from portmesh.tables import TYPE_FIELDS, Model, partition_columns, storage_class


def build_model(
    model: Model,
    nodes_per_part: int = 50,
    max_epoch: float = 100.0,
    granularity: int = 0,
    rounds: int = 4,
    range_fields: list[str] | None = None,
) -> Model:
    """Add every derived table to a model that has devices and edges, and optionally device
    properties, states, events and given partitions."""
    devices, edges = model.devices, model.edges
    parts = model.device_partitions
    if parts is None:
        parts = checkpoint(partition_hierarchy(edges, devices, nodes_per_part, rounds))
    depth = len(partition_columns(parts))
    tables: dict[str, DataFrame] = {"device_partitions": parts}
    if depth:
        # The edges meet the partitions of their ends once, for all levels.
        leaf = partition_columns(parts)[-1]
        placed = checkpoint(edges_with_partitions(edges.select("source", "target"), parts, [leaf]))
        # Small next to the edges: one row per pair of leaf partitions that touch.
        pairs = checkpoint(roll.leaf_pairs(edges, parts, placed))
        tables["partition_edges"] = roll.inner_partition_edges(pairs, depth).unionByName(
            roll.partition_edges(edges, parts, depth, placed)
        )
        tables["border_edges"] = roll.inner_border_edges(pairs, depth).unionByName(
            roll.border_edges(edges, parts, depth, placed=placed)
        )
    states = model.device_states
    if states is not None:
        states = states.filter(within_limit("epoch", max_epoch) & sampled("epoch", granularity))
        tables["device_states"] = states
        if depth:
            tables["state_rollup"] = roll.state_rollup(states, parts)
    counts = None
    if model.events is not None:
        events = model.events.filter(within_limit("time", max_epoch))
        tables["events"] = events
        counts = roll.message_counts(events)
        tables["meta"] = roll.meta(events, depth + 1, max_epoch)
        if "s" in events.columns:
            text = events.withColumn("s", F.concat(F.lit("{"), "s", F.lit("}")))
            tables["value_ranges"] = roll.all_ranges(text, range_fields)
    if model.device_properties is not None and depth:
        tables["property_rollup"] = roll.property_rollup(model.device_properties, parts, counts)
    return model.with_tables(**tables)


def read_model(
    spark: SparkSession,
    graph: str,
    log: str | None = None,
    snapshots: str | None = None,
    max_epoch: float = 100.0,
    granularity: int = 0,
) -> tuple[Model, list[str]]:
    """Read the XML files of a run; also returns the state fields that can be ranged over."""
    catalogue = read_graph_types(spark, graph)
    # The declarations are few; keep them at hand instead of parsing the file for every use.
    declared = spark.createDataFrame(catalogue.type_fields.collect(), TYPE_FIELDS)
    fields = declared.filter(F.col("owner_kind") == "device")
    properties = merged_spec(list(specs_of(fields, "properties").values()))
    state = merged_spec(list(specs_of(fields, "state").values()))
    devices, edges = read_devices(spark, graph), read_edges(spark, graph)
    tables = {
        "graphs": read_graphs(spark, graph),
        "message_types": catalogue.message_types,
        "device_types": catalogue.device_types,
        "ports": catalogue.ports,
        "type_fields": declared,
        "devices": devices,
        "device_properties": widen(devices.select("id", "type", "props"), properties),
        "edges": edges,
    }
    if log:
        tables["events"] = read_events(spark, log, max_epoch)
    if snapshots:
        raw = read_device_states(spark, snapshots, max_epoch, granularity)
        tables["device_states"] = widen(
            raw.select("id", "epoch", "init", "rts", "state"), state, "state"
        )
        tables["edge_states"] = read_edge_states(spark, snapshots, max_epoch, granularity)
    ranged = [f.name for f in state if f.kind == "scalar" and storage_class(f.type) in ("INTEGER", "REAL")]
    return Model(**tables), ranged


def build_from_xml(
    spark: SparkSession,
    graph: str,
    log: str,
    snapshots: str,
    out: str,
    nodes_per_part: int = 50,
    max_epoch: float = 100.0,
    granularity: int = 0,
    mode: str = "errorifexists",
    rounds: int = 4,
    clustered: bool = False,
) -> Model:
    """Files in, Parquet tables out: the whole initial build. ``clustered`` also stores the rows of
    devices by partition, for views that read only what they show."""
    given, ranged = read_model(spark, graph, log, snapshots, max_epoch, granularity)
    # Parse every file once; everything derived reads the stored columns.
    save_model(given, out, mode)
    stored = load_model(spark, out, list(given.tables()))
    built = build_model(stored, nodes_per_part, max_epoch, granularity, rounds, ranged)
    kept = set(given.tables())
    derived = {name: df for name, df in built.tables().items() if name not in kept}
    save_model(Model(**derived), out, mode)
    whole = load_model(spark, out, list(built.tables()))
    if clustered and partition_columns(whole.device_partitions):
        save_clustered(whole, f"{out}/clustered", mode=mode)
        whole = load_clustered(spark, f"{out}/clustered", whole)
    return whole
