"""Aggregations over the partition hierarchy, the log and the structure."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portmesh.functions.scalars import edge_id, parent_id
from portmesh.operators.relations import edges_with_partitions, message_pairs
from portmesh.operators.skew import find_large
from portmesh.tables import partition_columns


def _count() -> Column:
    return F.count(F.lit(1))


def _ancestors(leaf: Column, depth: int) -> Column:
    """Array of (level, partition_id) from level 0 down to the leaf partition itself."""
    parts = F.split(leaf, "_")
    return F.transform(
        F.sequence(F.lit(0), F.lit(depth - 1)),
        lambda i: F.struct(
            i.alias("level"), F.array_join(F.slice(parts, 1, i + 2), "_").alias("partition_id")
        ),
    )


# -- structure ------------------------------------------------------------------------------------


def partition_edges(
    edges: DataFrame, parts: DataFrame, level: int, placed: DataFrame | None = None
) -> DataFrame:
    """Edges between the partitions of one level, with counts, under a common parent.

    At the leaf level (one below the last partition column) the rows are device pairs inside one
    partition: parallel edges stay separate rows and ``count`` is NULL. ``placed`` are the edges with
    the leaf partitions of both ends, where they are at hand.
    """
    names = partition_columns(parts)
    if level == len(names):
        inner = names[-1]
        placed = edges_with_partitions(edges, parts, [inner]) if placed is None else placed
        return placed.filter(
            (F.col("source") != F.col("target"))
            & (F.col(f"source_{inner}") == F.col(f"target_{inner}"))
        ).select(
            F.lit(level).alias("level"),
            F.col(f"source_{inner}").alias("parent"),
            "source",
            "target",
            F.lit(None).cast("bigint").alias("count"),
        )
    part = names[level]
    placed = edges_with_partitions(edges, parts, [part])
    a, b = F.col(f"source_{part}"), F.col(f"target_{part}")
    return (
        placed.filter((F.col("source") != F.col("target")) & (parent_id(a) == parent_id(b)))
        .groupBy(a.alias("source"), b.alias("target"))
        .agg(_count().alias("count"))
        .select(
            F.lit(level).alias("level"),
            parent_id("source").alias("parent"),
            "source",
            "target",
            "count",
        )
    )


def border_edges(
    edges: DataFrame,
    parts: DataFrame,
    level: int,
    combine: str = "union",
    placed: DataFrame | None = None,
) -> DataFrame:
    """Edges between a child (``higher``) and a foreign partition one level up (``lower``).

    ``combine="union"`` keeps out- and in-edge rows as a distinct union, so equal counts merge into
    one row and unequal counts stay two rows; ``combine="sum"`` adds them up.
    """
    names = partition_columns(parts)
    outer = names[level - 1]
    leaf = level == len(names)
    needed = [outer] if leaf else [outer, names[level]]
    if placed is None or not leaf:
        placed = edges_with_partitions(edges, parts, needed)
    placed = placed.filter(
        F.col(f"source_{outer}") != F.col(f"target_{outer}")
    )

    def side(near: str, far: str) -> Column:
        higher = F.col(near) if leaf else F.col(f"{near}_{names[level]}")
        return F.struct(
            F.col(f"{near}_{outer}").alias("parent"),
            higher.alias("higher"),
            F.col(f"{far}_{outer}").alias("lower"),
            F.lit(near).alias("direction"),
        )

    # One pass over the placed edges gives both directions.
    both = placed.select(
        F.explode(F.array(side("source", "target"), side("target", "source"))).alias("e")
    ).select("e.*")
    keys = ["parent", "higher", "lower"]
    if combine == "sum":
        counted = both.groupBy(*keys).agg(_count().alias("count"))
    else:
        counted = (
            both.groupBy(*keys, "direction").agg(_count().alias("count")).drop("direction")
        ).distinct()
    return counted.select(F.lit(level).alias("level"), *keys, "count")


def leaf_pairs(edges: DataFrame, parts: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """(source_leaf, target_leaf, count): edges between different devices per pair of leaf
    partitions, the common input of all inner levels."""
    leaf = partition_columns(parts)[-1]
    if placed is None:
        placed = edges_with_partitions(edges.select("source", "target"), parts, [leaf])
    return (
        placed.filter(F.col("source") != F.col("target"))
        .groupBy(
            F.col(f"source_{leaf}").alias("source_leaf"),
            F.col(f"target_{leaf}").alias("target_leaf"),
        )
        .agg(_count().alias("count"))
    )


def _prefix(leaf: str, parts: Column) -> Column:
    return F.array_join(F.slice(F.split(leaf, "_"), 1, parts), "_")


def inner_partition_edges(pairs: DataFrame, depth: int) -> DataFrame:
    """``partition_edges`` of all levels above the leaf from ``leaf_pairs``; ``depth`` is the number
    of partition columns. Each level is a branch of its own, so a reader of one leaves out the others."""

    def at(level: int) -> DataFrame:
        above = F.lit(level + 1)
        return (
            pairs.filter(_prefix("source_leaf", above) == _prefix("target_leaf", above))
            .groupBy(
                _prefix("source_leaf", above).alias("parent"),
                _prefix("source_leaf", above + 1).alias("source"),
                _prefix("target_leaf", above + 1).alias("target"),
            )
            .agg(F.sum("count").alias("count"))
            .select(F.lit(level).alias("level"), "parent", "source", "target", "count")
        )

    return reduce(DataFrame.unionByName, map(at, range(depth)))


def inner_border_edges(pairs: DataFrame, depth: int, combine: str = "union") -> DataFrame:
    """``border_edges`` of all levels above the leaf from ``leaf_pairs``."""
    if depth < 2:
        return _no_border(pairs)
    both = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("source_leaf").alias("near"), F.col("target_leaf").alias("far"),
                         F.lit("out").alias("direction")),
                F.struct(F.col("target_leaf").alias("near"), F.col("source_leaf").alias("far"),
                         F.lit("in").alias("direction")),
            )
        ).alias("e"),
        "count",
    ).select("e.*", "count")

    def at(level: int) -> DataFrame:
        above = F.lit(level + 1)
        keys = ["parent", "higher", "lower"]
        named = both.select(
            _prefix("near", above).alias("parent"),
            _prefix("near", above + 1).alias("higher"),
            _prefix("far", above).alias("lower"),
            "direction",
            "count",
        ).filter(F.col("parent") != F.col("lower"))
        if combine == "sum":
            counted = named.groupBy(*keys).agg(F.sum("count").alias("count"))
        else:
            counted = named.groupBy(*keys, "direction").agg(F.sum("count").alias("count"))
            counted = counted.select(*keys, "count").distinct()
        return counted.select(F.lit(level).alias("level"), *keys, "count")

    return reduce(DataFrame.unionByName, map(at, range(1, depth)))


def _no_border(pairs: DataFrame) -> DataFrame:
    empty = pairs.limit(0)
    return empty.select(
        F.lit(0).alias("level"),
        F.col("source_leaf").alias("parent"),
        F.col("source_leaf").alias("higher"),
        F.col("target_leaf").alias("lower"),
        "count",
    )


def partition_sizes(parts: DataFrame, column: str) -> DataFrame:
    return parts.groupBy(F.col(column).alias("partition_id")).agg(_count().alias("devices"))


def graph_summary(
    message_types: DataFrame, device_types: DataFrame, devices: DataFrame, edges: DataFrame
) -> DataFrame:
    tables = {
        "message_types": message_types,
        "device_types": device_types,
        "devices": devices,
        "edges": edges,
    }
    out = None
    for name, df in tables.items():
        row = df.agg(_count().alias("n")).select(F.lit(name).alias("item"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def undirected_weights(edges: DataFrame) -> DataFrame:
    """One row per unordered device pair, weighted by its number of edges."""
    return edges.groupBy(
        F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")
    ).agg(_count().alias("weight"))


def degrees(edges: DataFrame, devices: DataFrame, ports: DataFrame) -> DataFrame:
    """Edges at every port of every device, zero where a port is unconnected."""
    at_source = edges.groupBy(
        F.col("source").alias("id"), F.col("source_port").alias("port")
    ).agg(_count().alias("n"))
    at_target = edges.groupBy(
        F.col("target").alias("id"), F.col("target_port").alias("port")
    ).agg(_count().alias("n"))
    used = at_source.withColumn("direction", F.lit("output")).unionByName(
        at_target.withColumn("direction", F.lit("input"))
    )
    all_ports = devices.select("id", F.col("type").alias("device_type")).join(
        ports.select("device_type", F.col("name").alias("port"), "direction"), "device_type"
    )
    return all_ports.join(used, ["id", "port", "direction"], "left").select(
        "id", "port", "direction", F.coalesce("n", F.lit(0)).cast("bigint").alias("degree")
    )


def adjacency(edges: DataFrame, block: int = 10_000) -> DataFrame:
    """Targets per device and output port as sorted arrays of (target, target_port, edges).

    A list longer than about ``block`` continues in further rows, so a hub never becomes one array.
    Parallel edges are counted first, which also keeps copies of one edge out of the split.
    """
    keys = ["source", "source_port"]
    distinct = edges.groupBy(*keys, "target", "target_port").agg(_count().alias("edges"))
    long_lists = (
        distinct.groupBy(*keys)
        .agg(_count().alias("_n"))
        .filter(F.col("_n") > block)
        .select(*keys, F.ceil(F.col("_n") / block).alias("_blocks"))
    )
    number = F.pmod(F.xxhash64("target", "target_port"), F.col("_blocks"))
    return (
        distinct.join(long_lists, keys, "left")
        .withColumn("block", F.coalesce(number, F.lit(0)).cast("bigint"))
        .groupBy(*keys, "block")
        .agg(F.array_sort(F.collect_list(F.struct("target", "target_port", "edges"))).alias("targets"))
    )


# -- states and properties --------------------------------------------------------------------------


def numeric_columns(df: DataFrame, skip: Sequence[str]) -> list[str]:
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [name for name, kind in df.dtypes if kind in numeric and name not in skip]


def _roll_up(
    rows: DataFrame,
    parts: DataFrame,
    keys: Sequence[str],
    averaged: Sequence[str],
    summed: Sequence[str] = (),
) -> DataFrame:
    """Average or sum columns at every partition level from a single pass over the devices.

    Devices are reduced to (sum, count) per leaf partition first; only those partial rows are
    stacked by level, so an average stays an average over devices and the wide input is shuffled
    once.
    """
    names = partition_columns(parts)
    depth = len(names)
    placed = rows.join(parts.select("id", F.col(names[-1]).alias("_leaf")), "id")
    partial = placed.groupBy("_leaf", *keys).agg(
        *[F.sum(F.col(c).cast("double")).alias(f"_s_{c}") for c in averaged],
        *[F.count(c).alias(f"_n_{c}") for c in averaged],
        *[F.sum(c).alias(f"_t_{c}") for c in summed],
    )
    stacked = partial.withColumn("_up", F.explode(_ancestors(F.col("_leaf"), depth)))
    return (
        stacked.groupBy("_up.level", "_up.partition_id", *keys)
        .agg(
            *[F.try_divide(F.sum(f"_s_{c}"), F.sum(f"_n_{c}")).alias(c) for c in averaged],
            *[F.sum(f"_t_{c}").alias(c) for c in summed],
        )
        .select(
            "level",
            parent_id("partition_id").alias("parent"),
            "partition_id",
            *keys,
            *averaged,
            *summed,
        )
    )


def state_rollup(
    states: DataFrame, parts: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """Average of every numeric state column per partition, epoch and init flag, at all levels."""
    keys = ["epoch", "init"]
    columns = columns or numeric_columns(states, ["id", "type", "rts", *keys])
    return _roll_up(states.select("id", *keys, *columns), parts, keys, columns)


def property_rollup(
    properties: DataFrame,
    parts: DataFrame,
    counts: DataFrame | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Average of every numeric property per partition; message counts are summed."""
    columns = columns or numeric_columns(properties, ["id", "type"])
    rows, summed = properties.select("id", *columns), []
    if counts is not None:
        summed = ["messages_sent", "messages_received"]
        per_device = counts.select(F.col("dev").alias("id"), *summed)
        rows = rows.join(per_device, "id", "left").fillna(0, summed)
    return _roll_up(rows, parts, [], columns, summed)


# -- log ----------------------------------------------------------------------------------------------


def value_ranges(events: DataFrame, fields: Sequence[str] | None = None, state: str = "s") -> DataFrame:
    """Smallest and largest value of each numeric state field over all events.

    ``fields`` limits the result to declared numeric fields; values that are not numbers are skipped.
    """
    pairs = events.select(F.explode(F.from_json(state, "map<string,string>")).alias("state", "v"))
    if fields is not None:
        pairs = pairs.filter(F.col("state").isin(list(fields)))
    number = pairs.select("state", F.col("v").try_cast("double").alias("v"))
    return (
        number.filter(F.col("v").isNotNull())
        .groupBy("state")
        .agg(F.min("v").alias("min"), F.max("v").alias("max"))
    )


def message_counts(events: DataFrame) -> DataFrame:
    """Messages sent and received per device."""
    return (
        events.filter(F.col("type").isin("send", "recv"))
        .groupBy("dev")
        .agg(
            F.count_if(F.col("type") == "send").alias("messages_sent"),
            F.count_if(F.col("type") == "recv").alias("messages_received"),
        )
    )


def message_count_ranges(events: DataFrame) -> DataFrame:
    """Ranges of the message counts: from 0 to the busiest device."""
    names = ["messages_sent", "messages_received"]
    top = message_counts(events).agg(*[F.max(c).cast("double").alias(c) for c in names])
    return top.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("state"), F.lit(0.0).alias("min"), F.col(c).alias("max")
                    )
                    for c in names
                ]
            )
        ).alias("r")
    ).select("r.*")


def all_ranges(events: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    return value_ranges(events, fields).unionByName(message_count_ranges(events))


def meta(events: DataFrame, levels: int, limit: float = 100.0) -> DataFrame:
    """Number of levels, and the last time shown: ceil(min(limit, largest event time))."""
    last = F.ceil(F.least(F.lit(float(limit)), F.max("time"))).cast("bigint")
    return events.agg(last.alias("t")).select(
        F.explode(
            F.array(
                F.struct(F.lit("level").alias("name"), F.lit(levels).cast("bigint").alias("max")),
                F.struct(F.lit("time").alias("name"), F.col("t").alias("max")),
            )
        ).alias("m")
    ).select("m.*")


def distinct_ports(ports: DataFrame) -> DataFrame:
    return ports.select("name").distinct()


def distinct_message_types(ports: DataFrame) -> DataFrame:
    return ports.select("message_type").distinct()


def send_rate(events: DataFrame, devices: DataFrame) -> DataFrame:
    """Sends per epoch, and that number divided by the number of devices."""
    sends = (
        events.filter(F.col("type") == "send")
        .groupBy(F.floor("time").cast("bigint").alias("epoch"))
        .agg(_count().alias("sends"))
    )
    total = devices.agg(_count()).scalar()
    return sends.select("epoch", "sends", (F.col("sends") / total).alias("sends_per_device"))


def edge_firings(events: DataFrame, interval: float) -> DataFrame:
    """Deliveries per edge in each snapshot interval."""
    return (
        message_pairs(events)
        .groupBy(
            edge_id("target", "target_port", "source", "source_port").alias("edge"),
            F.floor(F.col("recv_time") / interval).cast("bigint").alias("interval"),
        )
        .agg(_count().alias("firings"))
    )


def touched(
    events: DataFrame, edges: DataFrame, rows: int | None = None, rows_per_task: int = 500_000
) -> DataFrame:
    """Devices and edges touched by a set of events, as (kind, id).

    Init and send touch their device, a send also its port's out-edges and their targets, a receive
    the edge it came over and both ends.

    A task holds its different edges, so the tasks are as many as the edges need; ``rows`` is about
    their number, if it is known, else they are counted first.
    """
    ends = ["source", "source_port", "target", "target_port"]
    edges = edges.select(*ends)
    tasks = max(1, math.ceil((edges.count() if rows is None else rows) / rows_per_task))
    own = events.filter(F.col("type").isin("init", "send")).select(F.col("dev").alias("id"))
    senders = (
        events.filter(F.col("type") == "send")
        .select(F.col("dev").alias("source"), F.col("port").alias("source_port"))
        .distinct()
    )
    # hashing the senders spares the edges a sort
    fired = edges.join(senders.hint("shuffle_hash"), ["source", "source_port"], "left_semi")
    delivered = message_pairs(events).select(*ends)
    arcs = fired.select(*ends).unionByName(delivered).repartition(tasks, *ends).distinct()
    # the source of an arc sent, and so is among its own devices
    devices = own.unionByName(arcs.select(F.col("target").alias("id")))
    return (
        devices.distinct()
        .select(F.lit("device").alias("kind"), "id")
        .unionByName(arcs.select(F.lit("edge").alias("kind"), edge_id().alias("id")))
    )


def event_rollup(
    events: DataFrame,
    parts: DataFrame,
    steps: Sequence[int] = (10, 100, 1000),
    span: tuple[float, float] | None = None,
) -> DataFrame:
    """Events per leaf partition in 10, 100 and 1000 equal time steps, for drilling down in time.

    Steps must divide the finest one. Events are counted per device and finest step before they
    meet the partitions; the coarser steps add up those counts.
    """
    finest = max(steps)
    if any(finest % s for s in steps):
        raise ValueError("every number of steps must divide the finest")
    if span is None:
        lo, hi = events.agg(F.min("time"), F.max("time")).first()
    else:
        lo, hi = span
    width = (hi - lo) or 1.0
    raw = F.floor((F.col("time") - F.lit(lo)) * F.lit(float(finest)) / F.lit(width))
    bucket = F.least(raw, F.lit(finest - 1)).cast("bigint")
    leaf = partition_columns(parts)[-1]
    counted = events.groupBy(F.col("dev").alias("id"), bucket.alias("_b")).agg(
        _count().alias("_n"), F.count_if(F.col("type") == "send").alias("_sends")
    )
    placed = counted.join(parts.select("id", F.col(leaf).alias("partition_id")), "id")
    fine = placed.groupBy("partition_id", "_b").agg(
        F.sum("_n").alias("_n"), F.sum("_sends").alias("_sends")
    )
    levels = F.array(*[F.lit(s) for s in sorted(steps)])
    stacked = fine.withColumn("steps", F.explode(levels)).withColumn(
        "bucket", F.floor(F.col("_b") / (F.lit(finest) / F.col("steps"))).cast("bigint")
    )
    return stacked.groupBy("partition_id", F.col("steps").cast("bigint").alias("steps"), "bucket").agg(
        F.sum("_n").alias("events"), F.sum("_sends").alias("sends")
    )


def delayed_input(sends: DataFrame, edges: DataFrame) -> DataFrame:
    """Weighted input per target and time when a send arrives after its edge's delay.

    ``sends(source, time)`` and ``edges(source, target, delay, weight)`` are reduced before they
    meet, so repeated sends and parallel edges do not multiply. An edge takes the times of its source to
    its target as lists, which are opened there; only the targets of very many edges get single rows.
    """
    n = sends.groupBy("source", "time").agg(_count().alias("_n"))
    w = edges.groupBy("source", "target", "delay").agg(F.sum("weight").alias("_w"))
    large = find_large(edges, ["target"], "delay")
    if large is None:
        return _input_by_target(n, w)
    hubs = large.select("target")
    single = n.join(w.join(hubs, "target", "left_semi"), "source")
    return _input(single).unionByName(_input_by_target(n, w.join(hubs, "target", "left_anti")))


def _input(arriving: DataFrame) -> DataFrame:
    return arriving.groupBy("target", (F.col("time") + F.col("delay")).alias("time")).agg(
        F.sum(F.col("_n") * F.col("_w")).alias("input")
    )


def _input_by_target(n: DataFrame, w: DataFrame, block: int = 1000) -> DataFrame:
    blocks = n.groupBy("source").agg(F.ceil(_count() / block).alias("_blocks"))
    lists = (
        n.join(blocks, "source")
        .groupBy("source", F.pmod(F.xxhash64("time"), F.col("_blocks")).alias("_block"))
        .agg(F.collect_list(F.struct("time", "_n")).alias("_sent"))
        .drop("_block")
    )
    placed = w.join(lists, "source").repartition("target")
    return _input(placed.select("target", "delay", "_w", F.inline("_sent")))


def bounding_box(positions: DataFrame) -> DataFrame:
    """Smallest and largest position and the raster size that covers them."""
    return positions.agg(
        F.min("x").alias("min_x"),
        F.max("x").alias("max_x"),
        F.min("y").alias("min_y"),
        F.max("y").alias("max_y"),
    ).select(
        "*",
        (F.col("max_x") - F.col("min_x") + 1).cast("bigint").alias("width"),
        (F.col("max_y") - F.col("min_y") + 1).cast("bigint").alias("height"),
    )
