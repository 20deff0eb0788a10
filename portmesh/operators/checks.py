"""Data-quality rules. Every rule returns its violations as (rule, key, detail)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portmesh.functions.scalars import EDGE_PATH, IDENTIFIER, edge_id
from portmesh.functions.typed import Field, is_refinement
from portmesh.operators.skew import ROWS_PER_RUN, previous_in_order


def _violation(df: DataFrame, rule: str, key: Column | str, detail: Column | str) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(
        F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.alias("detail")
    )


def _copies(df: DataFrame, rule: str, keys: Sequence[str], what: str) -> DataFrame:
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return _violation(
        counted,
        rule,
        F.concat_ws(".", *keys),
        F.concat(F.lit(f"{what} occurs "), F.col("_n"), F.lit(" times")),
    )


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def duplicate_ids(devices: DataFrame, edges: DataFrame) -> DataFrame:
    """V1: a device id or an edge id occurs more than once."""
    return _copies(devices, "V1", ["id"], "device id").unionByName(
        _copies(edges.select(edge_id().alias("id")), "V1", ["id"], "edge id")
    )


def duplicate_names(
    ports: DataFrame,
    message_types: DataFrame,
    device_types: DataFrame,
    type_fields: DataFrame | None = None,
) -> DataFrame:
    """V2: a port name twice in a device type, a type id twice, or a tuple element twice."""
    found = [
        _copies(ports, "V2", ["device_type", "name"], "port"),
        _copies(message_types, "V2", ["id"], "message type"),
        _copies(device_types, "V2", ["id"], "device type"),
    ]
    if type_fields is not None:
        keys = ["owner", "port", "section", "path"]
        found.append(_copies(type_fields.fillna("", keys), "V2", keys, "field"))
    return union_all(found)


def unknown_types(
    devices: DataFrame, device_types: DataFrame, ports: DataFrame, message_types: DataFrame
) -> DataFrame:
    """V3: a device of an unknown type, or a port with an unregistered message type."""
    lost = devices.join(device_types.select(F.col("id").alias("type")), "type", "left_anti")
    loose = ports.join(
        message_types.select(F.col("id").alias("message_type")), "message_type", "left_anti"
    )
    return _violation(
        lost, "V3", "id", F.concat(F.lit("unknown device type "), "type")
    ).unionByName(
        _violation(
            loose,
            "V3",
            F.concat_ws(".", "device_type", "name"),
            F.concat(F.lit("unknown message type "), "message_type"),
        )
    )


def dangling_edges(edges: DataFrame, devices: DataFrame) -> DataFrame:
    """V4: an edge ends at a device that does not exist."""
    ids = devices.select("id")
    found = []
    for end in ("source", "target"):
        lost = edges.join(ids.withColumnRenamed("id", end), end, "left_anti")
        found.append(
            _violation(lost, "V4", edge_id(), F.concat(F.lit(f"{end} does not exist: "), end))
        )
    return union_all(found)


def missing_ports(edges: DataFrame, devices: DataFrame, ports: DataFrame) -> DataFrame:
    """V5: an edge names a port that the type of its device lacks."""
    found = []
    for end, direction in (("source", "output"), ("target", "input")):
        kind = devices.select(F.col("id").alias(end), F.col("type").alias("_type"))
        known = ports.filter(F.col("direction") == direction).select(
            F.col("device_type").alias("_type"), F.col("name").alias(f"{end}_port")
        )
        lost = edges.join(kind, end).join(known, ["_type", f"{end}_port"], "left_anti")
        detail = F.concat(F.col("_type"), F.lit(f" has no {direction} port "), f"{end}_port")
        found.append(_violation(lost, "V5", edge_id(), detail))
    return union_all(found)


def mismatched_ports(resolved_edges: DataFrame) -> DataFrame:
    """V6: the message types of both ports of an edge differ (takes resolved edges)."""
    differ = resolved_edges.filter(F.col("message_type") != F.col("target_message_type"))
    detail = F.concat("message_type", F.lit(" sent to "), "target_message_type")
    return _violation(differ, "V6", edge_id(), detail)


def bad_properties(
    df: DataFrame,
    kind: str,
    key: Column | str,
    owner: Column | str,
    specs: Mapping[str, Sequence[Field]],
    text: str = "props",
) -> DataFrame:
    """V7: a value that does not refine the specification of its owner (type or port)."""
    owner = F.col(owner) if isinstance(owner, str) else owner
    good = F.lit(True)
    for name, spec in specs.items():
        good = F.when(owner == name, is_refinement(text, spec)).otherwise(good)
    return _violation(df.filter(~good), "V7", key, f"{kind} properties do not fit their type")


def bad_patterns(
    devices: DataFrame, edges: DataFrame | None = None, path: str = "path"
) -> DataFrame:
    """V8: an identifier or an edge path that does not match its pattern."""
    found = _violation(
        devices.filter(~F.col("id").rlike(IDENTIFIER)), "V8", "id", "malformed identifier"
    )
    if edges is None:
        return found
    return found.unionByName(
        _violation(edges.filter(~F.col(path).rlike(EDGE_PATH)), "V8", path, "malformed path")
    )


def log_order(events: DataFrame, rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """V9: per device, a seq that occurs twice, or time that goes back as seq rises.

    Rows are reduced to one per (device, seq) before they are put in order, so copies cost nothing.
    """
    steps = events.groupBy("dev", "seq").agg(
        F.count(F.lit(1)).alias("_n"), F.min("time").alias("_first"), F.max("time").alias("_last")
    )
    key = F.concat_ws(":", "dev", "seq")
    twice = _violation(
        steps.filter(F.col("_n") > 1),
        "V9",
        key,
        F.concat(F.lit("seq occurs "), F.col("_n"), F.lit(" times")),
    )
    ordered = previous_in_order(
        steps, ["dev"], "seq", [], ["_last"], "_prev", rows_per_run, counted=events
    )
    back = ordered.filter(F.col("_first") < F.col("_prev._last"))
    return twice.unionByName(_violation(back, "V9", key, "time goes back"))


def broken_messages(events: DataFrame) -> DataFrame:
    """V10: a receive without its send, an event id twice, or a cancelled send with fan-out."""
    sends = events.filter(F.col("type") == "send")
    recvs = events.filter(F.col("type") == "recv")
    lost = recvs.join(sends.select(F.col("id").alias("send_id")), "send_id", "left_anti")
    rowed = sends.filter(F.col("cancel") & (F.col("fanout") != 0))
    return union_all(
        [
            _violation(lost, "V10", "id", F.concat(F.lit("no send "), "send_id")),
            _copies(events, "V10", ["id"], "event id"),
            _violation(
                rowed,
                "V10",
                "id",
                F.concat(F.lit("cancelled with fan-out "), F.col("fanout").cast("string")),
            ),
        ]
    )


def stateless_firings(edge_states: DataFrame) -> DataFrame:
    """V11: a snapshot edge without state that has firings or a queue."""
    busy = (F.coalesce("firings", F.lit(0)) != 0) | (F.coalesce("queued", F.lit(0)) != 0)
    found = edge_states.filter(F.col("state").isNull() & busy)
    return _violation(
        found, "V11", F.concat_ws("@", "id", "epoch"), "firings or queue without state"
    )


def fanout_mismatch(events: DataFrame) -> DataFrame:
    """V12: the logged fan-out of a send differs from the number of receives that name it."""
    got = (
        events.filter(F.col("type") == "recv")
        .groupBy(F.col("send_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("_got"))
    )
    sends = events.filter(F.col("type") == "send").join(got, "id", "left")
    n = F.coalesce("_got", F.lit(0))
    detail = F.concat(F.lit("fan-out "), "fanout", F.lit(", receives "), n)
    return _violation(sends.filter(F.col("fanout") != n), "V12", "id", detail)


def validate(model, specs: Mapping[str, Sequence[Field]] | None = None) -> DataFrame:
    """All rules whose tables the model has, as one table of violations."""
    from portmesh.operators.relations import resolve_edges

    found = []
    m = model
    if m.devices is not None and m.edges is not None:
        found += [duplicate_ids(m.devices, m.edges), dangling_edges(m.edges, m.devices)]
    if m.ports is not None and m.message_types is not None and m.device_types is not None:
        found.append(duplicate_names(m.ports, m.message_types, m.device_types, m.type_fields))
        if m.devices is not None:
            found.append(unknown_types(m.devices, m.device_types, m.ports, m.message_types))
    if m.devices is not None and m.edges is not None and m.ports is not None:
        resolved = resolve_edges(m.edges.select("source", "target", "source_port", "target_port"),
                                 m.devices, m.ports)
        found += [missing_ports(m.edges, m.devices, m.ports), mismatched_ports(resolved)]
    if m.devices is not None:
        paths = m.edges if m.edges is not None and "path" in m.edges.columns else None
        found.append(bad_patterns(m.devices, paths))
        if specs and "props" in m.devices.columns:
            found.append(bad_properties(m.devices, "device", "id", "type", specs))
    if m.events is not None:
        found += [log_order(m.events), broken_messages(m.events), fanout_mismatch(m.events)]
    if m.edge_states is not None:
        found.append(stateless_firings(m.edge_states))
    return union_all(found)
