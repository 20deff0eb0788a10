"""XML writers for graphs, logs and snapshots; what they write, the readers read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portmesh.functions.scalars import edge_id, to_hex
from portmesh.sources.xml_graph import Catalogue, graph_type_schema
from portmesh.sources.xml_log import event_tag


# Events in a compressed file, which one task reads.
EVENTS_PER_FILE = 500_000


def _write(
    df: DataFrame, path: str, row: str, root: str, namespace: str | None, mode: str, **options: str
) -> None:
    opening = f'{root} xmlns="{namespace}"' if namespace else root
    (
        df.write.format("xml")
        .mode(mode)
        .option("rowTag", row)
        .option("rootTag", opening)
        .option("valueTag", "_text")
        .option("declaration", 'version="1.0" encoding="UTF-8"')
        .options(**options)
        .save(path)
    )


def _blank_to_null(name: str, df: DataFrame) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("string")
    return F.when(F.col(name) != "", F.col(name))


def _section(fields: list, prefix: str = "") -> dict | None:
    """The declarations directly under ``prefix`` as Scalar, Array, Union and Tuple elements."""
    out: dict[str, list] = {}
    for f in fields:
        inside = f["path"][len(prefix) :] if f["path"].startswith(prefix) else ""
        if not inside or "." in inside:
            continue
        element = {"_name": f["name"]}
        if f["kind"] == "scalar":
            element |= {"_type": f["type"], "_default": f["default"]}
        elif f["kind"] == "array":
            element |= {"_type": f["type"], "_length": str(f["length"])}
        elif f["kind"] == "tuple":
            element |= _section(fields, f["path"] + ".") or {}
        out.setdefault(f["kind"].capitalize(), []).append(element)
    return out or None


def write_graph_types_xml(
    catalogue: Catalogue, path: str, namespace: str | None = None, mode: str = "errorifexists"
) -> None:
    """Type declarations. The catalogue is as small as the declarations and passes the driver."""
    fields = catalogue.type_fields.orderBy("owner", "port", "section", "idx").collect()
    messages, devices = catalogue.message_types.collect(), catalogue.device_types.collect()
    ports = catalogue.ports.orderBy("device_type", "direction", "idx", "name").collect()

    def section(graph: str, kind: str, owner: str, name: str, port: str | None = None):
        return _section(
            [
                f for f in by_owner.get((graph, kind, owner), [])
                if f["section"] == name and f["port"] == port
            ]
        )

    by_owner: dict[tuple, list] = {}
    for f in fields:
        by_owner.setdefault((f["graph_type"], f["owner_kind"], f["owner"]), []).append(f)
    by_device: dict[tuple, list] = {}
    for p in ports:
        by_device.setdefault((p["graph_type"], p["device_type"], p["direction"]), []).append(p)

    def port_row(g: str, d: str, p) -> dict:
        return {
            "_name": p["name"],
            "_messageTypeId": p["message_type"],
            "Properties": section(g, "port", d, "properties", p["name"]),
            "State": section(g, "port", d, "state", p["name"]),
        }

    rows = []
    for g in [r["id"] for r in catalogue.graph_types.select("id").collect()]:
        own_messages = [
            {"_id": m["id"], "Message": section(g, "message", m["id"], "message")}
            for m in messages if m["graph_type"] == g
        ]
        own_devices = [
            {
                "_id": d["id"],
                "Properties": section(g, "device", d["id"], "properties"),
                "State": section(g, "device", d["id"], "state"),
                "InputPort": [port_row(g, d["id"], p) for p in by_device.get((g, d["id"], "input"), [])],
                "OutputPort": [port_row(g, d["id"], p) for p in by_device.get((g, d["id"], "output"), [])],
            }
            for d in devices if d["graph_type"] == g
        ]
        rows.append(
            {
                "_id": g,
                "Properties": section(g, "graph", g, "properties"),
                "MessageTypes": {"MessageType": own_messages},
                "DeviceTypes": {"DeviceType": own_devices},
            }
        )
    spark = catalogue.graph_types.sparkSession
    # a dot in a path for each tuple around a member, and a tuple may be empty
    depth = max((f["path"].count(".") + (f["kind"] == "tuple") for f in fields), default=0)
    typed = spark.createDataFrame(rows, graph_type_schema(depth))
    _write(typed, path, "GraphType", "Graphs", namespace, mode)


def write_graphs_xml(
    graphs: DataFrame, path: str, namespace: str | None = None, mode: str = "errorifexists"
) -> None:
    rows = graphs.select(
        F.col("id").alias("_id"),
        F.col("graph_type").alias("_graphTypeId"),
        _blank_to_null("props", graphs).alias("Properties"),
        _blank_to_null("metadata", graphs).alias("MetaData"),
    )
    _write(rows, path, "GraphInstance", "Graphs", namespace, mode)


def write_devices_xml(
    devices: DataFrame, path: str, namespace: str | None = None, mode: str = "errorifexists"
) -> None:
    """Devices with brace-less property and metadata text; empty ones are left out."""
    rows = devices.select(
        F.col("id").alias("_id"),
        F.col("type").alias("_type"),
        _blank_to_null("props", devices).alias("P"),
        _blank_to_null("metadata", devices).alias("M"),
    )
    _write(rows, path, "DevI", "DeviceInstances", namespace, mode)


def write_edges_xml(
    edges: DataFrame, path: str, namespace: str | None = None, mode: str = "errorifexists"
) -> None:
    rows = edges.select(
        edge_id().alias("_path"),
        _blank_to_null("props", edges).alias("P"),
        _blank_to_null("metadata", edges).alias("M"),
    )
    _write(rows, path, "EdgeI", "EdgeInstances", namespace, mode)


def write_events_xml(
    events: DataFrame,
    path: str,
    namespace: str | None = None,
    mode: str = "errorifexists",
    compressed: bool = False,
    per_file: int = EVENTS_PER_FILE,
) -> None:
    """Events, one folder per kind under ``path``.

    ``compressed`` files (gzip) can't be read in splits, so each holds at most ``per_file`` events.
    """
    options = {}
    if compressed:
        # the text repeats so much that the fastest level takes most of it
        options = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": str(per_file)}
    flag = F.when(F.col("cancel"), "1").otherwise("0")
    common = {
        "_eventId": F.col("id"),
        "_time": F.col("time"),
        "_elapsed": F.col("elapsed"),
        "_dev": F.col("dev"),
        "_rts": F.concat(F.lit("0x"), to_hex(F.coalesce("rts", F.lit(0)))),
        "_seq": F.col("seq"),
    }
    own = {
        "init": {},
        "send": {"_port": F.col("port"), "_cancel": flag, "_fanout": F.col("fanout")},
        "recv": {"_port": F.col("port"), "_sendEventId": F.col("send_id")},
    }
    for kind, extra in own.items():
        columns = {**common, **extra, "L": F.col("l"), "S": F.col("s")}
        if kind == "send":
            columns["M"] = F.col("m")
        rows = events.filter(F.col("type") == kind).select(
            *[value.alias(name) for name, value in columns.items()]
        )
        _write(rows, f"{path}/{kind}", event_tag(kind), "GraphLog", namespace, mode, **options)


def snapshot_rows(
    device_states: DataFrame,
    edge_states: DataFrame | None = None,
    graph_id: str = "graph",
    graph_type: str = "graph",
    block: int = 10_000,
) -> DataFrame:
    """Snapshot elements holding at most about ``block`` devices or edges each.

    A snapshot larger than that continues in further elements with the same sequence number, which
    the readers put together again. Devices with mask 0 and no state, and idle edges, are left out.
    """
    header = ["epoch", "sequence"]
    devices = device_states.filter((F.col("rts") != 0) | (F.coalesce("state", F.lit("")) != ""))
    element = F.struct(
        F.col("id").alias("_id"),
        F.when(F.col("rts") != 0, to_hex("rts")).alias("_rts"),
        F.col("state").alias("S"),
    )
    packed = _in_blocks(devices, header, element, "DevS", block)
    if edge_states is not None:
        busy = (
            (F.coalesce("state", F.lit("")) != "") | (F.col("firings") != 0) | (F.size("messages") > 0)
        )
        element = F.struct(
            F.col("id").alias("_id"),
            F.when(F.col("firings") != 0, to_hex("firings")).alias("_firings"),
            F.col("state").alias("S"),
            F.when(F.size("messages") > 0, F.struct(F.col("messages").alias("M"))).alias("Q"),
        )
        edges = _in_blocks(edge_states.filter(busy), header, element, "EdgeS", block)
        packed = packed.unionByName(edges, allowMissingColumns=True)
    return packed.select(
        F.lit(graph_id).alias("_graphInstId"),
        F.lit(graph_type).alias("_graphTypeId"),
        F.col("sequence").alias("_sequenceNumber"),
        F.col("epoch").alias("_orchestratorTime"),
        *[c for c in ("DevS", "EdgeS") if c in packed.columns],
    )


def _in_blocks(
    rows: DataFrame, header: list[str], element: Column, name: str, block: int
) -> DataFrame:
    sizes = rows.groupBy(*header).agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    # One row per snapshot on the right.
    numbered = rows.join(sizes, header).withColumn(
        "_block", F.pmod(F.xxhash64("id"), F.col("_blocks"))
    )
    return numbered.groupBy(*header, "_block").agg(
        F.array_sort(F.collect_list(element)).alias(name)
    )


def write_snapshots_xml(
    device_states: DataFrame,
    path: str,
    edge_states: DataFrame | None = None,
    graph_id: str = "graph",
    graph_type: str = "graph",
    block: int = 10_000,
    namespace: str | None = None,
    mode: str = "errorifexists",
) -> None:
    rows = snapshot_rows(device_states, edge_states, graph_id, graph_type, block)
    _write(rows, path, "GraphSnapshot", "Graph", namespace, mode)
