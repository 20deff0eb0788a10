"""Graph files: type catalogue, graph instances, devices and edges from XML."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portmesh.functions.scalars import edge_id, split_path, valid_path
from portmesh.session import checkpoint
from portmesh.sources.xml_scan import parsed, scan_elements
from portmesh.tables import TYPE_FIELDS

TEXT = T.StringType()


def _struct(**members: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in members.items()])


def _members(depth: int) -> dict[str, T.DataType]:
    scalar = _struct(_name=TEXT, _type=TEXT, _default=TEXT, _value=TEXT)
    array = _struct(_name=TEXT, _type=TEXT, _length=TEXT)
    union = _struct(_name=TEXT)
    out = {
        "Scalar": T.ArrayType(scalar),
        "Array": T.ArrayType(array),
        "Union": T.ArrayType(union),
    }
    if depth:
        out["Tuple"] = T.ArrayType(_struct(_name=TEXT, **_members(depth - 1)))
    return out


def graph_type_schema(depth: int) -> T.StructType:
    """A graph type whose tuples are nested ``depth`` deep at most."""
    section = _struct(**_members(depth))
    port = _struct(
        _name=TEXT, _messageTypeId=TEXT, _edgeTypeId=TEXT, Properties=section, State=section,
        MetaData=TEXT,
    )
    message = _struct(_id=TEXT, Message=section, State=section, Properties=section, MetaData=TEXT)
    device = _struct(
        _id=TEXT, Properties=section, State=section, MetaData=TEXT, SharedCode=T.ArrayType(TEXT),
        InputPort=T.ArrayType(port), OutputPort=T.ArrayType(port),
    )
    return _struct(
        _id=TEXT, Properties=section, MetaData=TEXT, SharedCode=T.ArrayType(TEXT),
        MessageTypes=_struct(MessageType=T.ArrayType(message)),
        EdgeTypes=_struct(EdgeType=T.ArrayType(message)),
        DeviceTypes=_struct(DeviceType=T.ArrayType(device)),
    )


def read_rows(spark: SparkSession, path: str, tag: str, schema: T.StructType) -> DataFrame:
    """One row per ``tag`` element, from splits of any file; only the members named in ``schema`` are kept."""
    return parsed(scan_elements(spark, path, tag), tag, schema).drop("tag", "around")


@dataclass(frozen=True)
class Catalogue:
    graph_types: DataFrame
    message_types: DataFrame
    device_types: DataFrame
    ports: DataFrame
    type_fields: DataFrame


def _field(name: Column, path: Column, kind: str, type_: Column, length: Column, default: Column):
    return F.struct(
        name.alias("name"),
        path.alias("path"),
        F.lit(kind).alias("kind"),
        type_.alias("type"),
        length.cast("int").alias("length"),
        default.alias("default"),
    )


def _flatten(section: Column, prefix: Column, depth: int) -> Column:
    """All members of a section, nested ones with a dotted path, as an array of field structs."""
    none = F.lit(None).cast("string")

    def path(x: Column) -> Column:
        return F.concat(prefix, x["_name"])

    groups = [
        F.transform(
            section["Scalar"],
            lambda x: _field(
                x["_name"], path(x), "scalar", x["_type"], none,
                F.coalesce(x["_default"], x["_value"]),
            ),
        ),
        F.transform(
            section["Array"],
            lambda x: _field(x["_name"], path(x), "array", x["_type"], x["_length"], none),
        ),
        F.transform(
            section["Union"], lambda x: _field(x["_name"], path(x), "union", none, none, none)
        ),
    ]
    if depth:
        groups.append(
            F.transform(
                section["Tuple"],
                lambda x: _field(x["_name"], path(x), "tuple", none, none, none),
            )
        )
        inner = F.transform(
            section["Tuple"],
            lambda x: _flatten(x, F.concat(prefix, x["_name"], F.lit(".")), depth - 1),
        )
        groups.append(F.flatten(inner))
    empty = F.array().cast(
        "array<struct<name:string,path:string,kind:string,type:string,length:int,default:string>>"
    )
    return F.concat(*[F.coalesce(g, empty) for g in groups])


def _sections(
    rows: DataFrame, section: str, name: str, kind: str, owner: Column, port: Column
) -> DataFrame:
    return rows.filter(F.col(section).isNotNull()).select(
        "graph_type",
        F.lit(kind).alias("owner_kind"),
        owner.alias("owner"),
        port.alias("port"),
        F.lit(name).alias("section"),
        F.col(section).alias("_members"),
    )


def _tuple_depth(types: DataFrame) -> int:
    """How deep tuples are nested in the text of graph types."""
    tags = F.regexp_extract_all("text", F.lit(r"(</?Tuple\b[^>]*>)"), F.lit(1))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state: Column, tag: Column) -> Column:
        now = state["now"] + F.when(tag.startswith("</"), -1).when(tag.endswith("/>"), 0).otherwise(1)
        return F.struct(now.alias("now"), F.greatest(state["most"], state["now"] + 1, now).alias("most"))

    return types.agg(F.max(F.aggregate(tags, zero, step, lambda x: x["most"]))).first()[0] or 0


def read_graph_types(spark: SparkSession, path: str) -> Catalogue:
    """Type catalogue of all graph types in the files, with tuples of any depth: how deep they go is looked up
    first. Also accepts the older edge-type spelling."""
    # a few declarations, used many times
    found = checkpoint(scan_elements(spark, path, "GraphType"))
    depth = _tuple_depth(found.select(F.explode("texts").alias("text")))
    schema = graph_type_schema(depth)
    message_types = schema["MessageTypes"].dataType["MessageType"].dataType
    types = checkpoint(parsed(found, "GraphType", schema).drop("tag", "around").withColumnRenamed("_id", "graph_type"))
    no_port = F.lit(None).cast("string")
    messages = types.select(
        "graph_type",
        F.explode(
            F.concat(
                F.coalesce(F.col("MessageTypes.MessageType"), F.array().cast(message_types)),
                F.coalesce(F.col("EdgeTypes.EdgeType"), F.array().cast(message_types)),
            )
        ).alias("m"),
    ).select("graph_type", "m.*")
    devices = types.select("graph_type", F.explode("DeviceTypes.DeviceType").alias("d")).select(
        "graph_type", "d.*"
    )

    def ports_of(column: str, direction: str) -> DataFrame:
        return (
            devices.select("graph_type", F.col("_id").alias("device_type"),
                           F.posexplode(column).alias("idx", "p"))
            .select("graph_type", "device_type", "idx", "p.*")
            .withColumn("direction", F.lit(direction))
        )

    all_ports = ports_of("InputPort", "input").unionByName(ports_of("OutputPort", "output"))
    inputs = all_ports.filter(F.col("direction") == "input")
    owner = F.col("_id")
    sections = [
        _sections(types, "Properties", "properties", "graph", F.col("graph_type"), no_port),
        _sections(messages, "Message", "message", "message", owner, no_port),
        _sections(devices, "Properties", "properties", "device", owner, no_port),
        _sections(devices, "State", "state", "device", owner, no_port),
        _sections(inputs, "Properties", "properties", "port", F.col("device_type"), F.col("_name")),
        _sections(inputs, "State", "state", "port", F.col("device_type"), F.col("_name")),
    ]
    type_fields = (
        reduce(DataFrame.unionByName, sections)
        .withColumn("_f", _flatten(F.col("_members"), F.lit(""), depth))
        .select(
            "graph_type", "owner_kind", "owner", "port", "section",
            F.posexplode("_f").alias("idx", "f"),
        )
        .select("graph_type", "owner_kind", "owner", "port", "section", "idx", "f.*")
        .select(*[f.name for f in TYPE_FIELDS])
    )
    return Catalogue(
        graph_types=types.select(
            F.col("graph_type").alias("id"), metadata(F.col("MetaData")).alias("metadata")
        ),
        message_types=messages.select(
            "graph_type", F.col("_id").alias("id"), metadata(F.col("MetaData")).alias("metadata")
        ),
        device_types=devices.select(
            "graph_type", F.col("_id").alias("id"), metadata(F.col("MetaData")).alias("metadata")
        ),
        ports=all_ports.select(
            "graph_type",
            "device_type",
            F.col("_name").alias("name"),
            "direction",
            "idx",
            F.coalesce("_messageTypeId", "_edgeTypeId").alias("message_type"),
        ),
        type_fields=type_fields,
    )


def metadata(text: Column) -> Column:
    """Free metadata text as a VARIANT."""
    return F.try_parse_json(F.concat(F.lit("{"), text, F.lit("}")))


def read_graphs(spark: SparkSession, path: str, properties: bool = True) -> DataFrame:
    """Graph instances: id, type, property text and metadata text, from the head of each ``GraphInstance``,
    which ends where its devices or edges begin. ``properties=False`` leaves the texts out."""
    schema = _struct(_id=TEXT, _graphTypeId=TEXT, Properties=TEXT, MetaData=TEXT)
    heads = parsed(scan_elements(spark, path, "GraphInstance"), "GraphInstance", schema, "GraphInstance")
    columns = {"id": "_id", "graph_type": "_graphTypeId"}
    if properties:
        columns |= {"props": "Properties", "metadata": "MetaData"}
    return heads.select(*[F.col(old).alias(new) for new, old in columns.items()])


def _members_of(
    spark: SparkSession, path: str, tag: str, schema: T.StructType, graph_id: bool
) -> DataFrame:
    """Elements of graph instances, with the ``graph_id`` of the instance around them if asked for."""
    if not graph_id:
        return read_rows(spark, path, tag, schema)
    rows = parsed(scan_elements(spark, path, tag, "GraphInstance", "id"), tag, schema)
    return rows.withColumn("graph_id", F.get("around", F.lit(0)))


def read_devices(spark: SparkSession, path: str, graph_id: bool = False) -> DataFrame:
    """Devices: id, type, property text and metadata text; ``graph_id=True`` adds the id of the graph
    instance around each."""
    schema = _struct(_id=TEXT, _type=TEXT, P=TEXT, Properties=TEXT, M=TEXT)
    return _members_of(spark, path, "DevI", schema, graph_id).select(
        F.col("_id").alias("id"),
        F.col("_type").alias("type"),
        F.coalesce("P", "Properties").alias("props"),
        F.col("M").alias("metadata"),
        *(["graph_id"] if graph_id else []),
    )


def read_edges(spark: SparkSession, path: str, graph_id: bool = False) -> DataFrame:
    """Edges from either form: a ``path`` attribute or four end-point attributes."""
    schema = _struct(
        _path=TEXT, _dstDeviceId=TEXT, _dstPortName=TEXT, _srcDeviceId=TEXT, _srcPortName=TEXT,
        P=TEXT, M=TEXT,
    )
    raw = _members_of(spark, path, "EdgeI", schema, graph_id).withColumn("_ends", split_path("_path"))
    ends = {
        "target": "_dstDeviceId",
        "target_port": "_dstPortName",
        "source": "_srcDeviceId",
        "source_port": "_srcPortName",
    }
    rows = raw.select(
        *[
            F.when(F.col("_path").isNotNull(), F.col(f"_ends.{name}"))
            .otherwise(F.col(attribute))
            .alias(name)
            for name, attribute in ends.items()
        ],
        F.col("_path").alias("path"),
        F.col("P").alias("props"),
        F.col("M").alias("metadata"),
        *(["graph_id"] if graph_id else []),
    )
    return rows.withColumn("id", F.coalesce(edge_id(), F.col("path"))).select(
        "id", "source", "target", "source_port", "target_port", "path", "props", "metadata",
        *(["graph_id"] if graph_id else []),
    )


def malformed_edges(edges: DataFrame) -> DataFrame:
    """Edges whose path does not hold exactly two end points of two parts."""
    return edges.filter(F.col("path").isNotNull() & ~valid_path("path"))


def read_type_references(spark: SparkSession, path: str) -> DataFrame:
    """References to graph types kept in other files: id and source file."""
    return read_rows(spark, path, "GraphTypeReference", _struct(_id=TEXT, _src=TEXT)).select(
        F.col("_id").alias("id"), F.col("_src").alias("src")
    )


def resolve_type_refs(refs: DataFrame, types: DataFrame) -> DataFrame:
    """References with ``found``: whether the type they name is among ``types``.

    A reference without a source file stands for itself and is never missing.
    """
    known = types.select("id").distinct().withColumn("_known", F.lit(True))
    return refs.join(known, "id", "left").select(
        "id", "src", (F.col("src").isNull() | F.coalesce("_known", F.lit(False))).alias("found")
    )
