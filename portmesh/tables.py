"""Table schemas of the model and the mapping of declared field types."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The scalar types a graph may declare, with the Spark type that holds them and the
# smallest and largest value each accepts (NULL bounds: any value of the type).
SCALAR_TYPES = {
    "int8_t": (T.ByteType(), -(2**7), 2**7 - 1),
    "int16_t": (T.ShortType(), -(2**15), 2**15 - 1),
    "int32_t": (T.IntegerType(), -(2**31), 2**31 - 1),
    "uint8_t": (T.ShortType(), 0, 2**8 - 1),
    "uint16_t": (T.IntegerType(), 0, 2**16 - 1),
    "uint32_t": (T.LongType(), 0, 2**32 - 1),
    "char": (T.ByteType(), -(2**7), 2**7 - 1),
    "half": (T.FloatType(), None, None),
    "float": (T.FloatType(), None, None),
    "double": (T.DoubleType(), None, None),
    "int": (T.LongType(), None, None),
    "string": (T.StringType(), None, None),
}


def spark_type(name: str) -> T.DataType:
    """Spark type of a declared scalar type."""
    return SCALAR_TYPES[name][0]


def storage_class(name: str) -> str:
    """Storage class of a declared field: only INTEGER and REAL fields can be averaged."""
    if name == "float":
        return "REAL"
    if "int" in name:
        return "INTEGER"
    if name == "string":
        return "TEXT"
    return "BLOB"


TYPE_FIELDS = T.StructType(
    [
        T.StructField("graph_type", T.StringType()),
        T.StructField("owner_kind", T.StringType()),  # graph, message, device or port
        T.StructField("owner", T.StringType()),  # type id
        T.StructField("port", T.StringType()),  # input port for edge fields, else NULL
        T.StructField("section", T.StringType()),  # properties, state or message
        T.StructField("idx", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("path", T.StringType()),  # dotted name inside nested tuples
        T.StructField("kind", T.StringType()),  # scalar, array, tuple or union
        T.StructField("type", T.StringType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("default", T.StringType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("dev", T.StringType()),
        T.StructField("type", T.StringType()),  # init, send or recv
        T.StructField("time", T.DoubleType()),
        T.StructField("elapsed", T.DoubleType()),
        T.StructField("rts", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("port", T.StringType()),
        T.StructField("send_id", T.StringType()),
        T.StructField("cancel", T.BooleanType()),
        T.StructField("fanout", T.IntegerType()),
        T.StructField("m", T.StringType()),
        T.StructField("s", T.StringType()),
        T.StructField("l", T.ArrayType(T.StringType())),
    ]
)


@dataclass(frozen=True)
class Model:
    """The tables of one graph run. Every table is optional until an operator needs it."""

    graphs: DataFrame | None = None
    message_types: DataFrame | None = None
    device_types: DataFrame | None = None
    ports: DataFrame | None = None
    type_fields: DataFrame | None = None
    devices: DataFrame | None = None
    device_properties: DataFrame | None = None
    edges: DataFrame | None = None
    events: DataFrame | None = None
    device_states: DataFrame | None = None
    edge_states: DataFrame | None = None
    device_partitions: DataFrame | None = None
    partition_edges: DataFrame | None = None
    border_edges: DataFrame | None = None
    state_rollup: DataFrame | None = None
    property_rollup: DataFrame | None = None
    value_ranges: DataFrame | None = None
    meta: DataFrame | None = None
    cells: DataFrame | None = None  # of a clustered model

    def with_tables(self, **tables: DataFrame) -> Model:
        return replace(self, **tables)

    def tables(self) -> dict[str, DataFrame]:
        present = {f.name: getattr(self, f.name) for f in fields(self)}
        return {name: df for name, df in present.items() if df is not None}


def partition_columns(parts: DataFrame) -> list[str]:
    """``partition_0 … partition_{L-2}`` of a device_partitions table, outermost first."""
    names = [c for c in parts.columns if c.startswith("partition_")]
    return sorted(names, key=lambda c: int(c.rsplit("_", 1)[1]))


# Tables that carry a ``level`` column and are stored in one folder per level.
LEVELLED = {"partition_edges", "border_edges", "state_rollup", "property_rollup"}
