"""Event logs from XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portmesh.functions.scalars import cancelled, parse_int, within_limit
from portmesh.sources.xml_scan import parsed, scan_elements
from portmesh.tables import EVENTS

_COMMON = ["_eventId", "_time", "_elapsed", "_dev", "_rts", "_seq"]
_BY_KIND = {
    "init": ("InitEvent", []),
    "send": ("SendEvent", ["_port", "_cancel", "_fanout"]),
    "recv": ("RecvEvent", ["_port", "_sendEventId"]),
}


def event_schema(kind: str) -> T.StructType:
    text = [T.StructField(n, T.StringType()) for n in [*_COMMON, *_BY_KIND[kind][1], "S", "M"]]
    return T.StructType([*text, T.StructField("L", T.ArrayType(T.StringType()))])


def event_tag(kind: str) -> str:
    return _BY_KIND[kind][0]


def shape_events(raw: DataFrame, kind: str | Column) -> DataFrame:
    """Raw XML rows of one kind, or of the kind in a column, to the event columns."""
    has = set(raw.columns)
    kind = F.lit(kind) if isinstance(kind, str) else kind

    def attr(name: str) -> Column:
        return F.col(name) if name in has else F.lit(None).cast("string")

    values = {
        "id": attr("_eventId"),
        "dev": attr("_dev"),
        "type": kind,
        "time": attr("_time").cast("double"),
        "elapsed": attr("_elapsed").cast("double"),
        "rts": parse_int(attr("_rts")),
        "seq": attr("_seq").cast("bigint"),
        "port": attr("_port"),
        "send_id": attr("_sendEventId"),
        "cancel": cancelled(attr("_cancel")),
        "fanout": attr("_fanout").cast("int"),
        "m": attr("M"),
        "s": attr("S"),
        "l": attr("L"),
    }
    shaped = [values[f.name].cast(f.dataType).alias(f.name) for f in EVENTS]
    return raw.select(*shaped)


def read_events(spark: SparkSession, path: str, max_time: float | None = None) -> DataFrame:
    """All events of a log, state and message as brace-less JSON text.

    ``max_time`` drops later events; rows at the limit stay. All kinds are read in one scan.
    """
    kinds = {event_tag(kind): kind for kind in _BY_KIND}
    tags = " ".join(kinds)
    # every attribute of any kind; an event has those of its own
    schema = T.StructType(list({f.name: f for kind in _BY_KIND for f in event_schema(kind)}.values()))
    raw = parsed(scan_elements(spark, path, tags), tags, schema)
    kind = F.when(F.lit(False), "")
    for name, value in kinds.items():
        kind = kind.when(F.col("tag") == name, value)
    events = shape_events(raw, kind)
    return events if max_time is None else events.filter(within_limit("time", max_time))
