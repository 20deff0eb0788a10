"""METIS and DOT text. Long documents are sorted rows, never one collected string."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portmesh.functions.style import COLOURS, SHAPES, TOO_MANY_COLOUR, show_labels, style_by_type
from portmesh.operators.skew import number_within
from portmesh.operators.timelines import state_diff, timeline
from portmesh.session import checkpoint

# -- METIS ------------------------------------------------------------------------------------------


def number_nodes(nodes: DataFrame) -> DataFrame:
    """``nodes(parent, id)`` with ``node``: 1..n inside each parent in id order."""
    return number_within(nodes.select("parent", "id"), ["parent"], ["id"], "node")


def metis_pieces(numbered: DataFrame, weights: DataFrame) -> DataFrame:
    """Pieces of the METIS text as (parent, node, piece, value).

    Piece order inside a node is (neighbour); a node's line is its pieces joined by spaces and an
    end-of-line piece. Node 0 is the header. No line is ever built in memory.
    """
    named = numbered.select(F.col("parent"), F.col("id"), F.col("node"))
    inside = (
        weights.join(named.toDF("parent", "a", "na"), "a")
        .join(named.toDF("parent", "b", "nb"), ["parent", "b"])
        .select("parent", "na", "nb", "weight")
    )
    halves = inside.select(
        "parent",
        F.explode(
            F.array(
                F.struct(F.col("na").alias("node"), F.col("nb").alias("piece"), "weight"),
                F.struct(F.col("nb").alias("node"), F.col("na").alias("piece"), "weight"),
            )
        ).alias("h"),
    ).select(
        "parent",
        "h.node",
        "h.piece",
        F.concat_ws(" ", "h.piece", "h.weight").alias("value"),
    )
    ends = named.select("parent", "node", F.lit(2**62).alias("piece"), F.lit("\n").alias("value"))
    edge_totals = inside.groupBy("parent").agg(F.count(F.lit(1)).alias("_e"))
    header = (
        named.groupBy("parent")
        .agg(F.count(F.lit(1)).alias("_v"))
        .join(edge_totals, "parent", "left")
        .select(
            "parent",
            F.lit(0).cast("bigint").alias("node"),
            F.lit(0).cast("bigint").alias("piece"),
            F.concat(
                F.concat_ws(" ", "_v", F.coalesce("_e", F.lit(0)), F.lit("001")), F.lit("\n")
            ).alias("value"),
        )
    )
    return reduce(DataFrame.unionByName, [header, halves, ends])


def write_metis(
    nodes: DataFrame,
    weights: DataFrame,
    path: str,
    mode: str = "errorifexists",
    whole_lines: bool = False,
) -> DataFrame:
    """Write ``V E 001`` and one adjacency line per node, one folder per parent partition.

    ``nodes(parent, id)``, ``weights(a, b, weight)`` of unordered pairs; edges between different
    parents are left out. The part files of a folder, in name order, are one METIS file. The line of
    a hub may cross part files unless ``whole_lines``. Returns the node numbers, which are needed to
    read the partitioner's answer.
    """
    numbered = checkpoint(number_nodes(nodes))
    pieces = metis_pieces(numbered, weights)
    cut = ["parent", "node"] if whole_lines else ["parent", "node", "piece"]
    (
        pieces.repartitionByRange(*cut)
        .sortWithinPartitions("parent", "node", "piece")
        .select("parent", "value")
        .write.mode(mode)
        .option("lineSep", " ")
        .partitionBy("parent")
        .text(path)
    )
    return numbered


# -- DOT ----------------------------------------------------------------------------------------------


def quoted(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.concat(F.lit('"'), value, F.lit('"'))


def _attributes(pairs: dict[str, Column], quote: bool) -> Column:
    shown = [
        F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), quoted(v) if quote else v))
        for k, v in pairs.items()
    ]
    return F.concat_ws(",", *shown)


def dot_statements(
    devices: DataFrame,
    edges: DataFrame,
    graph_id: str = "graph",
    device_attributes: tuple[str, ...] = (),
    edge_attributes: tuple[str, ...] = (),
) -> DataFrame:
    """DOT text as (seq, part, key, statement), to be ordered by the first three columns.

    ``devices(id, type, …)`` and ``edges(id, source, target, source_port, target_port,
    message_type, …)`` may carry a ``seq`` column (one graph per snapshot) and columns made by
    ``bind``, which are drawn when named in the attribute lists.
    """
    has_seq = "seq" in devices.columns
    seq = F.col("seq") if has_seq else F.lit(0)
    shapes = style_by_type(devices, "type", SHAPES).withColumnRenamed("style", "_shape")
    colours = style_by_type(edges, "message_type", COLOURS, TOO_MANY_COLOUR).withColumnRenamed(
        "style", "_colour"
    )
    bound = {a: F.col(a).cast("string") for a in device_attributes}
    filled = F.lit("filled") if device_attributes else F.lit(None).cast("string")
    has_value = (
        reduce(lambda x, y: x | y, [F.col(a).isNotNull() for a in device_attributes])
        if device_attributes
        else F.lit(False)
    )
    # Types are few, devices and edges many.
    nodes = devices.join(F.broadcast(shapes), "type").select(
        seq.cast("int").alias("seq"),
        F.lit(1).alias("part"),
        F.col("id").alias("key"),
        F.concat(
            F.lit("  "), quoted("id"), F.lit(" ["),
            F.concat_ws(
                ",",
                F.concat(F.lit("shape="), "_shape"),
                F.when(
                    F.lit(bool(bound)), _attributes({**bound, "style": F.when(has_value, filled)}, True)
                ),
            ),
            F.lit("];"),
        ).alias("statement"),
    )
    one_graph = edges.filter(F.col("seq") == edges.agg(F.min("seq")).scalar()) if has_seq else edges
    labelled = show_labels(one_graph)
    attributes = {
        "color": F.col("_colour"),
        "headlabel": F.when(labelled, F.col("target_port")),
        "taillabel": F.when(labelled, F.col("source_port")),
        "label": F.when(labelled, F.col("message_type")),
        **{a: F.col(a).cast("string") for a in edge_attributes},
    }
    arcs = edges.join(F.broadcast(colours), "message_type").select(
        seq.cast("int").alias("seq"),
        F.lit(2).alias("part"),
        F.col("id").alias("key"),
        F.concat(
            F.lit("  "), quoted("source"), F.lit(" -> "), quoted("target"), F.lit(" ["),
            _attributes(attributes, True), F.lit("];"),
        ).alias("statement"),
    )
    shots = devices.select(seq.cast("int").alias("seq")).distinct()
    opening = [f'digraph "{graph_id}"{{', '  sep="+10,10";', "  overlap=false;", "  spline=true;"]
    frame = shots.select(
        "seq",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(0).alias("part"), F.lit(str(i)).alias("key"), F.lit(t).alias("s"))
                    for i, t in enumerate(opening)
                ],
                F.struct(F.lit(3).alias("part"), F.lit("").alias("key"), F.lit("}").alias("s")),
            )
        ).alias("f"),
    ).select("seq", "f.part", "f.key", F.col("f.s").alias("statement"))
    return reduce(DataFrame.unionByName, [frame, nodes, arcs])


def _write_ordered(statements: DataFrame, path: str, order: list[str], mode: str, by: str | None):
    lines = statements.repartitionByRange(*order).sortWithinPartitions(*order)
    if by:
        lines.select(by, "statement").write.mode(mode).partitionBy(by).text(path)
    else:
        lines.select("statement").write.mode(mode).text(path)


def write_dot(
    devices: DataFrame, edges: DataFrame, path: str, mode: str = "errorifexists", **options
) -> None:
    """One DOT document per snapshot under ``path/seq=…``; part files in name order."""
    _write_ordered(
        dot_statements(devices, edges, **options), path, ["seq", "part", "key"], mode, "seq"
    )


def _table_row(*cells: Column) -> Column:
    return F.concat(F.lit("<TR>"), *[F.concat(F.lit("<TD>"), c, F.lit("</TD>")) for c in cells],
                    F.lit("</TR>"))


def event_dot_statements(events: DataFrame) -> DataFrame:
    """The causal graph of a log as DOT statements (part, dev, rank, seq, key, statement).

    Messages are plain edges; each device is a cluster with its events in order, their state with
    changed values in red, the message of a send, and dotted edges along the sequence. The state
    and message tables of one event are bounded by the declared fields.
    """
    empty = F.lit("").alias("dev")
    zero = F.lit(0).cast("bigint")

    def line(df: DataFrame, part: int, dev, rank: int, seq, key, statement) -> DataFrame:
        return df.select(
            F.lit(part).alias("part"), dev.alias("dev"), F.lit(rank).alias("rank"),
            seq.alias("seq"), key.alias("key"), statement.alias("statement"),
        )

    recvs = events.filter(F.col("type") == "recv")
    arrow = F.concat(F.lit("  "), quoted("send_id"), F.lit(" -> "), quoted("id"), F.lit(";"))
    messages = line(recvs, 1, empty, 0, zero, F.col("id"), arrow)

    braces = lambda c: F.concat(F.lit("{"), F.coalesce(F.col(c), F.lit("")), F.lit("}"))
    typed = events.withColumns({"_s": braces("s"), "_m": braces("m")})
    # At most one entry per declared state field and event.
    changed = state_diff(typed, "_s").groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_changed")
    )
    red = F.coalesce("_changed", F.create_map().cast("map<string,string>"))
    shown = F.map_concat(
        F.map_filter(F.from_json("_s", "map<string,string>"),
                     lambda k, v: ~F.map_contains_key(red, k)),
        red,
    )
    rows = F.transform(
        F.array_sort(F.map_entries(shown)),
        lambda e: F.concat(
            F.lit("<TR><TD>"), e["key"], F.lit("</TD><TD "),
            F.when(F.map_contains_key(red, e["key"]), 'color="red"').otherwise(""),
            F.lit(">"), F.coalesce(e["value"], F.lit("null")), F.lit("</TD></TR>"),
        ),
    )
    body = F.transform(
        F.array_sort(F.map_entries(F.from_json("_m", "map<string,string>"))),
        lambda e: _table_row(e["key"], F.coalesce(e["value"], F.lit("null"))),
    )
    wide = lambda c: F.concat(F.lit('<TR><TD colspan="2">'), c, F.lit("</TD></TR>"))
    title = (
        F.when(F.col("type") == "init", F.lit("__init__"))
        .when(F.col("type") == "send", F.concat(F.lit("Send : "), "port"))
        .otherwise(F.concat(F.lit("Recv : "), "port"))
    )
    label = F.concat(
        quoted("id"), F.lit(" [ shape=none, margin=0, label=< <TABLE>"), wide(title),
        F.array_join(rows, ""),
        F.when(F.col("type") == "send", F.concat(wide(F.lit("Message")), F.array_join(body, "")))
        .otherwise(""),
        F.lit("</TABLE> > ];"),
    )
    nodes = line(
        typed.join(changed, "id", "left"), 2, F.col("dev"), 1, F.col("seq"), F.col("id"), label
    )
    dotted = F.concat(
        F.lit("    "), quoted("previous_id"), F.lit(" -> "), quoted("id"),
        F.lit(' [ style="dotted" ] ;'),
    )
    order = timeline(events.select("id", "dev", "seq")).filter(F.col("previous_id").isNotNull())
    sequence = line(order, 2, F.col("dev"), 2, F.col("seq"), F.col("id"), dotted)
    devs = events.select("dev").distinct()
    start = F.concat(F.lit("  subgraph cluster_"), "dev", F.lit(" {"))
    opens = line(devs, 2, F.col("dev"), 0, zero, F.lit(""), start)
    closes = line(devs, 2, F.col("dev"), 3, zero, F.lit(""), F.lit("  }"))
    one = events.sparkSession.range(1)
    frame = [
        line(one, 0, empty, i, zero, F.lit(""), F.lit(t))
        for i, t in enumerate(['digraph "graph"{', "  overlap=false;", "  newrank=true;"])
    ]
    frame.append(line(one, 3, empty, 0, zero, F.lit(""), F.lit("}")))
    return reduce(DataFrame.unionByName, [*frame, messages, opens, nodes, sequence, closes])


def write_event_dot(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    order = ["part", "dev", "rank", "seq", "key"]
    _write_ordered(event_dot_statements(events), path, order, mode, None)
