"""Adjacency and partition files of graph partitioners in METIS text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from portmesh.sources.lines import read_numbered_lines


def _tokens(value: Column) -> Column:
    return F.filter(F.split(F.trim(value), r"\s+"), lambda t: t != "")


def _lines(spark: SparkSession, path: str, folders: bool) -> DataFrame:
    """Numbered lines per file, or per folder whose part files follow one another in name order.

    A part file ends with a separator after its last line break, which reads as one more line.
    """
    lines = read_numbered_lines(spark, path)
    if not folders:
        return lines
    sizes = lines.groupBy("file").agg(F.max("line").alias("_size"))
    folder = F.regexp_replace("file", "/[^/]*$", "")
    before = Window.partitionBy(folder).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "file", "_size", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off")
    )
    return (
        lines.join(offsets, "file")
        .filter(F.col("line") < F.col("_size"))
        .select(folder.alias("file"), (F.col("line") + F.col("_off")).alias("line"), "value")
    )


def read_metis_graph(
    spark: SparkSession, path: str, weighted: bool = True, folders: bool = False
) -> DataFrame:
    """(file, node, neighbour, weight): line *i* after the header lists the neighbours of node *i*.

    Every undirected edge appears from both of its ends, as in the file. ``folders=True`` reads what
    ``write_metis`` wrote with whole lines, one folder per graph.
    """
    rows = _lines(spark, path, folders).filter(F.col("line") > 0)
    tokens = _tokens(F.col("value"))
    step = 2 if weighted else 1
    n = F.floor(F.size(tokens) / step).cast("int")
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(
        index,
        lambda i: F.struct(
            F.get(F.col("_t"), i * step).cast("bigint").alias("neighbour"),
            (F.get(F.col("_t"), i * step + 1).cast("bigint") if weighted else F.lit(1)).alias(
                "weight"
            ),
        ),
    )
    return (
        rows.withColumn("_t", tokens)
        .select("file", F.col("line").alias("node"), F.explode(pairs).alias("_e"))
        .select("file", "node", "_e.neighbour", "_e.weight")
    )


def read_metis_header(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """(file, nodes, edges, format) from the first line of every file."""
    first = _lines(spark, path, folders).filter(F.col("line") == 0)
    t = _tokens(F.col("value"))
    return first.select(
        "file",
        F.get(t, 0).cast("bigint").alias("nodes"),
        F.get(t, 1).cast("bigint").alias("edges"),
        F.get(t, 2).alias("format"),
    )


def read_metis_parts(spark: SparkSession, path: str) -> DataFrame:
    """(file, parent, node, part): line *i* holds the part of node *i*.

    ``parent`` is the partition that was cut, taken from a file name ``…_<parent>.part.<k>``.
    """
    rows = read_numbered_lines(spark, path).filter(F.trim("value") != "")
    return rows.select(
        "file",
        F.regexp_extract("file", r"(base(?:_[0-9]+)*)\.part\.[0-9]+$", 1).alias("parent"),
        (F.col("line") + 1).alias("node"),
        F.trim("value").cast("int").alias("part"),
    )


def attach_parts(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """Partition ids of numbered nodes: ``nodes(parent, node, id)`` with the parts of a reader."""
    return nodes.join(parts.select("parent", "node", "part"), ["parent", "node"]).select(
        "id", F.concat_ws("_", "parent", "part").alias("partition_id")
    )
