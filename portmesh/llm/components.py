"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two joins on the vertices, until the links are stars around the least
vertices. Nothing but that verdict reaches the driver. The neighbours of a vertex are combined before
they are shuffled for the aggregations; in the joins, its links (two numbers each) meet in one task, sorted
and streamed, never held together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portmesh.llm.common import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (hi, lo) of each vertex's neighbours to the least vertex around it: of the larger neighbours
    (large star) or of the smaller ones and itself (small star)."""
    if large:
        around = links.select(F.col("hi").alias("v"), F.col("lo").alias("w")).unionAll(
            links.select(F.col("lo").alias("v"), F.col("hi").alias("w"))
        )
        least = around.groupBy("v").agg(F.least("v", F.min("w")).alias("m"))
        out = links.select(F.col("lo").alias("v"), F.col("hi").alias("w")).join(least, "v")
    else:
        least = links.groupBy(F.col("hi").alias("v")).agg(F.min("lo").alias("m"))
        both = links.select(F.col("hi").alias("v"), F.col("lo").alias("w")).join(least, "v")
        return (
            both.select(F.col("w").alias("hi"), F.col("m").alias("lo"))
            .unionAll(least.select(F.col("v").alias("hi"), F.col("m").alias("lo")))
            .where("hi <> lo")
            .distinct()
        )
    return out.select(F.col("w").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every vertex has one link to a smaller one at most, and none from a larger one then: the
    links are stars around the least vertices."""
    ends = links.select(F.col("hi").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        links.select(F.col("lo").alias("v"), F.lit(0), F.lit(1))
    )
    around = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return around.where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))).isEmpty()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (the least node of its component) for every node that has a link.

    ``links`` has columns ``a`` and ``b`` (long); order, direction, repeats and self-links do not matter.
    Nulls are left out. Nodes without a link are not returned.
    """
    links = stored(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct(),
        "links",
    )
    for _ in range(most_rounds):
        if _settled(links):
            break
        links = stored(_star(_star(links, True), False), "links")
    else:
        raise RuntimeError(f"the components were not settled after {most_rounds} rounds")
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(
        links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )
