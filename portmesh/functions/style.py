"""Colours, bindings of values to drawing attributes, and styles by type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed lists of the drawing format: a shape per device type and a colour per message type.
SHAPES = ["oval", "box", "diamond", "pentagon", "hexagon", "septagon", "octagon"]
COLOURS = ["blue4", "red4", "green4"]
TOO_MANY_COLOUR = "black"
LABEL_LIMIT = 50

BLUE, WHITE, RED = (0, 0, 255), (255, 255, 255), (255, 0, 0)


def blend_channels(
    value: Column, start: Sequence[float], end: Sequence[float], low: Column, high: Column
) -> list[Column]:
    """Linear blend per channel, held at ``start`` below ``low`` and at ``end`` above ``high``."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(value - low, high - low)))
    return [
        F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.lit(float(a)) + share * (b - a)))).cast(
            "int"
        )
        for a, b in zip(start, end, strict=True)
    ]


def colour_text(channels: Sequence[Column]) -> Column:
    return F.format_string("#" + "%02x" * len(channels), *channels)


def _as_column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def blend_colour(value: Column, start, end, low, high) -> Column:
    """``#rrggbb`` (or four channels) between two colours."""
    return colour_text(blend_channels(value, start, end, _as_column(low), _as_column(high)))


def heat_channels(value: Column, low, high) -> list[Column]:
    """Blue to white to red around the middle of ``low`` and ``high``."""
    low, high = _as_column(low), _as_column(high)
    middle = (low + high) / 2
    cold = blend_channels(value, BLUE, WHITE, low, middle)
    hot = blend_channels(value, WHITE, RED, middle, high)
    return [F.when(value < middle, c).otherwise(h) for c, h in zip(cold, hot, strict=True)]


def heat_colour(value: Column, low, high) -> Column:
    return colour_text(heat_channels(value, low, high))


def bind(
    df: DataFrame,
    type_filter: str,
    source: str,
    name: str | None,
    attribute: str,
    expression: str,
) -> DataFrame:
    """Add ``attribute``: SQL ``expression`` of ``value`` for rows of one type (``*`` for all).

    ``source`` is ``property``, ``state``, ``rts`` or ``firings``; the first two read the column
    ``property_<name>`` or ``state_<name>``. Firings are read as the normalised ``level``.
    """
    columns = {
        "property": f"property_{name}",
        "state": f"state_{name}",
        "rts": "rts",
        "firings": "level",
    }
    if source not in columns:
        raise ValueError("a binding reads property, state, rts or firings")
    value = df.withColumn("value", F.col(columns[source]))
    applies = F.lit(True) if type_filter == "*" else F.col("type") == type_filter
    return value.withColumn(attribute, F.when(applies, F.expr(expression))).drop("value")


def style_by_type(
    types: DataFrame, column: str, choices: Sequence[str], too_many: str | None = None
) -> DataFrame:
    """(type, style): styles given in the order of the type names.

    With more types than styles all get ``too_many``, or the first style when that is not given.
    The list of declared types is small, whatever the number of rows.
    """
    listed = types.select(column).distinct().agg(F.array_sort(F.collect_list(column)).alias("_all"))
    numbered = listed.select(
        F.posexplode("_all").alias("_i", column), F.size("_all").alias("_n")
    )
    fallback = too_many if too_many is not None else choices[0]
    chosen = F.element_at(
        F.array(*[F.lit(c) for c in choices]),
        F.least(F.col("_i") + 1, F.lit(len(choices))).cast("int"),
    )
    return numbered.select(
        column, F.when(F.col("_n") <= len(choices), chosen).otherwise(fallback).alias("style")
    )


def show_labels(edges: DataFrame) -> Column:
    """Whether edge labels are drawn: only in graphs with few edges."""
    return edges.limit(LABEL_LIMIT).agg(F.count(F.lit(1)) < LABEL_LIMIT).scalar()
