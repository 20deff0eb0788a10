"""Per-device order: timelines, state differences, running counts and firing normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portmesh.operators.skew import ROWS_PER_RUN, previous_in_order


def running_messages(events: DataFrame, max_time: int) -> DataFrame:
    """Messages sent and received so far, per device and epoch from its first message on.

    Events are counted per (device, epoch) before anything is ordered, and silent epochs are filled
    up to ``max_time``; a device therefore has at most ``max_time + 1`` rows in its window.
    """
    epoch = F.floor("time").cast("int")
    counted = (
        events.filter(F.col("type").isin("send", "recv") & (F.col("time") < max_time + 1))
        .groupBy("dev", epoch.alias("epoch"))
        .agg(
            F.count_if(F.col("type") == "send").alias("_sent"),
            F.count_if(F.col("type") == "recv").alias("_received"),
        )
    )
    by_device = Window.partitionBy("dev").orderBy("epoch")
    upto = by_device.rowsBetween(Window.unboundedPreceding, 0)
    following = F.coalesce(F.lead("epoch").over(by_device), F.lit(max_time + 1))
    steps = counted.select(
        "dev",
        "epoch",
        F.sum("_sent").over(upto).alias("messages_sent"),
        F.sum("_received").over(upto).alias("messages_received"),
        following.alias("_next"),
    )
    # A step holds until the next epoch with a message.
    return steps.select(
        "dev",
        F.explode(
            F.sequence(F.col("epoch").cast("bigint"), F.col("_next").cast("bigint") - 1)
        ).alias("epoch"),
        "messages_sent",
        "messages_received",
    )


def timeline(events: DataFrame, rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """Events with the id of the device's previous event in seq order."""
    ordered = previous_in_order(events, ["dev"], "seq", ["id"], ["id"], "_prev", rows_per_run)
    return ordered.withColumn("previous_id", F.col("_prev.id")).drop("_prev")


def state_diff(events: DataFrame, state: str = "s", rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """Per event the state keys whose value differs from the device's previous state.

    Values are compared as text. A key that vanished counts as ``0``; the first event of a device
    differs in all its keys.
    """
    slim = events.select("id", "dev", "seq", F.from_json(state, "map<string,string>").alias("_now"))
    ordered = previous_in_order(slim, ["dev"], "seq", ["id"], ["_now"], "_prev", rows_per_run)
    nothing = F.create_map().cast("map<string,string>")
    now = F.coalesce("_now", nothing)
    before = F.coalesce(F.col("_prev._now"), nothing)
    merged = F.map_zip_with(
        now,
        before,
        lambda k, a, b: F.struct(
            F.when(F.map_contains_key(now, k), a).otherwise("0").alias("value"), b.alias("previous")
        ),
    )
    changed = F.map_filter(merged, lambda k, v: ~v["value"].eqNullSafe(v["previous"]))
    return ordered.select(
        "id", "dev", "seq", F.explode(changed).alias("key", "change")
    ).select("id", "dev", "seq", "key", "change.value", "change.previous")


def normalise_firings(edge_states: DataFrame) -> DataFrame:
    """Firings scaled to [0, 1] inside each (message type, epoch); 0 where all are equal.

    The extremes are a small aggregate joined back, so a message type that owns most edges does not
    become one window partition.
    """
    keys = ["message_type", "epoch"]
    ends = edge_states.groupBy(*keys).agg(
        F.min("firings").alias("_lo"), F.max("firings").alias("_hi")
    )
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(span == 0, F.lit(0.0)).otherwise((F.col("firings") - F.col("_lo")) / span)
    return edge_states.join(ends, keys).withColumn("level", scaled).drop("_lo", "_hi")


def causal_edges(events: DataFrame, rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """Send-to-receive edges and edges between consecutive events of a device."""
    messages = events.filter(F.col("type") == "recv").select(
        F.col("send_id").alias("source"), F.col("id").alias("target"), F.lit("message").alias("kind")
    )
    sequence = (
        timeline(events.select("id", "dev", "seq"), rows_per_run)
        .filter(F.col("previous_id").isNotNull())
        .select(
            F.col("previous_id").alias("source"),
            F.col("id").alias("target"),
            F.lit("sequence").alias("kind"),
        )
    )
    return messages.unionByName(sequence)


