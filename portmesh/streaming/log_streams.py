"""Event logs as streams. Each operator agrees with its batch twin once the input has ended.

Log time is a number; ``with_event_time`` turns it into a timestamp. The first watermark of a query
is 1970-01-01, so a row at exactly that time would count as late: keep ``base`` positive.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType, StructField, StructType

from portmesh.operators.checks import log_order
from portmesh.sources.xml_log import event_schema, event_tag, shape_events

# Rows of a stream's task that wait to be packed.
ROWS_HELD = 1_000_000

# -- sources ------------------------------------------------------------------------------------------


def stream_xml_events(
    spark: SparkSession, path: str, kind: str, files_per_trigger: int = 100
) -> DataFrame:
    """Events of one kind (init, send or recv) from XML files as they arrive."""
    raw = (
        spark.readStream.format("xml")
        .option("rowTag", event_tag(kind))
        .option("valueTag", "_text")
        .option("maxFilesPerTrigger", files_per_trigger)
        .schema(event_schema(kind))
        .load(path)
    )
    return shape_events(raw, kind)


def stream_parquet(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    pattern: str | None = None,
    files_per_trigger: int = 100,
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def with_event_time(events: DataFrame, base: float = 1.0, alias: str = "event_time") -> DataFrame:
    return events.withColumn(alias, F.timestamp_seconds(F.col("time") + F.lit(float(base))))


# -- sinks --------------------------------------------------------------------------------------------


def ingest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append rows to Parquet exactly once, batch by batch."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def push(
    stream: DataFrame,
    handler: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
) -> StreamingQuery:
    """Hand every batch as a DataFrame to ``handler(batch, batch_id)``.

    A batch may be handed over again after a failure; handlers should overwrite by ``batch_id``.
    """
    return (
        stream.writeStream.foreachBatch(handler)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )


def keep_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store the changed rows of every batch under ``path/batch=<id>``."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return push(stream, store, checkpoint, "update")


def latest_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest stored row of every key."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    rest = [c for c in rows.columns if c not in {*keys, "batch"}]
    newest = F.max_by(F.struct(*rest), "batch").alias("_row")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_row.*")


# -- operators ----------------------------------------------------------------------------------------


def running_counts(events: DataFrame) -> DataFrame:
    """Messages sent and received so far per device (update mode)."""
    return (
        events.filter(F.col("type").isin("send", "recv"))
        .groupBy("dev")
        .agg(
            F.count_if(F.col("type") == "send").alias("messages_sent"),
            F.count_if(F.col("type") == "recv").alias("messages_received"),
        )
    )


def running_ranges(events: DataFrame, state: str = "s") -> DataFrame:
    """Smallest and largest value so far of each numeric state field (update mode)."""
    pairs = events.select(F.explode(F.from_json(state, "map<string,string>")).alias("state", "v"))
    number = pairs.select("state", F.col("v").try_cast("double").alias("v"))
    return (
        number.filter(F.col("v").isNotNull())
        .groupBy("state")
        .agg(F.min("v").alias("min"), F.max("v").alias("max"))
    )


def _packed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of equal ``keys`` that meet in a task as one row with an Arrow stream, ``pack``, of the other columns."""
    names = [c for c in rows.columns if c not in keys]
    places = {f.name: f for f in rows.schema}
    result = StructType([*(places[k] for k in keys), StructField("pack", BinaryType())])

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        order = table.select(keys).group_by(keys, use_threads=False).aggregate([([], "count_all")])
        table = table.sort_by([(k, "ascending") for k in keys])
        order = order.sort_by([(k, "ascending") for k in keys])
        packs, at = [], 0
        for n in order["count_all"].to_pylist():
            sink = pa.BufferOutputStream()
            part = table.select(names).slice(at, n).combine_chunks()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(part)
            packs.append(sink.getvalue().to_pybytes())
            at += n
        done = order.select(keys).append_column("pack", pa.array(packs, pa.binary()))
        return done.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS_HELD:
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)

    return rows.repartition(*keys).mapInArrow(run, result)


def _matched(packs: DataFrame, left: StructType, right: StructType, on: str) -> DataFrame:
    """Rows of the packs ``left`` and ``right`` of each row that agree in ``on``."""
    result = StructType([*left, *(f for f in right if f.name != on)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                one, other = (pa.ipc.open_stream(x.as_buffer()).read_all() for x in (a, b))
                both = one.join(other, on, join_type="inner", use_threads=False).select(result.names)
                yield from both.to_batches(max_chunksize=10_000)

    return packs.mapInArrow(run, result)


def pair_messages(
    sends: DataFrame,
    recvs: DataFrame,
    late: str = "1 hour",
    longest: str = "1 hour",
    early: str = "0 seconds",
    salts: int = 8,
    shares: int = 1024,
) -> DataFrame:
    """Receives joined to their sends as both arrive; both need ``event_time``.

    A receive may lie up to ``longest`` after and ``early`` before its send. One send can own a large
    share of the receives, so receives are spread over ``salts`` and every send is copied to each.

    The state of the join has its price per row, so a batch brings it packs instead of rows: those of one
    of ``shares`` hashes of the send id and of one cell of time, as wide as a message may take. A pack is
    held until the end of its cell cannot be met any more. Rows later than the watermark are lost,
    but for those whose cell is still held.
    """
    width = max(1, math.ceil(sum(pd.Timedelta(x).total_seconds() for x in (longest, early))))

    def cell(at: str) -> Column:
        """The end of the cell, not before the time itself."""
        return F.timestamp_seconds((F.floor(F.unix_micros(at) / (width * 1_000_000)) + 1) * width)

    share = F.pmod(F.xxhash64("send_id"), F.lit(shares)).cast("int")
    left = sends.select(
        F.col("id").alias("send_id"),
        F.col("dev").alias("source"),
        F.col("time").alias("send_time"),
        F.col("event_time").alias("_sent_at"),
    ).where(F.col("send_id").isNotNull() & F.col("_sent_at").isNotNull())
    right = recvs.select(
        "send_id",
        F.col("id").alias("recv_id"),
        F.col("dev").alias("target"),
        F.col("time").alias("recv_time"),
        F.col("event_time").alias("_received_at"),
    ).where(F.col("send_id").isNotNull() & F.col("_received_at").isNotNull())
    # the delay covers the way from a time to the end of its cell
    delay = f"{late} {width} seconds"
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    sent = (
        _packed(left.select("*", share.alias("_share"), cell("_sent_at").alias("_sent_by")), ["_share", "_sent_by"])
        .select(F.col("pack").alias("_sent"), "_share", "_sent_by", copies.alias("_salt"))
        .withWatermark("_sent_by", delay)
    )
    salt = F.pmod(F.xxhash64("recv_id"), F.lit(salts)).cast("int")
    received = (
        _packed(
            right.select(
                "*", share.alias("_recv_share"), salt.alias("_recv_salt"), cell("_received_at").alias("_received_by")
            ),
            ["_recv_share", "_recv_salt", "_received_by"],
        )
        .withColumnRenamed("pack", "_received")
        .withWatermark("_received_by", delay)
    )
    near = F.expr(
        f"_received_by >= _sent_by - interval {early} - interval {width} seconds and "
        f"_received_by <= _sent_by + interval {longest} + interval {width} seconds"
    )
    meet = (F.col("_share") == F.col("_recv_share")) & (F.col("_salt") == F.col("_recv_salt")) & near
    packs = sent.join(received, meet).select("_sent", "_received")
    bound = F.expr(
        f"_received_at >= _sent_at - interval {early} and "
        f"_received_at <= _sent_at + interval {longest}"
    )
    return _matched(packs, left.schema, right.schema, "send_id").where(bound).select(
        "recv_id",
        "send_id",
        "source",
        "target",
        (F.col("recv_time") - F.col("send_time")).alias("latency"),
    )


def first_by_id(events: DataFrame, late: str = "1 hour", salts: int = 8) -> DataFrame:
    """One row per event id among those within the watermark; needs ``event_time``.

    Copies are first dropped inside ``salts`` shares of the rows, so an id with very many copies
    reaches its own task at most ``salts`` times.
    """
    marked = events.withWatermark("event_time", late)
    if salts > 1:
        share = F.floor(F.rand() * salts).cast("int")
        marked = marked.withColumn("_share", share).dropDuplicatesWithinWatermark(["id", "_share"])
        marked = marked.drop("_share")
    return marked.dropDuplicatesWithinWatermark(["id"])


def events_per_window(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Events and sends per tumbling window; needs ``event_time``.

    In append mode a window is emitted when the watermark passes it, so the last ones wait for later
    rows; in update mode every change is emitted.
    """
    return (
        events.withWatermark("event_time", late)
        .groupBy(F.window("event_time", width).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_if(F.col("type") == "send").alias("sends"),
        )
        .select(F.unix_seconds("w.start").alias("start"), "events", "sends")
    )


def latest_states(
    events: DataFrame, columns: Sequence[str], width: str, late: str = "1 hour"
) -> DataFrame:
    """The last state of each device in each interval in which it had events; needs ``event_time``.

    These are the changes between snapshots; ``state_as_of`` on them gives whole snapshots.
    """
    order = F.struct("time", "seq")
    return (
        events.withWatermark("event_time", late)
        .groupBy(F.window("event_time", width).alias("w"), "dev")
        .agg(F.max_by(F.struct(*columns), order).alias("_state"))
        .select(F.unix_seconds("w.start").alias("start"), "dev", "_state.*")
    )


def watch_log_order(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store log-order violations as they arrive under ``path/violations/batch=<id>``.

    Between batches only the last (seq, time) of each device is kept, one small row each, under
    ``path/last/<id>``. A batch is checked together with those rows by the batch rule, which splits
    very active devices.
    """
    spark = events.sparkSession
    keys = ["dev", "seq", "time"]

    def check(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*keys).withColumn("_new", F.lit(True))
        if batch_id > 0:
            last = spark.read.parquet(f"{path}/last/{batch_id - 1}").select(
                *keys, F.lit(False).alias("_new")
            )
        else:
            last = rows.limit(0)
        both = rows.unionByName(last)
        behind = (
            rows.join(last.select("dev", F.col("seq").alias("_seq")), "dev")
            .filter(F.col("seq") <= F.col("_seq"))
            .select(
                F.lit("V9").alias("rule"),
                F.concat_ws(":", "dev", "seq").alias("key"),
                F.lit("seq does not rise").alias("detail"),
            )
        )
        found = log_order(both).unionByName(behind)
        found.write.mode("overwrite").parquet(f"{path}/violations/batch={batch_id}")
        newest = both.groupBy("dev").agg(
            F.max_by(F.struct("seq", "time"), F.struct("seq", "time")).alias("_l")
        )
        newest.select("dev", "_l.seq", "_l.time").write.mode("overwrite").parquet(
            f"{path}/last/{batch_id}"
        )

    return push(events.select(*keys), check, checkpoint)


def violations(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.option("basePath", f"{path}/violations")
        .parquet(f"{path}/violations/batch=*")
        .select("rule", "key", "detail")
    )


def dropped_late_rows(query: StreamingQuery) -> int:
    """Rows that came later than the watermark, over all batches of a finished query."""
    return sum(
        int(op.numRowsDroppedByWatermark)
        for progress in query.recentProgress
        for op in progress.stateOperators
    )
