"""Streams over several files, each against its batch twin."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from portmesh.operators import checks
from portmesh.operators import relations as rel
from portmesh.operators import rollups as roll
from portmesh.sinks import xml
from portmesh.sources import xml_log
from portmesh.streaming import keyed_state as ks
from portmesh.streaming import log_streams as ls

SCHEMA = (
    "id string, dev string, type string, time double, seq bigint, send_id string, port string, s string"
)


@pytest.fixture(scope="module")
def log(spark):
    data, seq = [], 0
    for t in range(30):
        for dev in ("hub", "hub", f"d{t % 4}"):
            seq += 1
            data.append((f"s{seq}", dev, "send", float(t), seq, None, "out", f'{{"v":{seq % 7}}}'))
            data.append((f"r{seq}", f"d{seq % 5}", "recv", t + 0.5, seq, f"s{seq}", "in", f'{{"v":{-seq}}}'))
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def folder(log, tmp_path_factory):
    """Three files, the log cut by time."""
    path = tmp_path_factory.mktemp("stream") / "in"
    for k in range(3):
        part = log.filter((F.col("time") >= 10 * k) & (F.col("time") < 10 * k + 10))
        part.coalesce(1).write.mode("append").parquet(str(path))
    return str(path)


@pytest.fixture
def stream(spark, folder, log):
    return ls.with_event_time(ls.stream_parquet(spark, folder, log.schema, files_per_trigger=1), 10)


def _end(query):
    query.awaitTermination()
    return query


def test_ingest_once(spark, stream, log, tmp_path):
    for _ in range(2):  # a restart finds nothing new
        query = _end(ls.ingest(stream.drop("event_time"), f"{tmp_path}/out", f"{tmp_path}/cp"))
    assert rows(spark.read.parquet(f"{tmp_path}/out").select(log.columns)) == rows(log)
    assert query.exception() is None


def test_running_totals(spark, stream, log, tmp_path):
    _end(ls.keep_updates(ls.running_counts(stream), f"{tmp_path}/c", f"{tmp_path}/cc"))
    assert rows(ls.latest_updates(spark, f"{tmp_path}/c", ["dev"])) == rows(roll.message_counts(log))
    _end(ls.keep_updates(ls.running_ranges(stream), f"{tmp_path}/r", f"{tmp_path}/rc"))
    assert rows(ls.latest_updates(spark, f"{tmp_path}/r", ["state"])) == rows(roll.value_ranges(log))


def test_pairs_and_first_by_id(spark, stream, log, tmp_path):
    pairs = ls.pair_messages(
        stream.filter("type = 'send'"), stream.filter("type = 'recv'"), "1 minute", "5 seconds"
    )
    _end(ls.ingest(pairs, f"{tmp_path}/p", f"{tmp_path}/pc"))
    want = rel.message_pairs(log).select("recv_id", "send_id", "source", "target", "latency")
    assert rows(spark.read.parquet(f"{tmp_path}/p")) == rows(want)
    many = stream.withColumn("id", F.when(F.col("dev") == "hub", "same").otherwise(F.col("id")))
    first = ls.first_by_id(many, "1 hour").select("id")
    _end(ls.ingest(first, f"{tmp_path}/f", f"{tmp_path}/fc"))
    ids = log.select(F.when(F.col("dev") == "hub", "same").otherwise(F.col("id"))).distinct()
    assert rows(spark.read.parquet(f"{tmp_path}/f")) == rows(ids)


def test_pairs_are_held_in_packs(spark, stream, log, tmp_path):
    sends, recvs = stream.filter("type = 'send'"), stream.filter("type = 'recv'")
    pairs = ls.pair_messages(sends, recvs, "1 hour", "1 hour", "1 hour", salts=2, shares=1)
    query = _end(ls.ingest(pairs, f"{tmp_path}/p", f"{tmp_path}/pc"))
    want = rel.message_pairs(log).select("recv_id", "send_id", "source", "target", "latency")
    assert rows(spark.read.parquet(f"{tmp_path}/p")) == rows(want)
    held = max(op.numRowsTotal for p in query.recentProgress for op in p.stateOperators)
    assert 0 < held <= 12 < log.count()  # a batch brings two packs of each side


def test_windows_in_append_mode_wait_for_the_watermark(spark, stream, tmp_path):
    windows = ls.events_per_window(stream, "10 seconds", "1 second")
    _end(ls.ingest(windows, f"{tmp_path}/w", f"{tmp_path}/wc"))
    # The last window stays open: nothing later has moved the watermark past it.
    assert rows(spark.read.parquet(f"{tmp_path}/w")) == [(10, 60, 30), (20, 60, 30)]
    states = ls.latest_states(stream, ["s"], "10 seconds", "1 second")
    _end(ls.keep_updates(states, f"{tmp_path}/s", f"{tmp_path}/sc"))
    got = ls.latest_updates(spark, f"{tmp_path}/s", ["start", "dev"])
    assert rows(got.filter("dev = 'hub'").select("start", "s")) == [
        (10, '{"v":1}'), (20, '{"v":3}'), (30, '{"v":5}')
    ]


def test_order_violations_across_batches(spark, stream, tmp_path):
    swapped = stream.filter("dev = 'hub'").withColumn(
        "seq", F.when(F.col("time") == 15, F.col("seq") - 40).otherwise(F.col("seq"))
    )
    _end(ls.watch_log_order(swapped, f"{tmp_path}/o", f"{tmp_path}/oc"))
    got = rows(ls.violations(spark, f"{tmp_path}/o").select("key", "detail"))
    assert ("hub:6", "seq does not rise") in got and ("hub:7", "seq does not rise") in got


def test_xml_stream(spark, log, tmp_path):
    full = log.withColumns(
        {
            "elapsed": F.lit(0.0), "rts": F.lit(1).cast("bigint"), "cancel": F.lit(False),
            "fanout": F.lit(1), "m": F.lit(None).cast("string"), "s": F.lit('"v":1'),
            "l": F.lit(None).cast("array<string>"),
        }
    )
    xml.write_events_xml(full, f"{tmp_path}/x")
    stream = ls.stream_xml_events(spark, f"{tmp_path}/x/send", "send")
    _end(ls.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/cp"))
    want = xml_log.read_events(spark, f"{tmp_path}/x").filter("type = 'send'")
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(want)


def test_late_rows_are_counted(spark, folder, log, tmp_path):
    stream = ls.with_event_time(ls.stream_parquet(spark, folder, log.schema, files_per_trigger=1), 10)
    late = stream.withColumn(
        "event_time",
        F.when((F.col("id") == "s80"), F.timestamp_seconds(F.lit(10))).otherwise(F.col("event_time")),
    )
    windows = ls.events_per_window(late, "5 seconds", "1 second")
    query = _end(ls.ingest(windows, f"{tmp_path}/w", f"{tmp_path}/wc"))
    assert ls.dropped_late_rows(query) == 1


def test_running_totals_from_state(spark, stream, log, tmp_path):
    counts = ls.running_counts(stream)
    _end(ls.keep_updates(counts, f"{tmp_path}/c", f"{tmp_path}/cc"))
    got = ks.stored_state(spark, f"{tmp_path}/cc", counts.columns)
    assert rows(got) == rows(roll.message_counts(log))


def test_the_earliest_row_of_each_id(spark, stream, log, tmp_path):
    """Copies in one batch and in later ones; a restart gives nothing twice."""
    named = lambda df: df.withColumn("id", F.concat(F.lit("x"), F.pmod("seq", F.lit(13))))
    for _ in range(2):
        first = ks.earliest_by_id(named(stream), "1 second", "1 hour").drop("event_time")
        _end(ks.start_with_state(first, ls.ingest, f"{tmp_path}/f", f"{tmp_path}/fc"))
    assert rows(spark.read.parquet(f"{tmp_path}/f").select(log.columns)) == rows(rel.first_by_id(named(log)))


def test_whole_snapshots_hold_silent_devices(spark, stream, log, tmp_path):
    quiet = F.col("dev").isin("hub", "d1") | (F.col("time") < 8)  # the others fall silent
    for _ in range(2):
        shots = ks.whole_snapshots(stream.filter(quiet), ["s", "type"], "5 seconds", "1 second", base=10)
        _end(ks.start_with_state(shots, ls.ingest, f"{tmp_path}/s", f"{tmp_path}/sc"))
    got = spark.read.parquet(f"{tmp_path}/s")
    facts = log.filter(quiet).withColumn("time", F.col("time") + 10)
    # the last event is at 39.5, so the watermark ends at 38.5
    grid = facts.groupBy("dev").agg(F.min("time").alias("first")).select(
        "dev", F.explode(F.sequence((F.ceil(F.col("first") / 5) * 5).cast("int"), F.lit(35), F.lit(5))).alias("time")
    )
    grid = grid.withColumn("time", F.col("time").cast("double"))
    want = rel.state_as_of(facts, grid, ["s", "type"]).withColumn("boundary", F.col("time").cast("bigint"))
    assert rows(got.select("dev", "boundary", "s", "type")) == rows(want.select("dev", "boundary", "s", "type"))
    assert got.filter("dev = 'd0' and boundary = 35").count() == 1


def test_order_with_keyed_state(spark, stream, log, tmp_path):
    """As the batch rule while seqs come in order; a restart adds nothing."""
    odd = lambda df: df.withColumn("time", F.when(F.col("seq") % 7 == 0, F.col("time") - 3).otherwise(F.col("time"))).withColumn(
        "seq", F.when(F.col("seq") % 11 == 0, F.col("seq") - 1).otherwise(F.col("seq"))
    )
    for _ in range(2):
        found = ks.order_violations(odd(stream))
        _end(ks.start_with_state(found, ls.ingest, f"{tmp_path}/o", f"{tmp_path}/oc"))
    want = rows(checks.log_order(odd(log)).select("rule", "key", "detail"))
    assert rows(spark.read.parquet(f"{tmp_path}/o")) == want and want


def test_a_seq_that_comes_late_does_not_rise(spark, stream, tmp_path):
    swapped = stream.filter("dev = 'hub'").withColumn(
        "seq", F.when(F.col("time") == 15, F.col("seq") - 40).otherwise(F.col("seq"))
    )
    _end(ks.start_with_state(ks.order_violations(swapped), ls.ingest, f"{tmp_path}/o", f"{tmp_path}/oc"))
    got = rows(spark.read.parquet(f"{tmp_path}/o").select("key", "detail"))
    assert ("hub:6", "seq does not rise") in got and ("hub:7", "seq does not rise") in got
