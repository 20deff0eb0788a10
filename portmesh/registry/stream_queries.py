"""Streaming operators ST1-ST8, each run to the end of its input and compared as a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from portmesh.registry import SQL, query, settled, with_views
from portmesh.registry.rollup_queries import r6
from portmesh.session import scratch_folder
from portmesh.sinks.upkeep import KeptModel
from portmesh.sources.commerce import Commerce
from portmesh.streaming import keyed_state as ks
from portmesh.streaming import log_streams as ls


class StreamedCommerce(Commerce):
    """The same derivations over file streams."""

    def table(self, name):
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        return ls.stream_parquet(self.spark, self.folder, schema, f"{name}.parquet")


def _run(query):
    query.awaitTermination()
    return query


@query(
    "st1_ingest",
    with_views("u_log", "select id, dev, type, time, seq, port, value from u_log"),
)
def st1(spark, folder):
    here = scratch_folder(spark, "st1")
    events = StreamedCommerce(spark, folder).log().drop("props")
    _run(ls.ingest(events, f"{here}/out", f"{here}/cp"))
    return spark.read.parquet(f"{here}/out")


@query(
    "s10_push_batches",
    with_views(
        "u_log",
        "select type, count(*)::bigint as events, round(sum(value), 4) as value from u_log group by 1",
    ),
)
def s10(spark, folder):
    here = scratch_folder(spark, "s10")

    def handler(batch, batch_id):
        totals = batch.groupBy("type").agg(
            F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")
        )
        totals.write.mode("overwrite").parquet(f"{here}/out/batch={batch_id}")

    _run(ls.push(StreamedCommerce(spark, folder).log(), handler, f"{here}/cp"))
    stored = spark.read.parquet(f"{here}/out")
    return stored.groupBy("type").agg(
        F.sum("events").alias("events"), F.round(F.sum("value"), 4).alias("value")
    )


@query(
    "st2_running_counts",
    with_views(
        "u_log",
        """select dev, count(*) filter (type = 'send')::bigint as messages_sent,
                  count(*) filter (type = 'recv')::bigint as messages_received
           from u_log where type in ('send', 'recv') group by dev""",
    ),
)
def st2(spark, folder):
    here = scratch_folder(spark, "st2")
    counts = ls.running_counts(StreamedCommerce(spark, folder).log())
    _run(ls.keep_updates(counts, f"{here}/out", f"{here}/cp"))
    return ls.latest_updates(spark, f"{here}/out", ["dev"])


@query(
    "st3_running_ranges",
    with_views(
        "u_log",
        """select 'v' as state, min(value) as min, max(value) as max from u_log
           union all select 'k', min(k), max(k) from u_log""",
    ),
)
def st3(spark, folder):
    here = scratch_folder(spark, "st3")
    ranges = ls.running_ranges(StreamedCommerce(spark, folder).log_with_state())
    _run(ls.keep_updates(ranges, f"{here}/out", f"{here}/cp"))
    return ls.latest_updates(spark, f"{here}/out", ["state"])


@query(
    "st4_pair_messages",
    settled(with_views(
        "pair_events",
        """select r.id as recv_id, s.id as send_id, s.dev as source, r.dev as target,
                  r.time - s.time as latency
           from pair_events r join pair_events s on r.send_id = s.id and s.type = 'send'
           where r.type = 'recv'""",
    )),
)
def st4(spark, folder):
    """Days count as seconds; a line may be shipped years before or after its order date."""
    here = scratch_folder(spark, "st4")
    events = StreamedCommerce(spark, folder).pair_events()
    timed = ls.with_event_time(events, base=1_000_000)
    pairs = ls.pair_messages(
        timed.filter(F.col("type") == "send"),
        timed.filter(F.col("type") == "recv"),
        late="1 day",
        longest="1 day",
        early="1 day",
    )
    _run(ls.ingest(pairs, f"{here}/out", f"{here}/cp"))
    return spark.read.parquet(f"{here}/out")


@query("st5_first_by_id", "select distinct 'o' || l_orderkey as id from lineitem")
def st5(spark, folder):
    """Lines named by their order: one of each is kept, whichever comes first."""
    here = scratch_folder(spark, "st5")
    recvs = StreamedCommerce(spark, folder).pair_events().filter(F.col("type") == "recv")
    named = recvs.select(F.col("send_id").alias("id"), "time")
    first = ls.first_by_id(ls.with_event_time(named, base=1_000_000), late="1 day")
    _run(ls.ingest(first.select("id"), f"{here}/out", f"{here}/cp"))
    return spark.read.parquet(f"{here}/out")


@query(
    "st6_events_per_window",
    with_views(
        "u_log",
        """select (floor((time + 24) / 24) * 24)::bigint as start, count(*)::bigint as events,
                  count(*) filter (type = 'send')::bigint as sends
           from u_log group by 1""",
    ),
)
def st6(spark, folder):
    here = scratch_folder(spark, "st6")
    log = ls.with_event_time(StreamedCommerce(spark, folder).log(), base=24)
    windows = ls.events_per_window(log, "24 seconds", "1 day")
    _run(ls.keep_updates(windows, f"{here}/out", f"{here}/cp"))
    return ls.latest_updates(spark, f"{here}/out", ["start"])


@query(
    "st7_latest_states",
    with_views(
        "u_log",
        """select (floor((time + 24) / 24) * 24)::bigint as start, dev,
                  round(arg_max(value, seq), 6) as value from u_log group by 1, 2""",
    ),
)
def st7(spark, folder):
    here = scratch_folder(spark, "st7")
    log = ls.with_event_time(StreamedCommerce(spark, folder).log(), base=24)
    states = ls.latest_states(log, ["value"], "24 seconds", "1 day")
    _run(ls.keep_updates(states, f"{here}/out", f"{here}/cp"))
    out = ls.latest_updates(spark, f"{here}/out", ["start", "dev"])
    return out.withColumn("value", r6("value"))


@query(
    "st8_log_order",
    with_views(
        "pair_events",
        """, o as (select dev, regexp_extract(id, '[0-9]+')::bigint as seq, time from pair_events
                  where type = 'recv'),
             steps as (select dev, seq, count(*) as n, min(time) as first, max(time) as last
                       from o group by 1, 2)
           select 'V9' as rule, dev || ':' || seq as key, 'seq occurs ' || n || ' times' as detail
           from steps where n > 1
           union all
           select 'V9', dev || ':' || seq, 'time goes back' from (
             select *, lag(last) over (partition by dev order by seq) as before from steps)
           where first < before""",
    ),
)
def st8(spark, folder):
    here = scratch_folder(spark, "st8")
    recvs = StreamedCommerce(spark, folder).pair_events().filter(F.col("type") == "recv")
    seq = F.regexp_extract("id", "[0-9]+", 0).cast("bigint")
    events = recvs.select("dev", seq.alias("seq"), "time")
    _run(ls.watch_log_order(events, f"{here}/out", f"{here}/cp"))
    return ls.violations(spark, f"{here}/out")


# -- with state of their own ---------------------------------------------------------------------------


@query("st2_state_read", SQL["st2_running_counts"])
def st2_state(spark, folder):
    """The running counts from the state of the stream instead of its stored updates."""
    here = scratch_folder(spark, "st2s")
    counts = ls.running_counts(StreamedCommerce(spark, folder).log())
    _run(ls.keep_updates(counts, f"{here}/out", f"{here}/cp"))
    return ks.stored_state(spark, f"{here}/cp", counts.columns)


@query("st3_state_read", SQL["st3_running_ranges"])
def st3_state(spark, folder):
    here = scratch_folder(spark, "st3s")
    ranges = ls.running_ranges(StreamedCommerce(spark, folder).log_with_state())
    _run(ls.keep_updates(ranges, f"{here}/out", f"{here}/cp"))
    return ks.stored_state(spark, f"{here}/cp", ranges.columns)


@query(
    "st5_earliest_by_id",
    with_views(
        "pair_events",
        """, n as (select send_id as id, time, regexp_extract(id, '_([0-9]+)_', 1)::bigint as seq, dev, value
                  from pair_events where type = 'recv')
           select id, min((time, seq))[1] as time, min((time, seq))[2] as seq, arg_min(dev, (time, seq)) as dev,
                  arg_min(value, (time, seq)) as value
           from n group by id""",
    ),
)
def st5_earliest(spark, folder):
    """Lines named by their order: the earliest of each, whole."""
    here = scratch_folder(spark, "st5e")
    recvs = StreamedCommerce(spark, folder).pair_events().filter(F.col("type") == "recv")
    seq = F.regexp_extract("id", "_([0-9]+)_", 1).cast("bigint").alias("seq")
    named = recvs.select(F.col("send_id").alias("id"), "time", seq, "dev", "value")
    first = ks.earliest_by_id(ls.with_event_time(named, base=1_000_000), late="0 seconds")
    _run(ks.start_with_state(first.drop("event_time"), ls.ingest, f"{here}/out", f"{here}/cp"))
    return spark.read.parquet(f"{here}/out")


@query(
    "st7_whole_snapshots",
    settled(with_views(
        "u_log",
        """, last as (select floor((max(time) + 24 - 1) / 24) * 24 as b from u_log),
             facts as (select dev, time + 24 as time, arg_max(value, seq) as value from u_log group by 1, 2),
             grid as (select dev, unnest(generate_series((ceil(min(time) / 24) * 24)::bigint, any_value(b)::bigint, 24)) as boundary
                      from facts, last group by dev)
           select g.dev, g.boundary, round(f.value, 6) as value
           from grid g asof join facts f on g.dev = f.dev and g.boundary >= f.time""",
    )),
)
def st7_whole(spark, folder):
    """The value of every user at the end of each day, changed or not."""
    here = scratch_folder(spark, "st7w")
    events = StreamedCommerce(spark, folder).log()
    log = ls.with_event_time(events.withColumn("time", F.round("time", 6)), base=24)
    shots = ks.whole_snapshots(log, ["value"], "24 seconds", "1 second", base=24)
    _run(ks.start_with_state(shots, ls.ingest, f"{here}/out", f"{here}/cp"))
    return spark.read.parquet(f"{here}/out").withColumn("value", r6("value"))


@query("st8_keyed_order", SQL["st8_log_order"])
def st8_keyed(spark, folder):
    """Log order with the last step of each device as keyed state."""
    here = scratch_folder(spark, "st8k")
    recvs = StreamedCommerce(spark, folder).pair_events().filter(F.col("type") == "recv")
    seq = F.regexp_extract("id", "[0-9]+", 0).cast("bigint")
    events = recvs.select("dev", seq.alias("seq"), "time")
    _run(ks.start_with_state(ks.order_violations(events), ls.ingest, f"{here}/out", f"{here}/cp"))
    return spark.read.parquet(f"{here}/out")


# -- kept up batch by batch ------------------------------------------------------------------------------


def _kept(spark, folder) -> KeptModel:
    """The log in three batches by time, the second one given twice."""
    c = Commerce(spark, folder)
    model = KeptModel(scratch_folder(spark, "kept"), c.user_partitions(), [], buckets=8)
    log = c.log_with_state()
    stretch = F.least(F.floor(F.col("time") / 300), F.lit(2))
    for k in (0, 1, 1, 2):
        model.add(k, log.filter(stretch == k))
    return model


@query("e2_kept_counts", SQL["st2_running_counts"])
def e2(spark, folder):
    return _kept(spark, folder).counts.read(spark).select("dev", "messages_sent", "messages_received")


@query("e3_kept_ranges", SQL["st3_running_ranges"])
def e3(spark, folder):
    return _kept(spark, folder).ranges.read(spark).select("state", "min", "max")
