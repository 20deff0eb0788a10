"""Log analysis: pairing, as-of state, timelines, running counts and ordered selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from portmesh.operators import relations as rel
from portmesh.operators import timelines as tl
from portmesh.registry import query, settled, with_views
from portmesh.sources.commerce import Commerce


@query(
    "j6_message_pairs",
    settled(with_views(
        "pair_events",
        """select r.id as recv_id, s.id as send_id, s.dev as source, r.dev as target,
                  r.time - s.time as latency
           from pair_events r join pair_events s on r.send_id = s.id and s.type = 'send'
           where r.type = 'recv'""",
    )),
)
def j6(spark, folder):
    pairs = rel.message_pairs(Commerce(spark, folder).pair_events())
    return pairs.select("recv_id", "send_id", "source", "target", "latency")


@query(
    "j8_complete_snapshot",
    with_views(
        "u_states",
        """, ids as (select distinct 'u_' || user_id as id from events),
             epochs as (select distinct epoch, init from u_states)
           select ids.id, epochs.epoch, epochs.init, coalesce(value, 0.0) as value,
                  coalesce(k, -1.0)::double as k, 0::bigint as rts
           from ids cross join epochs left join u_states s
             on s.id = ids.id and s.epoch = epochs.epoch and s.init = epochs.init""",
    ),
)
def j8(spark, folder):
    c = Commerce(spark, folder)
    states = c.user_states().withColumn("rts", F.lit(None).cast("bigint"))
    devices = c.user_partitions().select("id")
    defaults = {"value": 0.0, "k": -1.0, "rts": 0}
    return rel.complete_snapshot(states, devices, defaults).withColumn(
        "rts", F.col("rts").cast("bigint")
    )


@query(
    "j9_state_at",
    with_views(
        "u_log",
        """select dev, arg_max(value, seq) as value, arg_max(k, seq) as k
           from u_log where time <= 360 group by dev""",
    ),
)
def j9_at(spark, folder):
    log = Commerce(spark, folder).log()
    k = F.get_json_object("props", "$.k").cast("double")
    return rel.state_at(log.withColumn("k", k), 360, ["value", "k"])


@query(
    "j9_state_as_of",
    with_views(
        "u_log",
        """, probes as (select distinct dev, floor(time / 12) * 12 + 6.5 as time from u_log)
           select p.dev, p.time, l.value, l.id as event
           from probes p asof left join u_log l on p.dev = l.dev and p.time >= l.time""",
    ),
)
def j9_as_of(spark, folder):
    log = Commerce(spark, folder).log()
    probes = log.select("dev", (F.floor(F.col("time") / 12) * 12 + 6.5).cast("double").alias("time"))
    facts = log.withColumn("event", F.col("id"))
    return rel.state_as_of(facts, probes.distinct(), ["value", "event"])


@query(
    "w1_running_messages",
    with_views(
        "u_log",
        """, c as (select dev, floor(time / 24)::bigint as epoch,
                          count(*) filter (type = 'send') as s,
                          count(*) filter (type = 'recv') as r from u_log
                   where type in ('send', 'recv') group by 1, 2),
             span as (select dev, min(epoch) as lo from c group by 1),
             grid as (select dev, unnest(generate_series(lo, 40)) as epoch from span)
           select g.dev, g.epoch::bigint as epoch,
                  (sum(coalesce(s, 0)) over w)::bigint as messages_sent,
                  (sum(coalesce(r, 0)) over w)::bigint as messages_received
           from grid g left join c on c.dev = g.dev and c.epoch = g.epoch
           window w as (partition by g.dev order by g.epoch)""",
    ),
)
def w1(spark, folder):
    """Running counts per day, carried on to day 40 after the log has ended."""
    log = Commerce(spark, folder).log().withColumn("time", F.col("time") / 24)
    return tl.running_messages(log, 40)


TIMELINE = """select id, dev, seq,
              lag(id) over (partition by dev order by seq, id) as previous_id from u_log"""


@query("w2_timeline", with_views("u_log", TIMELINE))
def w2(spark, folder):
    return tl.timeline(Commerce(spark, folder).log().select("id", "dev", "seq"))


@query("w2_timeline_split_devices", with_views("u_log", TIMELINE))
def w2_split(spark, folder):
    """The same timeline with every device cut into short runs, as a very active device would be."""
    log = Commerce(spark, folder).log().select("id", "dev", "seq")
    return tl.timeline(log, rows_per_run=7)


@query(
    "w3_state_diff",
    with_views(
        "u_log",
        """, p as (select *, lag(value) over w as pv, lag(k) over w as pk from u_log
                   window w as (partition by dev order by seq, id))
           select id, dev, seq, 'v' as key, value::varchar as value, pv::varchar as previous
           from p where value is distinct from pv
           union all
           select id, dev, seq, 'k', k::varchar, pk::varchar from p where k is distinct from pk""",
    ),
)
def w3(spark, folder):
    diff = tl.state_diff(Commerce(spark, folder).log_with_state())
    return diff.withColumns({c: F.col(c).cast("double").cast("string") for c in ("value", "previous")})


@query(
    "w4_normalise_firings",
    with_views(
        "g_edges",
        """, f as (select source, target, target_port as message_type, 0::bigint as epoch,
                          count(*)::bigint as firings from g_edges group by 1, 2, 3),
             m as (select message_type, min(firings) as lo, max(firings) as hi from f group by 1)
           select source, target, f.message_type, epoch, firings,
                  round(case when hi = lo then 0.0 else (firings - lo) / (hi - lo) end, 6)::double
                    as level
           from f join m on f.message_type = m.message_type""",
    ),
)
def w4(spark, folder):
    fired = (
        Commerce(spark, folder)
        .edges()
        .groupBy("source", "target", F.col("target_port").alias("message_type"))
        .agg(F.count(F.lit(1)).alias("firings"))
        .withColumn("epoch", F.lit(0).cast("bigint"))
    )
    return tl.normalise_firings(fired).withColumn("level", F.round("level", 6))


@query(
    "g9_causal_edges",
    with_views(
        "pair_events",
        """, o as (select *, (time * 1000000)::bigint as seq from pair_events)
           select send_id as source, id as target, 'message' as kind from o where type = 'recv'
           union all
           select p, id, 'sequence' from (
             select id, lag(id) over (partition by dev order by seq, id) as p from o)
           where p is not null""",
    ),
)
def g9(spark, folder):
    events = Commerce(spark, folder).pair_events()
    seq = (F.col("time") * 1000000).cast("bigint")
    return tl.causal_edges(events.withColumn("seq", seq))


@query(
    "o1_sends_in_order",
    with_views("u_log", "select id, dev, time from u_log where type = 'send' order by time, id"),
)
def o1(spark, folder):
    return rel.sends_in_order(Commerce(spark, folder).log().select("id", "dev", "time", "type")).drop(
        "type"
    )


@query(
    "o2_device_events",
    with_views("u_log", "select id, type, time from u_log where dev = 'u_7' order by id::bigint"),
)
def o2(spark, folder):
    return rel.device_events(Commerce(spark, folder).log(), "u_7").select("id", "type", "time")


@query(
    "o3_first_events",
    with_views("u_log", "select id, dev, type, time from u_log order by time, id limit 500"),
)
def o3(spark, folder):
    return rel.first_events(Commerce(spark, folder).log(), 500).select("id", "dev", "type", "time")


@query(
    "o4_union",
    with_views(
        "g_parts g_edges",
        """select partition_0 as id, 'interior' as kind, count(*)::bigint as devices
           from g_parts group by 1
           union all select distinct partition_1, 'border', null::bigint from g_parts""",
    ),
)
def o4(spark, folder):
    parts = Commerce(spark, folder).device_partitions()
    interior = parts.groupBy(F.col("partition_0").alias("id"), F.lit("interior").alias("kind")).agg(
        F.count(F.lit(1)).alias("devices")
    )
    border = parts.select(F.col("partition_1").alias("id"), F.lit("border").alias("kind")).distinct()
    return rel.interior_and_border(interior, border)


@query(
    "o5_first_by_id",
    with_views(
        "pair_events",
        """select id, min(time) as time, count(*)::bigint as copies from (
             select send_id as id, time from pair_events where type = 'recv')
           group by id""",
    ),
)
def o5(spark, folder):
    """Several receives name the same send; the earliest of them is kept."""
    recvs = Commerce(spark, folder).pair_events().filter(F.col("type") == "recv")
    named = recvs.select(F.col("send_id").alias("id"), "time", F.col("dev"))
    copies = named.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    return rel.first_by_id(named).join(copies, "id").select("id", "time", "copies")
