"""Roll-ups over the partition hierarchy (A1-A5, A23), value ranges and meta data."""

from __future__ import annotations

from pyspark.sql import functions as F

from portmesh.operators import rollups as roll
from portmesh.registry import query, with_views
from portmesh.sources.commerce import Commerce

PLACED = """, placed as (
    select source, target, s.partition_0 as s0, s.partition_1 as s1,
           t.partition_0 as t0, t.partition_1 as t1
    from g_edges join g_parts s on source = s.id join g_parts t on target = t.id)
"""


def r6(column):
    return F.round(column, 6)


@query(
    "a1_partition_edges",
    with_views(
        "g_parts g_edges",
        PLACED
        + """select 0 as level, 'base' as parent, s0 as source, t0 as target,
                    count(*)::bigint as count from placed where source <> target group by s0, t0
             union all
             select 1, s0, s1, t1, count(*)::bigint from placed
             where source <> target and s0 = t0 group by s0, s1, t1""",
    ),
)
def a1(spark, folder):
    c = Commerce(spark, folder)
    pairs = roll.leaf_pairs(c.edges(), c.device_partitions())
    return roll.inner_partition_edges(pairs, depth=2)


@query(
    "a2_leaf_edges",
    with_views(
        "g_parts g_edges",
        PLACED
        + """select 2 as level, s1 as parent, source, target, null::bigint as count
             from placed where s1 = t1 and source <> target""",
    ),
)
def a2(spark, folder):
    c = Commerce(spark, folder)
    return roll.partition_edges(c.edges(), c.device_partitions(), 2)


BORDER = (
    PLACED
    + """select 1 as level, parent, higher, lower, count from (
           select s0 as parent, s1 as higher, t0 as lower, count(*)::bigint as count
           from placed where s0 <> t0 group by s0, s1, t0
           union
           select t0, t1, s0, count(*)::bigint from placed where s0 <> t0 group by t0, t1, s0)
         union all
         select 2, parent, higher, lower, count from (
           select s1 as parent, source as higher, t1 as lower, count(*)::bigint as count
           from placed where s1 <> t1 group by s1, source, t1
           union
           select t1, target, s1, count(*)::bigint from placed where s1 <> t1
           group by t1, target, s1)"""
)


@query("a3_border_edges", with_views("g_parts g_edges", BORDER))
def a3(spark, folder):
    c = Commerce(spark, folder)
    edges, parts = c.edges(), c.device_partitions()
    return roll.border_edges(edges, parts, 1).unionByName(roll.border_edges(edges, parts, 2))


@query(
    "a3_border_edges_summed",
    with_views(
        "g_parts g_edges",
        PLACED
        + """select 1 as level, parent, higher, lower, count(*)::bigint as count from (
               select s0 as parent, s1 as higher, t0 as lower from placed where s0 <> t0
               union all
               select t0, t1, s0 from placed where s0 <> t0) group by all""",
    ),
)
def a3_sum(spark, folder):
    c = Commerce(spark, folder)
    return roll.border_edges(c.edges(), c.device_partitions(), 1, combine="sum")


@query(
    "a4_state_rollup",
    with_views(
        "u_parts u_states",
        """, j as (select s.*, partition_0, partition_1 from u_states s join u_parts p on s.id = p.id)
           select 0 as level, 'base' as parent, partition_0 as partition_id, epoch, init,
                  round(avg(value), 6) as value, round(avg(k), 6) as k from j group by all
           union all
           select 1, partition_0, partition_1, epoch, init, round(avg(value), 6), round(avg(k), 6)
           from j group by all""",
    ),
)
def a4(spark, folder):
    c = Commerce(spark, folder)
    up = roll.state_rollup(c.user_states(), c.user_partitions())
    return up.withColumns({"value": r6("value"), "k": r6("k")})


@query(
    "a5_property_rollup",
    with_views(
        "g_parts pair_events",
        """, counts as (select dev, count(*) filter (type = 'send') as sent,
                               count(*) filter (type = 'recv') as received
                        from pair_events group by 1),
             j as (select d.acctbal, p.*, coalesce(sent, 0) as sent, coalesce(received, 0) as received
                   from g_devices d join g_parts p on d.id = p.id left join counts on dev = d.id)
           select 0 as level, 'base' as parent, partition_0 as partition_id,
                  round(avg(acctbal), 6) as acctbal, sum(sent)::bigint as messages_sent,
                  sum(received)::bigint as messages_received from j group by partition_0
           union all
           select 1, partition_0, partition_1, round(avg(acctbal), 6), sum(sent)::bigint,
                  sum(received)::bigint from j group by partition_0, partition_1""",
    ),
)
def a5(spark, folder):
    c = Commerce(spark, folder)
    counts = roll.message_counts(c.pair_events())
    up = roll.property_rollup(
        c.devices().select("id", "acctbal"), c.device_partitions(), counts
    )
    return up.withColumn("acctbal", r6("acctbal"))


@query(
    "a6_value_ranges",
    with_views(
        "u_log",
        """select 'v' as state, min(value) as min, max(value) as max from u_log
           union all select 'k', min(k), max(k) from u_log""",
    ),
)
def a6(spark, folder):
    return roll.value_ranges(Commerce(spark, folder).log_with_state(), ["v", "k"])


@query(
    "a7_message_counts",
    with_views(
        "pair_events",
        """select dev, count(*) filter (type = 'send')::bigint as messages_sent,
                  count(*) filter (type = 'recv')::bigint as messages_received
           from pair_events group by dev""",
    ),
)
def a7(spark, folder):
    return roll.message_counts(Commerce(spark, folder).pair_events())


@query(
    "a8_message_count_ranges",
    with_views(
        "pair_events",
        """, c as (select dev, count(*) filter (type = 'send') as s,
                          count(*) filter (type = 'recv') as r from pair_events group by dev)
           select 'messages_sent' as state, 0.0::double as min, max(s)::double as max from c
           union all select 'messages_received', 0.0, max(r)::double from c""",
    ),
)
def a8(spark, folder):
    return roll.message_count_ranges(Commerce(spark, folder).pair_events())


@query(
    "a9_meta",
    with_views(
        "u_log",
        """select 'level' as name, 3::bigint as max
           union all select 'time', ceil(least(1000.0, max(time)))::bigint from u_log""",
    ),
)
def a9(spark, folder):
    return roll.meta(Commerce(spark, folder).log(), levels=3, limit=1000.0)


@query(
    "a15_send_rate",
    with_views(
        "u_log",
        """select floor(time)::bigint as epoch, count(*)::bigint as sends,
                  round(count(*) / (select count(distinct dev) from u_log), 6) as sends_per_device
           from u_log where type = 'send' group by 1""",
    ),
)
def a15(spark, folder):
    log = Commerce(spark, folder).log()
    rate = roll.send_rate(log, log.select("dev").distinct())
    return rate.withColumn("sends_per_device", r6("sends_per_device"))


@query(
    "a16_edge_firings",
    with_views(
        "pair_events",
        """select r.dev || ':in-' || s.dev || ':out' as edge,
                  floor(r.time / 30)::bigint as interval, count(*)::bigint as firings
           from pair_events r join pair_events s on r.send_id = s.id and s.type = 'send'
           where r.type = 'recv' group by 1, 2""",
    ),
)
def a16(spark, folder):
    events = Commerce(spark, folder).pair_events()
    port = F.when(F.col("type") == "send", "out").otherwise("in")
    return roll.edge_firings(events.withColumn("port", port), 30)


@query(
    "a20_touched",
    with_views(
        "g_edges",
        """, sends as (select 's_' || l_suppkey as dev, 'out_' || l_linestatus as port
                      from lineitem),
             fired as (select distinct e.* from g_edges e
                       join sends s on e.source = s.dev and e.source_port = s.port),
             own as (select dev as id from sends union select 's_' || s_suppkey from supplier)
           select 'device' as kind, id from (select id from own union select source from fired
                                             union select target from fired)
           union all
           select 'edge', target || ':' || target_port || '-' || source || ':' || source_port
           from fired""",
    ),
)
def a20(spark, folder):
    c = Commerce(spark, folder)
    sends = c.table("lineitem").select(
        F.concat(F.lit("s_"), "l_suppkey").alias("dev"),
        F.lit("send").alias("type"),
        F.concat(F.lit("out_"), "l_linestatus").alias("port"),
    )
    inits = c.table("supplier").select(
        F.concat(F.lit("s_"), "s_suppkey").alias("dev"), F.lit("init").alias("type")
    )
    events = sends.unionByName(inits, allowMissingColumns=True).withColumns(
        {
            "id": F.lit(None).cast("string"),
            "send_id": F.lit(None).cast("string"),
            "time": F.lit(0.0),
        }
    )
    # an edge for each line
    return roll.touched(events, c.edges(), rows=c.table("lineitem").count())


@query(
    "a21_bounding_box",
    """select min(c_nationkey) as min_x, max(c_nationkey) as max_x,
              min(floor(c_acctbal / 100)::bigint) as min_y,
              max(floor(c_acctbal / 100)::bigint) as max_y,
              (max(c_nationkey) - min(c_nationkey) + 1)::bigint as width,
              (max(floor(c_acctbal / 100)) - min(floor(c_acctbal / 100)) + 1)::bigint as height
       from customer""",
)
def a21(spark, folder):
    positions = Commerce(spark, folder).table("customer").select(
        F.col("c_nationkey").alias("x"),
        F.floor(F.col("c_acctbal") / 100).cast("bigint").alias("y"),
    )
    return roll.bounding_box(positions)


@query(
    "a23_event_rollup",
    with_views(
        "u_log u_parts",
        """, b as (select partition_1 as partition_id, type,
                          least(floor(time * 1000.0 / 720.0), 999)::bigint as b
                   from u_log join u_parts p on dev = p.id)
           select partition_id, steps::bigint as steps, floor(b / (1000 / steps))::bigint as bucket,
                  count(*)::bigint as events, count(*) filter (type = 'send')::bigint as sends
           from b, (values (10), (100), (1000)) as s(steps) group by all""",
    ),
)
def a23(spark, folder):
    c = Commerce(spark, folder)
    return roll.event_rollup(c.log(), c.user_partitions(), span=(0.0, 720.0))


@query(
    "a24_delayed_input",
    """with s as (select 'c_' || o_custkey as source,
                         datediff('day', date '1995-01-01', o_orderdate::date)::double as time
                  from orders),
            e as (select 'c_' || o_custkey as source, 's_' || l_suppkey as target,
                         l_linenumber as delay, l_quantity as weight
                  from lineitem join orders on l_orderkey = o_orderkey)
       select target, time + delay as time, round(sum(weight), 6) as input
       from s join e on s.source = e.source group by 1, 2""",
)
def a24(spark, folder):
    c = Commerce(spark, folder)
    sends = c.pair_events().filter(F.col("type") == "send").select(
        F.col("dev").alias("source"), "time"
    )
    edges = (
        c.table("lineitem")
        .join(c.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.concat(F.lit("c_"), "o_custkey").alias("source"),
            F.concat(F.lit("s_"), "l_suppkey").alias("target"),
            F.col("l_linenumber").alias("delay"),
            F.col("l_quantity").alias("weight"),
        )
    )
    return roll.delayed_input(sends, edges).withColumn("input", r6("input"))
