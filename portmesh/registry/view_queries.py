"""The read views VW1-VW6 and the model build."""

from __future__ import annotations

from pyspark.sql import functions as F

from portmesh.operators import rollups as roll
from portmesh.plans import build, views
from portmesh.registry import SQL, query, with_views
from portmesh.registry.rollup_queries import BORDER, PLACED, r6
from portmesh.session import scratch_folder
from portmesh.sinks.clustered import load_clustered, save_clustered
from portmesh.sources.commerce import Commerce
from portmesh.tables import TYPE_FIELDS, Model


def _structure_model(c: Commerce) -> Model:
    """Balances as the state at the start, orders and lines as messages."""
    devices, parts, edges = c.devices(), c.device_partitions(), c.edges()
    states = devices.select(
        "id", F.lit(0).cast("bigint").alias("epoch"), F.lit(1).alias("init"), "acctbal"
    )
    counts = roll.message_counts(c.pair_events())
    sent = counts.withColumnRenamed("dev", "id")
    properties = devices.select("id", "nationkey").join(sent, "id", "left").fillna(0)
    pairs = roll.leaf_pairs(edges, parts)
    levels = roll.inner_partition_edges(pairs, 2).unionByName(roll.partition_edges(edges, parts, 2))
    borders = roll.inner_border_edges(pairs, 2).unionByName(roll.border_edges(edges, parts, 2))
    return Model(
        devices=devices,
        device_partitions=parts,
        device_states=states,
        device_properties=properties,
        partition_edges=levels,
        border_edges=borders,
        state_rollup=roll.state_rollup(states, parts),
        property_rollup=roll.property_rollup(properties.select("id", "nationkey"), parts, counts),
    )


def _flat(nodes, edges):
    """Nodes and edges as one table."""
    counts = [
        F.coalesce(F.col(c), F.lit(None)).cast("bigint").alias(c)
        for c in ("messages_sent", "messages_received")
    ]
    shown = nodes.select(
        F.lit("node").alias("item"),
        "kind",
        F.col("id").alias("a"),
        F.lit(None).cast("string").alias("b"),
        r6("acctbal").alias("acctbal"),
        *counts,
        F.lit(None).cast("bigint").alias("count"),
    )
    arcs = edges.select(
        F.lit("edge").alias("item"),
        F.lit(None).cast("string").alias("kind"),
        F.col("source").alias("a"),
        F.col("target").alias("b"),
        F.lit(None).cast("double").alias("acctbal"),
        F.lit(None).cast("bigint").alias("messages_sent"),
        F.lit(None).cast("bigint").alias("messages_received"),
        "count",
    )
    return shown.unionByName(arcs)


NODES = """, counts as (select dev, count(*) filter (type = 'send') as sent,
                          count(*) filter (type = 'recv') as received from pair_events group by 1),
    j as (select d.id, d.acctbal, p.partition_0, p.partition_1, coalesce(sent, 0) as sent,
                 coalesce(received, 0) as received
          from g_devices d join g_parts p on d.id = p.id left join counts on dev = d.id)
"""
ARC = "null::varchar as kind"
NONE = "null::double as acctbal, null::bigint as messages_sent, null::bigint as messages_received"


@query(
    "vw1_drill_down_root",
    with_views(
        "g_parts g_edges pair_events",
        PLACED
        + NODES
        + f"""select 'node' as item, 'interior' as kind, partition_0 as a, null::varchar as b,
                     round(avg(acctbal), 6) as acctbal, sum(sent)::bigint as messages_sent,
                     sum(received)::bigint as messages_received, null::bigint as count
              from j group by partition_0
              union all
              select 'edge', {ARC}, s0, t0, {NONE}, count(*)::bigint from placed
              where source <> target and s0 <> t0 group by s0, t0""",
    ),
)
def vw1_root(spark, folder):
    return _flat(*views.drill_down(_structure_model(Commerce(spark, folder)), "base"))


@query(
    "vw1_drill_down_inner",
    with_views(
        "g_parts g_edges pair_events",
        PLACED
        + NODES
        + f""", b as ({BORDER.replace(PLACED, '')})
              select 'node' as item, 'interior' as kind, partition_1 as a, null::varchar as b,
                     round(avg(acctbal), 6) as acctbal, sum(sent)::bigint as messages_sent,
                     sum(received)::bigint as messages_received, null::bigint as count
              from j where partition_0 = 'base_2' group by partition_1
              union all
              select distinct 'node', 'border', lower, null::varchar, {NONE}, null::bigint from b
              where parent = 'base_2' and level = 1
              union all
              select 'edge', {ARC}, s1, t1, {NONE}, count(*)::bigint from placed
              where s0 = 'base_2' and t0 = 'base_2' and s1 <> t1 group by s1, t1
              union all
              select 'edge', {ARC}, higher, lower, {NONE}, count from b
              where parent = 'base_2' and level = 1""",
    ),
)
def vw1_inner(spark, folder):
    return _flat(*views.drill_down(_structure_model(Commerce(spark, folder)), "base_2"))


@query(
    "vw1_drill_down_leaf",
    with_views(
        "g_parts g_edges pair_events",
        PLACED
        + NODES
        + f""", b as ({BORDER.replace(PLACED, '')})
              select 'node' as item, 'interior' as kind, id as a, null::varchar as b,
                     round(acctbal, 6) as acctbal, sent::bigint as messages_sent,
                     received::bigint as messages_received, null::bigint as count
              from j where partition_1 = 'base_2_7'
              union all
              select distinct 'node', 'border', lower, null::varchar, {NONE}, null::bigint from b
              where parent = 'base_2_7' and level = 2
              union all
              select 'edge', {ARC}, source, target, {NONE}, null::bigint from placed
              where s1 = 'base_2_7' and t1 = 'base_2_7' and source <> target
              union all
              select 'edge', {ARC}, higher, lower, {NONE}, count from b
              where parent = 'base_2_7' and level = 2""",
    ),
)
def vw1_leaf(spark, folder):
    return _flat(*views.drill_down(_structure_model(Commerce(spark, folder)), "base_2_7"))


def _run_model(c: Commerce) -> Model:
    states, parts = c.user_states(), c.user_partitions()
    return Model(
        device_partitions=parts,
        device_states=states,
        events=c.log(),
        state_rollup=roll.state_rollup(states, parts),
    )


HISTORY = """, j as (select s.*, partition_0, partition_1 from u_states s join u_parts p on s.id = p.id)
"""


@query(
    "vw2_rollup_history",
    with_views(
        "u_parts u_states",
        HISTORY
        + """select partition_1 as partition_id, epoch, round(avg(value), 6) as value,
                    round(avg(k), 6) as k
             from j where partition_0 = 'base_4' and epoch between 4 and 11 group by all""",
    ),
)
def vw2(spark, folder):
    model = _run_model(Commerce(spark, folder))
    rows = views.rollup_history(model, "base_4", 5, 10)
    return rows.select("partition_id", "epoch", r6("value").alias("value"), r6("k").alias("k"))


@query(
    "vw3_event_window",
    with_views(
        "g_parts pair_events",
        """select id, type, dev, time, send_id from pair_events
           where type in ('send', 'recv') and time between 499 and 801
             and dev in (select id from g_parts where partition_1 = 'base_2_7')""",
    ),
)
def vw3(spark, folder):
    c = Commerce(spark, folder)
    model = Model(device_partitions=c.device_partitions(), events=c.pair_events())
    sends, recvs = views.event_window(model, "base_2_7", 500, 800)
    return sends.unionByName(recvs).select("id", "type", "dev", "time", "send_id")


@query(
    "vw3_last_receives",
    with_views(
        "g_parts pair_events",
        """select send_id, max(time) as time, arg_max(id, (time, id)) as id from pair_events
           where type = 'recv' and time between 499 and 801
             and dev in (select id from g_parts where partition_1 = 'base_2_7')
           group by send_id""",
    ),
)
def vw3_last(spark, folder):
    c = Commerce(spark, folder)
    model = Model(device_partitions=c.device_partitions(), events=c.pair_events())
    _, recvs = views.event_window(model, "base_2_7", 500, 800, last_recv_only=True)
    return recvs.select("send_id", "time", "id")


@query(
    "vw4_stepper",
    with_views(
        "u_parts u_states",
        HISTORY
        + """select partition_1 as id, epoch, round(avg(value), 6) as value, round(avg(k), 6) as k
             from j where partition_0 = 'base_1' group by all
             union all
             select id, epoch, round(value, 6), round(k, 6) from j
             where partition_1 = 'base_1_6'""",
    ),
)
def vw4(spark, folder):
    model = _run_model(Commerce(spark, folder))
    columns = ["id", "epoch", r6("value").alias("value"), r6("k").alias("k")]
    inner = views.stepper(model, "base_1").select(*columns)
    return inner.unionByName(views.stepper(model, "base_1_6").select(*columns))


def _clustered(spark, model: Model) -> Model:
    """The model written and read in its clustered layout, two leaf partitions to a cell."""
    here = scratch_folder(spark, "clustered")
    save_clustered(model, here, leaves_per_cell=2)
    return load_clustered(spark, here, model)


@query("vw1_clustered_leaf", SQL["vw1_drill_down_leaf"])
def vw1_clustered(spark, folder):
    """The leaf view from the clustered layout."""
    model = _clustered(spark, _structure_model(Commerce(spark, folder)))
    return _flat(*views.drill_down(model, "base_2_7"))


@query("vw3_clustered_window", SQL["vw3_event_window"])
def vw3_clustered(spark, folder):
    """The event window from the clustered layout."""
    c = Commerce(spark, folder)
    model = _clustered(spark, Model(device_partitions=c.device_partitions(), events=c.pair_events()))
    sends, recvs = views.event_window(model, "base_2_7", 500, 800)
    return sends.unionByName(recvs).select("id", "type", "dev", "time", "send_id")


@query("vw4_clustered_stepper", SQL["vw4_stepper"])
def vw4_clustered(spark, folder):
    """The stepper from the clustered layout, above the leaves and at one."""
    model = _clustered(spark, _run_model(Commerce(spark, folder)))
    columns = ["id", "epoch", r6("value").alias("value"), r6("k").alias("k")]
    inner = views.stepper(model, "base_1").select(*columns)
    return inner.unionByName(views.stepper(model, "base_1_6").select(*columns))


@query(
    "vw5_catalogue",
    with_views(
        "u_log g_ports",
        """, c as (select dev, count(*) filter (type = 'send') as s,
                         count(*) filter (type = 'recv') as r from u_log group by dev)
           select 'meta' as item, 'level' as name, null::double as min, 3.0::double as max
           union all
           select 'meta', 'time', null, ceil(least(100.0, max(time)))::double from u_log
           union all select 'range', 'v', min(value), max(value) from u_log
           union all select 'range', 'k', min(k), max(k) from u_log
           union all select 'range', 'messages_sent', 0.0, max(s)::double from c
           union all select 'range', 'messages_received', 0.0, max(r)::double from c
           union all select distinct 'port', name, null::double, null::double from g_ports
           union all select distinct 'message_type', message_type, null::double, null::double
                     from g_ports
           union all select 'fields', 'user|k,v|', null, null""",
    ),
)
def vw5(spark, folder):
    c = Commerce(spark, folder)
    events = c.log_with_state()
    declared = [("device", "user", "state", "v", 0), ("device", "user", "state", "k", 1)]
    fields = spark.createDataFrame(
        declared, "owner_kind string, owner string, section string, name string, idx int"
    ).withColumns({"path": F.col("name"), "kind": F.lit("scalar")})
    for f in TYPE_FIELDS:
        if f.name not in fields.columns:
            fields = fields.withColumn(f.name, F.lit(None).cast(f.dataType))
    model = Model(
        meta=roll.meta(events, 3),
        value_ranges=roll.all_ranges(events, ["v", "k"]),
        type_fields=fields,
        ports=c.ports(),
    )
    found = views.catalogue(model)
    none = F.lit(None).cast("double")

    def rows(item, df, name, low=none, high=none):
        return df.select(
            F.lit(item).alias("item"),
            name.alias("name"),
            low.cast("double").alias("min"),
            high.cast("double").alias("max"),
        )

    listed = F.concat_ws("|", "id", "states", "properties")
    return (
        rows("meta", found["meta"], F.col("name"), high=F.col("max"))
        .unionByName(
            rows("range", found["value_ranges"], F.col("state"), F.col("min"), F.col("max"))
        )
        .unionByName(rows("port", found["ports"], F.col("name")))
        .unionByName(rows("message_type", found["message_types"], F.col("message_type")))
        .unionByName(rows("fields", found["field_lists"], listed))
    )


@query(
    "vw6_border_partitions",
    with_views(
        "g_parts g_edges",
        PLACED
        + """select distinct t0 as partition_id from placed where s0 = 'base_3' and t0 <> 'base_3'
             union
             select s0 from placed where t0 = 'base_3' and s0 <> 'base_3'""",
    ),
)
def vw6(spark, folder):
    return views.border_partitions(_structure_model(Commerce(spark, folder)), "base_3")


@query(
    "e1_build_model",
    with_views(
        "g_parts g_edges pair_events",
        PLACED
        + NODES
        + f""", b as ({BORDER.replace(PLACED, '')}),
             e as (select 0 as level, s0 as source, t0 as target, count(*) as n from placed
                   where source <> target group by s0, t0
                   union all
                   select 1, s1, t1, count(*) from placed where source <> target and s0 = t0
                   group by s1, t1
                   union all
                   select 2, source, target, null from placed where s1 = t1 and source <> target)
             select 'partition_edges' as item, level, count(*)::bigint as items,
                    coalesce(sum(n), 0)::bigint as total from e group by level
             union all
             select 'border_edges', level, count(*)::bigint, sum(count)::bigint from b group by level
             union all
             select 'state_rollup', 0, count(distinct partition_0)::bigint, 0::bigint from j
             union all
             select 'state_rollup', 1, count(distinct partition_1)::bigint, 0::bigint from j
             union all
             select 'property_rollup', 0, count(distinct partition_0)::bigint,
                    sum(sent + received)::bigint from j
             union all
             select 'property_rollup', 1, count(distinct partition_1)::bigint,
                    sum(sent + received)::bigint from j""",
    ),
)
def e1(spark, folder):
    """Sizes and totals of all tables of a build that shares one pass over the edges."""
    c = Commerce(spark, folder)
    given = _structure_model(c)
    base = Model(
        devices=given.devices,
        edges=c.edges(),
        device_partitions=given.device_partitions,
        device_states=given.device_states,
        device_properties=given.device_properties.select("id", "nationkey"),
        events=c.pair_events(),
    )
    built = build.build_model(base, max_epoch=10_000)

    def sizes(name, total):
        df = getattr(built, name)
        return df.groupBy("level").agg(
            F.count(F.lit(1)).alias("items"), total.cast("bigint").alias("total")
        ).select(F.lit(name).alias("item"), "level", "items", "total")

    n = F.coalesce(F.sum("count"), F.lit(0))
    sent = F.sum(F.col("messages_sent") + F.col("messages_received"))
    return (
        sizes("partition_edges", n)
        .unionByName(sizes("border_edges", n))
        .unionByName(sizes("state_rollup", F.lit(0)))
        .unionByName(sizes("property_rollup", sent))
    )
