"""Devices, edges and ports: joins J1-J3, J7, J10-J12 and structural aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from portmesh.functions.scalars import edge_id
from portmesh.operators import relations as rel
from portmesh.operators import rollups as roll
from portmesh.registry import query, with_views
from portmesh.sources.commerce import Commerce

EDGE_ID = "target || ':' || target_port || '-' || source || ':' || source_port"


@query(
    "j1_device_type",
    with_views(
        "g_devices g_ports",
        """select id, type, acctbal, outputs, inputs from g_devices join (
             select device_type,
                    count(*) filter (direction = 'output')::bigint as outputs,
                    count(*) filter (direction = 'input')::bigint as inputs
             from g_ports group by 1) on type = device_type""",
    ),
)
def j1(spark, folder):
    c = Commerce(spark, folder)
    types = (
        c.ports()
        .groupBy(F.col("device_type").alias("id"))
        .agg(
            F.count_if(F.col("direction") == "output").alias("outputs"),
            F.count_if(F.col("direction") == "input").alias("inputs"),
        )
    )
    return rel.devices_with_types(c.devices(), types).select(
        "id", "type", "acctbal", "outputs", "inputs"
    )


@query(
    "j2_resolve_edges",
    with_views(
        "g_devices g_edges g_ports",
        f"""select {EDGE_ID} as id, s.type as source_type, t.type as target_type,
                   op.message_type as message_type, ip.message_type as target_message_type
            from g_edges left join g_devices s on source = s.id
                 left join g_devices t on target = t.id
                 left join g_ports op on op.device_type = s.type and op.name = source_port
                      and op.direction = 'output'
                 left join g_ports ip on ip.device_type = t.type and ip.name = target_port
                      and ip.direction = 'input'""",
    ),
)
def j2(spark, folder):
    c = Commerce(spark, folder)
    return rel.resolve_edges(c.edges(), c.devices(), c.ports()).select(
        edge_id().alias("id"), "source_type", "target_type", "message_type", "target_message_type"
    )


@query(
    "j3_edges_with_partitions",
    with_views(
        "g_parts g_edges",
        """select source, target, s.partition_1 as source_partition_1,
                  t.partition_1 as target_partition_1
           from g_edges join g_parts s on source = s.id join g_parts t on target = t.id""",
    ),
)
def j3(spark, folder):
    c = Commerce(spark, folder)
    placed = rel.edges_with_partitions(c.edges(), c.device_partitions(), ["partition_1"])
    return placed.select("source", "target", "source_partition_1", "target_partition_1")


@query(
    "j4_states_of_partition",
    with_views(
        "u_parts u_states",
        """select s.id, epoch, init, value, k, n as property_events
           from u_states s join u_parts p on s.id = p.id and partition_0 = 'base_3'
           join (select 'u_' || user_id as id, count(*)::bigint as n from events group by 1) q
             on q.id = s.id""",
    ),
)
def j4(spark, folder):
    c = Commerce(spark, folder)
    properties = c.log().groupBy(F.col("dev").alias("id")).agg(
        F.count(F.lit(1)).alias("property_events")
    )
    return rel.states_of_partition(
        c.user_states(), properties, c.user_partitions(), "base_3", "partition_0"
    )


@query(
    "j5_events_of_partition",
    with_views(
        "u_log u_parts",
        """select id, dev, type, time from u_log
           where dev in (select id from u_parts where partition_1 = 'base_2_7')
             and time between 100 and 400""",
    ),
)
def j5(spark, folder):
    c = Commerce(spark, folder)
    return rel.events_of_partition(
        c.log(), c.user_partitions(), "base_2_7", "partition_1", 100, 400
    ).select("id", "dev", "type", "time")


@query(
    "j7_neighbours",
    with_views(
        "g_devices g_edges",
        f""", ids as (select id from g_devices where acctbal > 9000),
           ends as (select source as id, target as neighbour, {EDGE_ID} as edge from g_edges
                    union all
                    select target, source, {EDGE_ID} from g_edges where source <> target)
           select id, neighbour, edge from ends where id in (select id from ids)""",
    ),
)
def j7(spark, folder):
    c = Commerce(spark, folder)
    ids = c.devices().filter(F.col("acctbal") > 9000)
    return rel.neighbours(c.edges(), ids)


@query(
    "j10_semi_anti",
    with_views(
        "g_devices g_edges",
        """select id, (id in (select source from g_edges union select target from g_edges)) as used
           from g_devices""",
    ),
)
def j10(spark, folder):
    c = Commerce(spark, folder)
    ends = c.edges().select(F.explode(F.array("source", "target")).alias("id"))
    devices = c.devices().select("id")
    return (
        devices.join(ends, "id", "left_semi")
        .withColumn("used", F.lit(True))
        .unionByName(devices.join(ends, "id", "left_anti").withColumn("used", F.lit(False)))
    )


@query(
    "j11_crossing_edges",
    with_views(
        "g_parts g_edges",
        """select source, target, source_port, target_port
           from g_edges join g_parts s on source = s.id join g_parts t on target = t.id
           where s.partition_1 <> t.partition_1 and s.partition_0 = t.partition_0
             and source <> target""",
    ),
)
def j11(spark, folder):
    c = Commerce(spark, folder)
    placed = rel.edges_with_partitions(
        c.edges(), c.device_partitions(), ["partition_0", "partition_1"]
    )
    return placed.filter(
        (F.col("source_partition_1") != F.col("target_partition_1"))
        & (F.col("source_partition_0") == F.col("target_partition_0"))
        & (F.col("source") != F.col("target"))
    ).select("source", "target", "source_port", "target_port")


@query(
    "j12_compatible_ports",
    with_views(
        "g_ports",
        """select o.device_type as source_type, o.name as source_port,
                  i.device_type as target_type, i.name as target_port, o.message_type
           from g_ports o join g_ports i on o.message_type = i.message_type
           where o.direction = 'output' and i.direction = 'input'""",
    ),
)
def j12(spark, folder):
    return rel.compatible_ports(Commerce(spark, folder).ports())


@query(
    "a10_ports",
    with_views("g_ports", "select distinct name from g_ports"),
)
def a10_ports(spark, folder):
    return roll.distinct_ports(Commerce(spark, folder).ports())


@query(
    "a10_message_types",
    with_views("g_ports", "select distinct message_type from g_ports"),
)
def a10_types(spark, folder):
    return roll.distinct_message_types(Commerce(spark, folder).ports())


@query(
    "a11_graph_summary",
    with_views(
        "g_devices g_edges g_ports",
        """select 'message_types' as item, count(distinct message_type)::bigint as n from g_ports
           union all select 'device_types', count(distinct device_type)::bigint from g_ports
           union all select 'devices', count(*)::bigint from g_devices
           union all select 'edges', count(*)::bigint from g_edges""",
    ),
)
def a11(spark, folder):
    c = Commerce(spark, folder)
    ports = c.ports()
    return roll.graph_summary(
        ports.select("message_type").distinct(),
        ports.select("device_type").distinct(),
        c.devices(),
        c.edges(),
    )


@query(
    "a12_undirected_weights",
    with_views(
        "g_edges",
        """select least(source, target) as a, greatest(source, target) as b,
                  count(*)::bigint as weight from g_edges group by 1, 2""",
    ),
)
def a12(spark, folder):
    return roll.undirected_weights(Commerce(spark, folder).edges())


@query(
    "a13_degrees",
    with_views(
        "g_devices g_edges g_ports",
        """, used as (select source as id, source_port as port, 'output' as direction, count(*) as n
                     from g_edges group by 1, 2
                     union all
                     select target, target_port, 'input', count(*) from g_edges group by 1, 2)
           select d.id, p.name as port, p.direction, coalesce(n, 0)::bigint as degree
           from g_devices d join g_ports p on p.device_type = d.type
           left join used u on u.id = d.id and u.port = p.name and u.direction = p.direction""",
    ),
)
def a13(spark, folder):
    c = Commerce(spark, folder)
    return roll.degrees(c.edges(), c.devices(), c.ports())


@query(
    "a14_adjacency",
    with_views(
        "g_edges",
        """, pairs as (select source, source_port, target, target_port, count(*) as n
                      from g_edges group by all)
           select source, source_port, 0::bigint as block,
                  string_agg(target || ':' || target_port || '*' || n, ' '
                             order by target, target_port) as targets
           from pairs group by 1, 2""",
    ),
)
def a14(spark, folder):
    lists = roll.adjacency(Commerce(spark, folder).edges())
    text = F.transform(
        "targets",
        lambda t: F.concat(t["target"], F.lit(":"), t["target_port"], F.lit("*"), t["edges"]),
    )
    return lists.withColumn("targets", F.array_join(text, " "))


@query(
    "a19_partition_sizes",
    with_views(
        "g_parts",
        "select partition_1 as partition_id, count(*)::bigint as devices from g_parts group by 1",
    ),
)
def a19(spark, folder):
    return roll.partition_sizes(Commerce(spark, folder).device_partitions(), "partition_1")
