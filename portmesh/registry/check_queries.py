"""Data-quality rules V1-V12 on tables that break them."""

from __future__ import annotations

from pyspark.sql import functions as F

from portmesh.functions.scalars import edge_id
from portmesh.functions.typed import Field
from portmesh.operators import checks
from portmesh.operators.relations import resolve_edges
from portmesh.registry import query, with_views
from portmesh.sources.commerce import Commerce

EDGE_ID = "target || ':' || target_port || '-' || source || ':' || source_port"


@query(
    "v1_duplicate_ids",
    with_views(
        "g_devices g_edges",
        f""", ids as (select id, 'device id' as what from g_devices
                     union all select {EDGE_ID}, 'edge id' from g_edges)
           select 'V1' as rule, id as key, what || ' occurs ' || count(*) || ' times' as detail
           from ids group by id, what having count(*) > 1""",
    ),
)
def v1(spark, folder):
    c = Commerce(spark, folder)
    return checks.duplicate_ids(c.devices(), c.edges())


@query(
    "v2_duplicate_names",
    """with t as (select p_brand || '.' || p_type as key, 'port' as what from part
                 union all select 'size_' || p_size, 'message type' from part
                 union all select p_brand, 'device type' from part)
       select 'V2' as rule, key, what || ' occurs ' || count(*) || ' times' as detail
       from t group by key, what having count(*) > 1""",
)
def v2(spark, folder):
    """Parts read as a type catalogue: brand = device type, type = port, size = message type."""
    part = Commerce(spark, folder).table("part")
    ports = part.select(F.col("p_brand").alias("device_type"), F.col("p_type").alias("name"))
    sizes = part.select(F.concat(F.lit("size_"), "p_size").alias("id"))
    return checks.duplicate_names(ports, sizes, part.select(F.col("p_brand").alias("id")))


@query(
    "v3_unknown_types",
    """select 'V3' as rule, 'c_' || c_custkey as key,
              'unknown device type ' || c_mktsegment as detail
       from customer where c_mktsegment not in (
         select c_mktsegment from customer group by 1 order by count(*) desc, 1 limit 3)
       union all
       select 'V3', p_brand || '.' || p_partkey, 'unknown message type ' || p_type
       from part where p_type not in (select p_type from part where p_size > 25)""",
)
def v3(spark, folder):
    """The three largest segments are the known device types, the types of large parts the known
    message types."""
    c = Commerce(spark, folder)
    customer, part = c.table("customer"), c.table("part")
    devices = customer.select(
        F.concat(F.lit("c_"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("type")
    )
    known = (
        customer.groupBy(F.col("c_mktsegment").alias("id"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "id")
        .limit(3)
    )
    ports = part.select(
        F.col("p_brand").alias("device_type"),
        F.col("p_partkey").cast("string").alias("name"),
        F.col("p_type").alias("message_type"),
    )
    registered = part.filter(F.col("p_size") > 25).select(F.col("p_type").alias("id")).distinct()
    return checks.unknown_types(devices, known, ports, registered)


@query(
    "v4_dangling_edges",
    with_views(
        "g_devices g_edges",
        f""", open as (select id from g_devices where acctbal >= 0)
           select 'V4' as rule, {EDGE_ID} as key, 'source does not exist: ' || source as detail
           from g_edges where source not in (select id from open)
           union all
           select 'V4', {EDGE_ID}, 'target does not exist: ' || target
           from g_edges where target not in (select id from open)""",
    ),
)
def v4(spark, folder):
    """Devices with a negative balance are taken out of the graph, their edges stay."""
    c = Commerce(spark, folder)
    return checks.dangling_edges(c.edges(), c.devices().filter(F.col("acctbal") >= 0))


@query(
    "v5_missing_ports",
    with_views(
        "g_devices g_edges g_ports",
        f""", known as (select * from g_ports where name not in ('in_N', 'out_F'))
           select 'V5' as rule, {EDGE_ID} as key, d.type || ' has no output port ' || source_port
                  as detail
           from g_edges e join g_devices d on e.source = d.id
           where not exists (select 1 from known k where k.device_type = d.type
                             and k.name = e.source_port and k.direction = 'output')
           union all
           select 'V5', {EDGE_ID}, d.type || ' has no input port ' || target_port
           from g_edges e join g_devices d on e.target = d.id
           where not exists (select 1 from known k where k.device_type = d.type
                             and k.name = e.target_port and k.direction = 'input')""",
    ),
)
def v5(spark, folder):
    c = Commerce(spark, folder)
    known = c.ports().filter(~F.col("name").isin("in_N", "out_F"))
    return checks.missing_ports(c.edges(), c.devices(), known)


@query(
    "v6_mismatched_ports",
    with_views(
        "g_devices g_edges g_ports",
        f"""select 'V6' as rule, {EDGE_ID} as key,
                   op.message_type || ' sent to ' || ip.message_type as detail
            from g_edges join g_devices s on source = s.id join g_devices t on target = t.id
                 join g_ports op on op.device_type = s.type and op.name = source_port
                      and op.direction = 'output'
                 join g_ports ip on ip.device_type = t.type and ip.name = target_port
                      and ip.direction = 'input'
            where op.message_type <> ip.message_type""",
    ),
)
def v6(spark, folder):
    c = Commerce(spark, folder)
    return checks.mismatched_ports(resolve_edges(c.edges(), c.devices(), c.ports()))


@query(
    "v7_bad_properties",
    with_views(
        "g_devices",
        """select 'V7' as rule, id as key, 'device properties do not fit their type' as detail
           from g_devices
           where (type = 'supplier' and trunc(acctbal) < 0)
              or (type = 'customer' and nationkey > 20)""",
    ),
)
def v7(spark, folder):
    """Supplier balances must be unsigned; customers of high nation keys carry an unknown member."""
    devices = Commerce(spark, folder).devices()
    extra = F.when(
        (F.col("type") == "customer") & (F.col("nationkey") > 20), F.lit(',"surprise":[1,2]')
    ).otherwise("")
    props = F.concat(
        F.lit('"acctbal":'), "acctbal", F.lit(',"nationkey":'), "nationkey", extra
    )
    specs = {
        "supplier": (Field("acctbal", type="uint32_t"), Field("nationkey", type="uint8_t")),
        "customer": (Field("acctbal", type="float"), Field("nationkey", type="uint8_t")),
    }
    return checks.bad_properties(devices.withColumn("props", props), "device", "id", "type", specs)


@query(
    "v8_bad_patterns",
    """select 'V8' as rule, p_name as key, 'malformed identifier' as detail from part
       where not regexp_full_match(p_name, '[a-zA-Z0-9_]+')
       union all
       select 'V8', path, 'malformed path' from (
         select n_name || ':in-' || r_name || ':out' as path from customer
         join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
       where not regexp_full_match(path,
         '[a-zA-Z0-9_]+:[a-zA-Z0-9_]+-[a-zA-Z0-9_]+:[a-zA-Z0-9_]+')""",
)
def v8(spark, folder):
    c = Commerce(spark, folder)
    places = (
        c.table("customer")
        .join(c.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(c.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    paths = places.select(F.concat("n_name", F.lit(":in-"), "r_name", F.lit(":out")).alias("path"))
    return checks.bad_patterns(c.table("part").select(F.col("p_name").alias("id")), paths)


@query(
    "v9_log_order",
    with_views(
        "pair_events",
        """, o as (select dev, regexp_extract(id, '[0-9]+')::bigint as seq, time from pair_events),
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
def v9(spark, folder):
    """Orders and lines in key order, whose dates do not follow the keys."""
    events = Commerce(spark, folder).pair_events()
    seq = F.regexp_extract("id", "[0-9]+", 0).cast("bigint")
    return checks.log_order(events.select("dev", seq.alias("seq"), "time"))


def _sends_with_fanout(c: Commerce):
    lines = c.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.countDistinct("l_suppkey").cast("int").alias("fanout")
    )
    orders = c.table("orders").join(lines, "o_orderkey", "left")
    return orders.select(
        F.concat(F.lit("o"), "o_orderkey").alias("id"),
        F.lit("send").alias("type"),
        F.lit(None).cast("string").alias("send_id"),
        (F.col("o_orderstatus") == "P").alias("cancel"),
        F.coalesce("fanout", F.lit(0)).alias("fanout"),
        "o_orderstatus",
    )


def _with_fanout(c: Commerce):
    recvs = c.pair_events().filter(F.col("type") == "recv").select("id", "type", "send_id")
    return _sends_with_fanout(c).unionByName(recvs, allowMissingColumns=True)


FANOUT = """, f as (select l_orderkey, count(distinct l_suppkey)::int as fanout from lineitem
                    group by 1),
              s as (select 'o' || o_orderkey as id, o_orderstatus as status,
                           coalesce(fanout, 0) as fanout
                    from orders left join f on l_orderkey = o_orderkey)"""


@query(
    "v10_broken_messages",
    with_views(
        "pair_events",
        FANOUT
        + """select 'V10' as rule, id as key, 'no send ' || send_id as detail from pair_events
             where type = 'recv' and send_id not in (select id from s where status <> 'O')
             union all
             select 'V10', id, 'event id occurs ' || count(*) || ' times' from (
               select id from s where status <> 'O'
               union all select id from pair_events where type = 'recv')
             group by id having count(*) > 1
             union all
             select 'V10', id, 'cancelled with fan-out ' || fanout from s
             where status = 'P' and fanout <> 0""",
    ),
)
def v10(spark, folder):
    """Open orders were never logged, pending orders count as cancelled."""
    events = _with_fanout(Commerce(spark, folder))
    logged = events.filter(F.col("o_orderstatus").isNull() | (F.col("o_orderstatus") != "O"))
    return checks.broken_messages(logged)


@query(
    "v11_stateless_firings",
    with_views(
        "g_edges",
        f"""select 'V11' as rule, id || '@' || 0 as key, 'firings or queue without state' as detail
            from (select {EDGE_ID} as id, target_port, count(*) as firings from g_edges group by 1, 2)
            where target_port = 'in_N'""",
    ),
)
def v11(spark, folder):
    fired = Commerce(spark, folder).edges().groupBy(edge_id().alias("id"), "target_port").agg(
        F.count(F.lit(1)).alias("firings")
    )
    states = fired.withColumns(
        {
            "state": F.when(F.col("target_port") != "in_N", '"n":1'),
            "queued": F.lit(0),
            "epoch": F.lit(0),
        }
    )
    return checks.stateless_firings(states)


@query(
    "v12_fanout_mismatch",
    with_views(
        "pair_events",
        FANOUT
        + """select 'V12' as rule, s.id as key,
                    'fan-out ' || fanout || ', receives ' || coalesce(n, 0) as detail
             from s left join (select send_id, count(*) as n from pair_events
                               where type = 'recv' group by 1) r on r.send_id = s.id
             where fanout <> coalesce(n, 0)""",
    ),
)
def v12(spark, folder):
    return checks.fanout_mismatch(_with_fanout(Commerce(spark, folder)))
