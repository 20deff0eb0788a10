"""Scalar functions P1-P23 over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from portmesh.functions import scalars as sc
from portmesh.functions import style, typed
from portmesh.functions.typed import Field
from portmesh.operators.encoding import decode_ids, dictionary_encode
from portmesh.registry import query, with_views
from portmesh.sources.commerce import Commerce
from portmesh.tables import TYPE_FIELDS, storage_class

SUPPLIER = (Field("acctbal", type="double"), Field("nationkey", type="uint8_t"))


def _props(devices):
    text = F.concat(F.lit('"acctbal":'), "acctbal", F.lit(',"nationkey":'), "nationkey")
    return devices.withColumn("props", text)


@query("p1_decode", with_views("g_devices", "select id, acctbal, nationkey from g_devices"))
def p1(spark, folder):
    devices = _props(Commerce(spark, folder).devices()).select("id", "props")
    return devices.withColumn("v", typed.decode("props", SUPPLIER)).select("id", "v.*")


@query(
    "p2_expand_defaults",
    with_views(
        "g_devices",
        """select id, case when type = 'supplier' then acctbal else 1.5 end::double as acctbal,
                  nationkey, 0 as pad, '7,7,7' as slots from g_devices""",
    ),
)
def p2(spark, folder):
    """Customers omit the balance; all omit ``pad`` and the array ``slots``."""
    devices = Commerce(spark, folder).devices()
    given = F.when(F.col("type") == "supplier", F.concat(F.lit('"acctbal":'), "acctbal", F.lit(",")))
    text = F.concat(F.coalesce(given, F.lit("")), F.lit('"nationkey":'), "nationkey")
    spec = (
        Field("acctbal", type="double", default="1.5"),
        Field("nationkey", type="int32_t"),
        Field("pad", type="int8_t"),
        Field("slots", "array", "int16_t", length=3, default="7"),
    )
    decoded = devices.select("id", typed.decode(text, spec).alias("v"))
    full = typed.expand_defaults(decoded, "v", spec)
    return full.select(
        "id",
        "v.acctbal",
        "v.nationkey",
        F.col("v.pad").cast("int").alias("pad"),
        F.array_join("v.slots", ",").alias("slots"),
    )


@query(
    "p3_is_refinement",
    with_views(
        "g_devices",
        """select id, trunc(acctbal) between 0 and 4294967295 as fits_unsigned,
                  nationkey between -8 and 7 or nationkey <= 127 as fits_byte
           from g_devices""",
    ),
)
def p3(spark, folder):
    devices = _props(Commerce(spark, folder).devices())
    unsigned = (Field("acctbal", type="uint32_t"), Field("nationkey", type="int32_t"))
    byte = (Field("acctbal", type="float"), Field("nationkey", type="int8_t"))
    return devices.select(
        "id",
        typed.is_refinement("props", unsigned).alias("fits_unsigned"),
        typed.is_refinement("props", byte).alias("fits_byte"),
    )


@query(
    "p4_split_path",
    with_views(
        "g_edges",
        """select target || ':' || target_port || '-' || source || ':' || source_port as id,
                  target, target_port, source, source_port from g_edges""",
    ),
)
def p4(spark, folder):
    ids = Commerce(spark, folder).edges_with_id().select("id")
    return ids.withColumn("e", sc.split_path("id")).select("id", "e.*")


@query(
    "p5_parse_int",
    "select o_orderkey as value, o_orderkey as from_hex, o_orderkey as from_text, "
    "o_orderkey * 16 as firings from orders",
)
def p5(spark, folder):
    key = F.col("o_orderkey")
    texts = Commerce(spark, folder).table("orders").select(
        key.alias("value"),
        F.concat(F.lit("0x"), sc.to_hex(key)).alias("h"),
        key.cast("string").alias("t"),
        F.concat(sc.to_hex(key), F.lit("0")).alias("f"),
    )
    return texts.select(
        "value",
        sc.parse_int("h").alias("from_hex"),
        sc.parse_int("t").alias("from_text"),
        sc.parse_int("f", 16).alias("firings"),
    )


@query(
    "p6_ready_ports",
    with_views(
        "g_devices g_ports",
        """select id, name as port from g_devices d join g_ports p
             on p.device_type = d.type and direction = 'output'
           where ((nationkey % 4) >> idx) & 1 = 1""",
    ),
)
def p6(spark, folder):
    c = Commerce(spark, folder)
    states = c.devices().select("id", "type", (F.col("nationkey") % 4).alias("rts"))
    return sc.ready_ports(states, c.ports()).select("id", "port")


@query(
    "p7_p8_parent_and_level",
    with_views(
        "g_parts",
        """select partition_1 as id, partition_0 as parent, 'base' as grandparent,
                  2::bigint as level, count(*)::bigint as devices from g_parts group by all""",
    ),
)
def p7(spark, folder):
    parts = Commerce(spark, folder).device_partitions()
    parent = sc.parent_id("partition_1")
    return parts.groupBy(
        F.col("partition_1").alias("id"),
        parent.alias("parent"),
        sc.parent_id(parent).alias("grandparent"),
        sc.level_of("partition_1").cast("bigint").alias("level"),
    ).agg(F.count(F.lit(1)).alias("devices"))


@query(
    "p9_init_flag",
    with_views(
        "u_log",
        """select id, floor(time)::bigint as epoch,
                  case when floor(time) = 0 and seq = 0 then 1 else 0 end as init from u_log""",
    ),
)
def p9(spark, folder):
    log = Commerce(spark, folder).log()
    epoch = F.floor("time").cast("bigint")
    return log.select("id", epoch.alias("epoch"), sc.is_init(epoch, "seq").alias("init"))


@query(
    "p10_p11_sampled_epochs",
    with_views(
        "u_states",
        "select * from u_states where epoch % 10 = 0 and epoch <= 20",
    ),
)
def p10(spark, folder):
    states = Commerce(spark, folder).user_states()
    return states.filter(sc.sampled("epoch", 1) & sc.within_limit("epoch", 20))


@query(
    "p12_storage_class",
    """select o_orderpriority as id, o_orderstatus as name,
              case o_orderstatus when 'F' then 'REAL' when 'O' then 'INTEGER' else 'BLOB' end
                as storage, count(*)::bigint as n
       from orders group by all""",
)
def p12(spark, folder):
    declared = {"F": "float", "O": "uint32_t", "P": "double"}
    kind = F.create_map(
        *[x for status, t in declared.items() for x in (F.lit(status), F.lit(storage_class(t)))]
    )
    orders = Commerce(spark, folder).table("orders")
    return orders.groupBy(
        F.col("o_orderpriority").alias("id"),
        F.col("o_orderstatus").alias("name"),
        kind[F.col("o_orderstatus")].alias("storage"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p13_array_text",
    """select vec_id, len(embedding)::int as n, embedding[1]::double as first from embeddings""",
)
def p13(spark, folder):
    """Arrays stay arrays; as text they are JSON and read back to the same values."""
    vectors = Commerce(spark, folder).table("embeddings").select(
        "vec_id", F.to_json("embedding").alias("text")
    )
    back = vectors.select("vec_id", F.from_json("text", "array<float>").alias("v"))
    return back.select("vec_id", F.size("v").alias("n"), F.get("v", 0).cast("double").alias("first"))


@query(
    "p14_widen",
    """select 's_' || s_suppkey as id, 'supplier' as type, s_acctbal as acctbal,
              null::varchar as segment, s_nationkey as nationkey from supplier
       union all
       select 'c_' || c_custkey, 'customer', null::double, c_mktsegment, c_nationkey from customer""",
)
def p14(spark, folder):
    c = Commerce(spark, folder)
    suppliers = c.table("supplier").select(
        F.concat(F.lit("s_"), "s_suppkey").alias("id"),
        F.lit("supplier").alias("type"),
        typed.encode(
            F.struct(F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nationkey"))
        ).alias("props"),
    )
    customers = c.table("customer").select(
        F.concat(F.lit("c_"), "c_custkey").alias("id"),
        F.lit("customer").alias("type"),
        typed.encode(
            F.struct(
                F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nationkey")
            )
        ).alias("props"),
    )
    customer = (Field("segment", type="string"), Field("nationkey", type="int32_t"))
    supplier = (Field("acctbal", type="double"), Field("nationkey", type="int32_t"))
    return typed.widen(suppliers.unionByName(customers), typed.merged_spec([supplier, customer]))


@query(
    "p15_field_lists",
    """with f as (select distinct p_brand as owner, p_size as size from part)
       select owner as id,
              coalesce(string_agg(case when size % 2 = 0 then n end, ',' order by n), '') as states,
              coalesce(string_agg(case when size % 2 = 1 then n end, ',' order by n), '')
                as properties
       from (select *, case when size % 5 = 0 then '[f' || size || ']' else 'f' || size end as n
             from f) group by 1""",
)
def p15(spark, folder):
    """Part sizes per brand read as declared fields; every fifth is an array."""
    part = Commerce(spark, folder).table("part")
    pairs = part.select("p_brand", "p_size").distinct()
    name = F.concat(F.lit("f"), "p_size")
    values = {
        "owner_kind": F.lit("device"),
        "owner": F.col("p_brand"),
        "section": F.when(F.col("p_size") % 2 == 0, "state").otherwise("properties"),
        "name": name,
        "path": name,
        "kind": F.when(F.col("p_size") % 5 == 0, "array").otherwise("scalar"),
    }
    fields = pairs.select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TYPE_FIELDS]
    )
    return typed.field_lists(fields)


HEX2 = "lpad(lower(to_hex({})), 2, '0')"


def _clip(x: str) -> str:
    return HEX2.format(f"greatest(0, least(255, floor({x})))::bigint")


@query(
    "p16_colour_scales",
    f"""with v as (select c_custkey, c_acctbal, greatest(0.0, least(1.0, c_acctbal / 8000.0)) as s,
                          greatest(0.0, least(1.0, c_acctbal / 4000.0)) as cold,
                          greatest(0.0, least(1.0, (c_acctbal - 4000.0) / 4000.0)) as hot
                   from customer)
        select c_custkey as id,
               '#' || {_clip("0.0 + s * 255")} || {_clip("122.0 + s * -122")}
                   || {_clip("255.0 + s * -255")} as blend,
               case when c_acctbal < 4000
                    then '#' || {_clip("0.0 + cold * 255")} || {_clip("0.0 + cold * 255")} || 'ff'
                    else '#ff' || {_clip("255.0 + hot * -255")} || {_clip("255.0 + hot * -255")}
                    end as heat
        from v""",
)
def p16(spark, folder):
    customer = Commerce(spark, folder).table("customer")
    v = F.col("c_acctbal")
    return customer.select(
        F.col("c_custkey").alias("id"),
        style.blend_colour(v, (0, 122, 255), (255, 0, 0), 0, 8000).alias("blend"),
        style.heat_colour(v, 0, 8000).alias("heat"),
    )


@query(
    "p17_bind",
    with_views(
        "g_devices",
        """select id, case when type = 'customer' then round(acctbal / 100, 6) end as width,
                  'n' || nationkey as label from g_devices""",
    ),
)
def p17(spark, folder):
    devices = Commerce(spark, folder).devices().withColumnsRenamed(
        {"acctbal": "state_acctbal", "nationkey": "property_nationkey"}
    )
    one = style.bind(
        devices, "customer", "state", "acctbal", "width", "round(value / 100, 6)"
    )
    two = style.bind(one, "*", "property", "nationkey", "label", "concat('n', value)")
    return two.select("id", "width", "label")


@query(
    "p18_style_by_type",
    """select c_mktsegment as type,
              case row_number() over (order by c_mktsegment)
                when 1 then 'oval' when 2 then 'box' when 3 then 'diamond'
                when 4 then 'pentagon' when 5 then 'hexagon' end as style
       from (select distinct c_mktsegment from customer)""",
)
def p18(spark, folder):
    customers = Commerce(spark, folder).table("customer")
    types = customers.select(F.col("c_mktsegment").alias("type"))
    return style.style_by_type(types, "type", style.SHAPES)


@query(
    "p19_labels",
    with_views(
        "g_edges",
        """select source, target, case when (select count(*) from g_edges) < 50 then target_port end
                  as label from g_edges""",
    ),
)
def p19(spark, folder):
    edges = Commerce(spark, folder).edges()
    label = F.when(style.show_labels(edges), F.col("target_port"))
    return edges.select("source", "target", label.alias("label"))


@query(
    "p20_fingerprint",
    """select l_returnflag, l_linestatus, count(*)::bigint as n, 1::bigint as fingerprints
       from lineitem group by 1, 2""",
)
def p20(spark, folder):
    line = Commerce(spark, folder).table("lineitem")
    marked = sc.fingerprint(line, ["l_returnflag", "l_linestatus"])
    return marked.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("fingerprint").alias("fingerprints")
    )


@query(
    "p21_dictionary_encode",
    """with d as (select p_brand, p_size, row_number() over (order by p_brand, p_size) - 1 as i
                  from (select distinct p_brand, p_size from part))
       select p_partkey, i::bigint as value_id, p.p_brand, p.p_size
       from part p join d on p.p_brand = d.p_brand and p.p_size = d.p_size""",
)
def p21(spark, folder):
    part = Commerce(spark, folder).table("part").select("p_partkey", "p_brand", "p_size")
    encoded, dictionary = dictionary_encode(part, ["p_brand", "p_size"], "value_id")
    return decode_ids(encoded, dictionary, "value_id")


@query(
    "p22_format_value",
    """select o_orderkey as id,
              '{total:' || printf('%.3f', o_totalprice) || ',status:' || o_orderstatus
              || ',keys:[' || o_orderkey || ',' || o_custkey || ']}' as text
       from orders""",
)
def p22(spark, folder):
    spec = (
        Field("total", type="double"),
        Field("status", type="string"),
        Field("keys", "array", "int", length=2),
    )
    orders = Commerce(spark, folder).table("orders")
    value = F.struct(
        F.col("o_totalprice").alias("total"),
        F.col("o_orderstatus").alias("status"),
        F.array("o_orderkey", "o_custkey").alias("keys"),
    )
    rows = orders.select(F.col("o_orderkey").alias("id"), value.alias("v"))
    return rows.select("id", typed.format_struct(F.col("v"), spec).alias("text"))


@query(
    "p23_cancelled",
    "select o_orderkey as id, o_orderstatus = 'P' as cancel from orders",
)
def p23(spark, folder):
    orders = Commerce(spark, folder).table("orders")
    flag = F.when(F.col("o_orderstatus") == "P", "1").otherwise("0")
    return orders.select(F.col("o_orderkey").alias("id"), sc.cancelled(flag).alias("cancel"))


@query(
    "w5_node_numbers",
    with_views(
        "g_parts",
        """select partition_0 as parent, id,
                  row_number() over (partition by partition_0 order by id)::bigint as node
           from g_parts""",
    ),
)
def w5(spark, folder):
    from portmesh.sinks.text import number_nodes

    parts = Commerce(spark, folder).device_partitions()
    return number_nodes(parts.select(F.col("partition_0").alias("parent"), "id")).select(
        "parent", "id", "node"
    )
