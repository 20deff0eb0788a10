"""Named queries over the driver tables, each with the equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

MODULES = (
    "structure",
    "rollup_queries",
    "log_queries",
    "check_queries",
    "scalar_queries",
    "io_queries",
    "generator_queries",
    "graph_queries",
    "view_queries",
    "stream_queries",
)


def query(name: str, sql: str | None = None):
    """Register ``f(spark, folder)`` under ``name`` with its SQL twin."""

    def register(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def load() -> None:
    for module in MODULES:
        import_module(f"{__name__}.{module}")


# SQL text of the tables that ``portmesh.sources.commerce`` derives with DataFrames.
VIEWS = {
    "g_devices": """
        select 's_' || s_suppkey as id, 'supplier' as type, s_acctbal as acctbal,
               s_nationkey as nationkey from supplier
        union all
        select 'c_' || c_custkey, 'customer', c_acctbal, c_nationkey from customer""",
    "g_parts": """
        select id, 'base_' || n_regionkey as partition_0,
               'base_' || n_regionkey || '_' || n_nationkey as partition_1
        from g_devices join nation on n_nationkey = nationkey""",
    "g_edges": """
        select 's_' || l_suppkey as source, 'c_' || o_custkey as target,
               'out_' || l_linestatus as source_port, 'in_' || l_returnflag as target_port
        from lineitem join orders on l_orderkey = o_orderkey""",
    "g_ports": """
        select distinct 'supplier' as device_type, 'out_' || l_linestatus as name,
               'output' as direction, case when l_linestatus = 'F' then 0 else 1 end as idx,
               'ship' as message_type from lineitem
        union all
        select distinct 'customer', 'in_' || l_returnflag, 'input',
               case l_returnflag when 'A' then 0 when 'R' then 2 else 1 end,
               case l_returnflag when 'R' then 'return' else 'ship' end from lineitem""",
    "pair_events": """
        select 'o' || o_orderkey as id, 'c_' || o_custkey as dev, 'send' as type,
               datediff('day', date '1995-01-01', o_orderdate::date)::double as time,
               null::varchar as send_id, o_totalprice as value from orders
        union all
        select 'l' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey,
               's_' || l_suppkey, 'recv',
               datediff('day', date '1995-01-01', l_shipdate::date)::double,
               'o' || l_orderkey, l_extendedprice from lineitem""",
    "u_log": """
        select event_id::varchar as id, 'u_' || user_id as dev,
               case event_type when 'signup' then 'init' when 'click' then 'send'
                    when 'purchase' then 'send' else 'recv' end as type,
               (epoch_us(ts) - 1704067200000000)::double / 3600000000 as time,
               event_id as seq, event_type as port, value,
               json_extract(props, '$.k')::double as k
        from events""",
    "u_parts": """
        select distinct 'u_' || user_id as id, 'base_' || (user_id % 5) as partition_0,
               'base_' || (user_id % 5) || '_' || (user_id % 25) as partition_1
        from events""",
    "u_states": """
        select dev as id, floor(time / 24)::bigint as epoch, 0 as init,
               arg_max(value, seq) as value, arg_max(k, seq) as k
        from u_log group by 1, 2""",
}
NEEDS = {"g_parts": ["g_devices"], "u_states": ["u_log"]}


def with_views(names: str, body: str) -> str:
    """``body`` with the named views (space separated, more CTEs may follow) put in front."""
    ordered: list[str] = []
    for name in names.split():
        for needed in [*NEEDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    views = ", ".join(f"{name} as ({VIEWS[name]})" for name in ordered)
    joint = " " if body.lstrip().startswith(",") else "\n"
    return f"with {views}{joint}{body}"


def settled(sql: str) -> str:
    """``sql`` with its result worked out before anything around it: DuckDB otherwise turns some joins
    under a LIMIT into loops that don't end in reasonable time."""
    return f"with result as materialized ({sql}) select * from result"
