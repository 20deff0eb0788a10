"""The order/line/click tables read as a message graph, its log and its snapshots.

Suppliers and customers are devices, order lines are edges from supplier to customer, regions and
nations are the two partition levels. Orders and lines also form a log of sends and receives, and
the click table forms per-user timelines and daily state snapshots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portmesh.functions.scalars import edge_id

DAY_ZERO = "1995-01-01"
CLICK_ZERO = "2024-01-01 00:00:00"


class Commerce:
    """DataFrames over the tables in one folder; nothing is read until used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- structure --------------------------------------------------------------------------

    def devices(self) -> DataFrame:
        suppliers = self.table("supplier").select(
            F.concat(F.lit("s_"), "s_suppkey").alias("id"),
            F.lit("supplier").alias("type"),
            F.col("s_acctbal").alias("acctbal"),
            F.col("s_nationkey").alias("nationkey"),
        )
        customers = self.table("customer").select(
            F.concat(F.lit("c_"), "c_custkey").alias("id"),
            F.lit("customer").alias("type"),
            F.col("c_acctbal").alias("acctbal"),
            F.col("c_nationkey").alias("nationkey"),
        )
        return suppliers.unionByName(customers)

    def device_partitions(self) -> DataFrame:
        nation = self.table("nation")
        region = F.concat(F.lit("base_"), F.col("n_regionkey"))
        return (
            self.devices()
            .join(nation, F.col("nationkey") == F.col("n_nationkey"))
            .select(
                "id",
                region.alias("partition_0"),
                F.concat(region, F.lit("_"), F.col("n_nationkey")).alias("partition_1"),
            )
        )

    def edges(self) -> DataFrame:
        line = self.table("lineitem").select(
            "l_orderkey", "l_suppkey", "l_linestatus", "l_returnflag"
        )
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.concat(F.lit("s_"), "l_suppkey").alias("source"),
            F.concat(F.lit("c_"), "o_custkey").alias("target"),
            F.concat(F.lit("out_"), "l_linestatus").alias("source_port"),
            F.concat(F.lit("in_"), "l_returnflag").alias("target_port"),
        )

    def edges_with_id(self) -> DataFrame:
        return self.edges().withColumn("id", edge_id())

    def ports(self) -> DataFrame:
        """Output ports from line status, input ports from return flag; ``in_R`` takes returns."""
        line = self.table("lineitem")
        outputs = line.select(
            F.lit("supplier").alias("device_type"),
            F.concat(F.lit("out_"), "l_linestatus").alias("name"),
            F.lit("output").alias("direction"),
            F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("idx"),
            F.lit("ship").alias("message_type"),
        ).distinct()
        returned = F.col("l_returnflag") == "R"
        inputs = line.select(
            F.lit("customer").alias("device_type"),
            F.concat(F.lit("in_"), "l_returnflag").alias("name"),
            F.lit("input").alias("direction"),
            F.when(F.col("l_returnflag") == "A", 0).when(returned, 2).otherwise(1).alias("idx"),
            F.when(returned, "return").otherwise("ship").alias("message_type"),
        ).distinct()
        return outputs.unionByName(inputs)

    # -- log of orders and lines --------------------------------------------------------------

    def pair_events(self) -> DataFrame:
        day = lambda c: F.datediff(F.col(c).cast("date"), F.lit(DAY_ZERO).cast("date"))
        sends = self.table("orders").select(
            F.concat(F.lit("o"), "o_orderkey").alias("id"),
            F.concat(F.lit("c_"), "o_custkey").alias("dev"),
            F.lit("send").alias("type"),
            day("o_orderdate").cast("double").alias("time"),
            F.lit(None).cast("string").alias("send_id"),
            F.col("o_totalprice").alias("value"),
        )
        recvs = self.table("lineitem").select(
            F.concat_ws(
                "_", F.concat(F.lit("l"), "l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey"
            ).alias("id"),
            F.concat(F.lit("s_"), "l_suppkey").alias("dev"),
            F.lit("recv").alias("type"),
            day("l_shipdate").cast("double").alias("time"),
            F.concat(F.lit("o"), "l_orderkey").alias("send_id"),
            F.col("l_extendedprice").alias("value"),
        )
        return sends.unionByName(recvs)

    # -- timelines of users ---------------------------------------------------------------------

    def log(self) -> DataFrame:
        kind = F.col("event_type")
        # Both sides go through the session's zone, which cancels out.
        zero = F.lit(CLICK_ZERO).cast("timestamp_ntz").cast("timestamp")
        micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(zero)
        return self.table("events").select(
            F.col("event_id").cast("string").alias("id"),
            F.concat(F.lit("u_"), "user_id").alias("dev"),
            F.when(kind == "signup", "init")
            .when(kind.isin("click", "purchase"), "send")
            .otherwise("recv")
            .alias("type"),
            (micros.cast("double") / F.lit(3600000000.0)).alias("time"),
            F.col("event_id").alias("seq"),
            kind.alias("port"),
            "value",
            "props",
        )

    def log_with_state(self) -> DataFrame:
        """The log with its state as JSON text: the row's value and its ``k``."""
        k = F.get_json_object("props", "$.k").cast("double")
        state = F.to_json(F.struct(F.col("value").alias("v"), k.alias("k")))
        return self.log().withColumn("s", state)

    def user_partitions(self) -> DataFrame:
        users = self.table("events").select("user_id").distinct()
        outer = F.concat(F.lit("base_"), (F.col("user_id") % 5).cast("string"))
        return users.select(
            F.concat(F.lit("u_"), "user_id").alias("id"),
            outer.alias("partition_0"),
            F.concat(outer, F.lit("_"), (F.col("user_id") % 25).cast("string")).alias(
                "partition_1"
            ),
        )

    def user_states(self) -> DataFrame:
        """Last event of each user and day as that day's state."""
        epoch = F.floor(F.col("time") / 24).cast("bigint")
        k = F.get_json_object("props", "$.k").cast("double")
        return (
            self.log()
            .groupBy(F.col("dev").alias("id"), epoch.alias("epoch"))
            .agg(
                F.max_by("value", "seq").alias("value"),
                F.max_by(k, F.col("seq")).alias("k"),
            )
            .select("id", "epoch", F.lit(0).alias("init"), "value", "k")
        )
