"""Joins and roll-ups read their large side no more often than they need to."""

from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from portmesh.operators import matrix as mx
from portmesh.operators import partitioning as pt
from portmesh.operators import rollups as roll
from portmesh.operators.supersteps import PlacedEdges
from portmesh.session import ensure_checkpoint_dir
from portmesh.sinks.text import dot_statements


@pytest.fixture
def no_small_tables(spark):
    """Nothing is broadcast unless the code says so."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _plan(df, which="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


def test_one_level_leaves_out_the_others(spark):
    pairs = spark.createDataFrame(
        [("b_0_0", "b_0_1", 2), ("b_0_0", "b_1_0", 3)], "source_leaf string, target_leaf string, count bigint"
    )
    for df in (roll.inner_partition_edges(pairs, 2), roll.inner_border_edges(pairs, 2)):
        assert "Aggregate" in _plan(df)
        assert "Aggregate" not in _plan(df.filter("level = 2"))
    assert rows(roll.inner_partition_edges(pairs, 2).drop("parent")) == [
        (0, "b_0", "b_0", 2), (0, "b_0", "b_1", 3), (1, "b_0_0", "b_0_1", 2),
    ]


def test_delayed_input_in_lists(spark):
    n = spark.createDataFrame([("a", float(t), 1 + t % 2) for t in range(7)] + [("b", None, 1)], "source string, time double, _n bigint")
    w = spark.createDataFrame([("a", "x", 1, 2.0), ("a", "y", 2, 3.0), ("b", "x", 1, 5.0)], "source string, target string, delay int, _w double")
    assert rows(roll._input_by_target(n, w, block=2)) == rows(roll._input(n.join(w, "source")))


def test_hubs_are_broadcast(spark, no_small_tables):
    edges = spark.createDataFrame([("h", f"d{i}") for i in range(9)] + [("a", "b")], "source string, target string")
    placed = PlacedEdges(edges, "source", "target", block=3)
    values = spark.createDataFrame([("h", 1), ("a", 2)], "source string, v int")
    got = placed.join(values)
    assert rows(got) == rows(edges.join(values, "source"))
    assert "SortMergeJoin" not in _plan(placed.edges, "executedPlan")
    placed.release()


def test_residual_of_the_placed_matrix(spark):
    a = spark.createDataFrame([("a", "a", 4.0), ("b", "b", 4.0), ("a", "b", -1.0), ("c", "c", 2.0)], "row string, col string, value double")
    b = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "i string, value double")
    x = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "i string, value double")
    smoother = mx.Smoother(a, 0.8)
    assert rows(smoother.residual(b, x)) == rows(mx.residual(a, x, b))
    smoother.release()


def test_dot_edges_stay_where_they_are(spark, no_small_tables):
    devices = spark.createDataFrame([("a", "t"), ("b", "t")], "id string, type string")
    edges = spark.createDataFrame(
        [("e", "a", "b", "o", "i", "m")],
        "id string, source string, target string, source_port string, target_port string, message_type string",
    )
    out = dot_statements(devices, edges)
    assert "SortMergeJoin" not in _plan(out, "executedPlan")
    assert out.filter(F.col("part") == 2).count() == 1


@pytest.mark.parametrize("hub", [False, True])
def test_touched_edges_are_spread_by_their_number(spark, no_small_tables, hub):
    sends = [(f"s{0 if hub else i % 40}", "send", f"p{i % 3}") for i in range(120)]
    events = spark.createDataFrame([*sends, ("lone", "init", None), (None, "send", "p0")], "dev string, type string, port string")
    events = events.selectExpr("*", "cast(null as string) as id", "cast(null as string) as send_id", "0.0 as time")
    links = [(f"s{0 if hub else i % 50}", f"t{i % 70}", f"p{i % 4}", "in") for i in range(200)] + [(None, "t", "p0", "in")]
    edges = spark.createDataFrame(links * 2, "source string, target string, source_port string, target_port string")
    fired = {e for e in links if (e[0], "send", e[2]) in sends}
    want = {("device", d) for d in {d for d, _, _ in sends} | {"lone", None} | {e[1] for e in fired}}
    want |= {("edge", f"{t}:{i}-{s}:{o}") for s, t, o, i in fired}
    for tasks, known in ((1, {}), (41, {}), (9, {"rows": 90})):
        got = roll.touched(events, edges, rows_per_task=10 if tasks > 1 else 10**6, **known)
        assert rows(got) == sorted(want, key=lambda r: tuple(map(str, r)))
        assert tasks == 1 or f", {tasks}), REPARTITION_BY_NUM" in _plan(got, "executedPlan")


def _left(spark):
    """Files and folders that operators left beside the checkpoints."""
    ensure_checkpoint_dir(spark)
    top = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    return {p.name for p in top.iterdir() if not p.name.startswith("rdd-")}


def test_placed_edges_lie_in_files_by_key(spark, no_small_tables):
    edges = spark.range(3000).selectExpr("concat('d', id % 50) as source", "concat('e', id % 7) as target", "id as w")
    edges = edges.union(spark.createDataFrame([(None, "e1", 1), ("d1", None, 2)], edges.schema))
    before, cached = _left(spark), set(spark.sparkContext._jsc.getPersistentRDDs())
    placed = PlacedEdges(edges, "source", "target", block=40)
    assert len(_left(spark) - before) == 1 and set(spark.sparkContext._jsc.getPersistentRDDs()) <= cached
    values = spark.createDataFrame([(f"d{i}", i) for i in range(40)], "source string, v int")
    joined = placed.join(values)
    assert rows(joined.select("source", "target", "w", "v")) == rows(edges.join(values, "source"))
    assert _plan(joined, "executedPlan").count("Exchange hashpartitioning") == 1  # the values alone
    placed.release()
    assert _left(spark) == before and not spark.catalog.listTables()


def _edges(spark, n, seed):
    ends = [F.concat(F.lit("d"), F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(60))) for k in (0, 1)]
    return spark.range(n).select(ends[0].alias("source"), ends[1].alias("target"))


def test_pairs_at_hand_give_the_same_partitions(spark):
    edges = _edges(spark, 400, 3).unionByName(spark.createDataFrame([(None, "d1"), ("far", "d2")], "source string, target string"))
    devices = spark.range(60).select(F.concat(F.lit("d"), "id").alias("id"))
    pairs = pt.weighted_pairs(edges).persist()
    before = _left(spark)
    plain = pt.partition_hierarchy(edges, devices, nodes_per_part=5, rounds=1)
    at_hand = pt.partition_hierarchy(edges, devices, nodes_per_part=5, rounds=1, pairs=pairs)
    assert rows(plain) == rows(at_hand) and plain.columns == ["id", "partition_0", "partition_1"]
    assert len(_left(spark) - before) == 2  # the two results
    start = devices.select("id", F.pmod(F.xxhash64("id"), F.lit(4)).alias("part"))
    weighted = pairs.toDF("source", "target", "weight")
    near = pt.place_pairs(pairs)
    for mode in ("greedy", "anneal", "batch"):
        one = pt.refine_partition(edges, start, 4, rounds=2, mode=mode, seed=2)
        other = pt.refine_partition(weighted, start, 4, rounds=2, mode=mode, seed=2, placed=near)
        assert rows(one) == rows(other)
        assert rows(pt.partition_cost(edges, one, 4)) == rows(pt.partition_cost(weighted, one, 4))
    near.release()
    pairs.unpersist()
    assert len(_left(spark) - before) == 8


def test_levels_with_repeated_devices(spark):
    edges = _edges(spark, 300, 5)
    devices = spark.range(90).select(F.concat(F.lit("d"), F.col("id") % 60).alias("id"))
    parts = pt.partition_hierarchy(edges, devices, nodes_per_part=5, rounds=1)
    assert parts.select("id").distinct().count() == 60 and parts.count() >= 90


def test_coarse_matrix_of_the_placed_one(spark):
    a = spark.createDataFrame([("a", "a", 4.0), ("b", "b", 4.0), ("a", "b", -1.0), ("b", "a", -3.0), ("c", "c", 2.0)], "row string, col string, value double")
    p = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 1.0), ("c", "y", 1.0)], "row string, col string, value double")
    b = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "i string, value double")
    smoother = mx.Smoother(a, 0.8)
    assert rows(smoother.coarse(p)) == [("x", "x", 4.0), ("y", "y", 2.0)]
    levels = [mx.Level(a, p, p.selectExpr("col as row", "row as col", "value"), 0.8), mx.Level(smoother.coarse(p).filter("row = 'x'"))]
    want = rows(mx.multigrid_cycle(levels, b, b))
    assert rows(mx.multigrid_cycle(levels, b, b, smoothers={0: smoother})) == want
    assert rows(mx.norm(smoother.residual(b, b))) == rows(mx.residual_norm(a, b, b))
    smoother.release()
