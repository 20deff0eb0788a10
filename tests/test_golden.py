"""Hand-computed rows on a graph of six devices."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from portmesh.operators import relations as rel
from portmesh.operators import rollups as roll
from portmesh.operators import timelines as tl
from portmesh.plans import views
from portmesh.plans.build import build_model
from portmesh.tables import Model


@pytest.fixture(scope="module")
def parts(spark):
    placed = [("a", 0, 0), ("b", 0, 0), ("c", 0, 1), ("d", 1, 0), ("e", 1, 0), ("f", 1, 1)]
    return spark.createDataFrame(
        [(i, f"base_{p}", f"base_{p}_{q}") for i, p, q in placed],
        "id string, partition_0 string, partition_1 string",
    )


@pytest.fixture(scope="module")
def edges(spark):
    # Twice a-b, a self-edge, a-c inside base_0, two ways c-d, and e-a twice against a-e once.
    pairs = ["ab", "ab", "bb", "ac", "cd", "dc", "ea", "ea", "ae"]
    return spark.createDataFrame(
        [(s, t, "out", "in") for s, t in pairs],
        "source string, target string, source_port string, target_port string",
    )


def test_partition_edges(edges, parts):
    assert rows(roll.partition_edges(edges, parts, 0)) == [
        (0, "base", "base_0", "base_0", 3),
        (0, "base", "base_0", "base_1", 2),
        (0, "base", "base_1", "base_0", 3),
    ]
    assert rows(roll.partition_edges(edges, parts, 1)) == [
        (1, "base_0", "base_0_0", "base_0_0", 2),
        (1, "base_0", "base_0_0", "base_0_1", 1),
    ]
    assert rows(roll.partition_edges(edges, parts, 2)) == [
        (2, "base_0_0", "a", "b", None),
        (2, "base_0_0", "a", "b", None),
    ]


def test_border_edges_merge_equal_counts_only(edges, parts):
    assert rows(roll.border_edges(edges, parts, 1)) == [
        (1, "base_0", "base_0_0", "base_1", 1),
        (1, "base_0", "base_0_0", "base_1", 2),
        (1, "base_0", "base_0_1", "base_1", 1),
        (1, "base_1", "base_1_0", "base_0", 2),
        (1, "base_1", "base_1_0", "base_0", 3),
    ]
    assert rows(roll.border_edges(edges, parts, 1, "sum")) == [
        (1, "base_0", "base_0_0", "base_1", 3),
        (1, "base_0", "base_0_1", "base_1", 2),
        (1, "base_1", "base_1_0", "base_0", 5),
    ]


def test_one_pass_levels_equal_single_levels(edges, parts):
    pairs = roll.leaf_pairs(edges, parts)
    single = roll.partition_edges(edges, parts, 0).unionByName(roll.partition_edges(edges, parts, 1))
    assert rows(roll.inner_partition_edges(pairs, 2)) == rows(single)
    assert rows(roll.inner_border_edges(pairs, 2)) == rows(roll.border_edges(edges, parts, 1))
    assert rows(roll.inner_border_edges(pairs, 2, "sum")) == rows(
        roll.border_edges(edges, parts, 1, "sum")
    )


def test_crossing_and_inner_edges_add_up(edges, parts):
    inner = roll.partition_edges(edges, parts, 0).agg(F.sum("count")).first()[0]
    loops = edges.filter("source = target").count()
    assert inner + loops == edges.count()


def test_rollup_averages_devices_not_children(spark, parts):
    states = spark.createDataFrame(
        [("a", 0, 1, 1.0), ("b", 0, 1, 2.0), ("c", 0, 1, 9.0), ("a", 0, 0, 5.0), ("d", 0, 1, None)],
        "id string, epoch bigint, init int, v double",
    )
    assert rows(roll.state_rollup(states, parts)) == [
        (0, "base", "base_0", 0, 0, 5.0),
        (0, "base", "base_0", 0, 1, 4.0),
        (0, "base", "base_1", 0, 1, None),
        (1, "base_0", "base_0_0", 0, 0, 5.0),
        (1, "base_0", "base_0_0", 0, 1, 1.5),
        (1, "base_0", "base_0_1", 0, 1, 9.0),
        (1, "base_1", "base_1_0", 0, 1, None),
    ]


def test_complete_snapshot(spark, parts):
    states = spark.createDataFrame(
        [("a", 1, 0, 3, 2.5)], "id string, epoch bigint, init int, rts bigint, v double"
    )
    out = rel.complete_snapshot(states, parts.limit(6), {"rts": 0, "v": -1.0})
    assert rows(out.filter("id < 'c'")) == [("a", 1, 0, 3, 2.5), ("b", 1, 0, 0, -1.0)]
    assert out.count() == 6


def test_complete_snapshot_with_snapshots_in_many_blocks(spark):
    states = spark.sql("select concat('d', id % 7) as id, id as epoch, 0 as init, id * 0.5 as v from range(100)")
    devices = spark.sql("select concat('d', id) as id from range(9)")
    want = {(f"d{i}", e, 0, e * 0.5 if e % 7 == i else -1.0) for i in range(9) for e in range(100)}
    for size in (3, 100, 1000):
        out = rel.complete_snapshot(states, devices, {"v": -1.0}, snapshots_per_block=size).collect()
        assert len(out) == 900 and {(r.id, r.epoch, r.init, float(r.v)) for r in out} == want
    assert rel.complete_snapshot(states.limit(0), devices, {"v": -1.0}).count() == 0


def test_neighbours_and_touched(spark, edges):
    ids = spark.createDataFrame([("b",)], "id string")
    got = rows(rel.neighbours(edges, ids).select("neighbour", "edge"))
    assert got == [("a", "b:in-a:out"), ("a", "b:in-a:out"), ("b", "b:in-b:out")]
    events = spark.createDataFrame(
        [("s1", "c", "send", "out", None), ("s2", "e", "send", "other", None),
         ("r1", "a", "recv", "in", "s3"), ("s3", "e", "send", "none", None), ("i", "f", "init", None, None)],
        "id string, dev string, type string, port string, send_id string",
    ).withColumn("time", F.lit(0.0))
    got = rows(roll.touched(events, edges))
    assert [k for _, k in got if _ == "device"] == ["a", "c", "d", "e", "f"]
    assert [k for _, k in got if _ == "edge"] == ["a:in-e:none", "d:in-c:out"]


def test_running_messages_hold_through_silence(spark):
    events = spark.createDataFrame(
        [("x", "send", 1.0), ("x", "send", 1.5), ("x", "recv", 3.0), ("y", "init", 0.0),
         ("x", "send", 9.0)],
        "dev string, type string, time double",
    )
    assert rows(tl.running_messages(events, 4)) == [
        ("x", 1, 2, 0), ("x", 2, 2, 0), ("x", 3, 2, 1), ("x", 4, 2, 1)
    ]


def test_state_diff_counts_vanished_keys_as_zero(spark):
    events = spark.createDataFrame(
        [("e1", "d", 1, '{"a":1,"b":2}'), ("e2", "d", 2, '{"a":1,"c":5}'), ("e3", "d", 3, None)],
        "id string, dev string, seq bigint, s string",
    )
    assert rows(tl.state_diff(events)) == [
        ("e1", "d", 1, "a", "1", None),
        ("e1", "d", 1, "b", "2", None),
        ("e2", "d", 2, "b", "0", "2"),
        ("e2", "d", 2, "c", "5", None),
        ("e3", "d", 3, "a", "0", "1"),
        ("e3", "d", 3, "c", "0", "5"),
    ]


def test_firings_normalise_per_type(spark):
    states = spark.createDataFrame(
        [("e1", "m", 0, 2), ("e2", "m", 0, 6), ("e3", "m", 0, 3), ("e4", "n", 0, 9)],
        "id string, message_type string, epoch bigint, firings bigint",
    )
    got = {r["id"]: r["level"] for r in tl.normalise_firings(states).collect()}
    assert got == {"e1": 0.0, "e2": 1.0, "e3": 0.25, "e4": 0.0}


def test_views_on_a_built_model(spark, edges, parts):
    devices = parts.select("id", F.lit("t").alias("type"))
    states = devices.select(
        "id", F.lit(0).cast("bigint").alias("epoch"), F.lit(1).alias("init"),
        F.ascii("id").cast("double").alias("v"),
    )
    events = spark.createDataFrame(
        [("s", "a", "send", 1.0, None, '"v":3'), ("r1", "b", "recv", 2.0, "s", '"v":-1'),
         ("r2", "b", "recv", 4.0, "s", '"v":7')],
        "id string, dev string, type string, time double, send_id string, s string",
    )
    model = build_model(
        Model(devices=devices, edges=edges, device_partitions=parts, device_states=states,
              device_properties=devices.withColumn("p", F.lit(2.0)), events=events)
    )
    nodes, arcs = views.drill_down(model, "base_0")
    assert rows(nodes.select("kind", "id", "v", "p", "messages_sent", "messages_received")) == [
        ("border", "base_1", None, None, None, None),
        ("interior", "base_0_0", 97.5, 2.0, 1, 2),
        ("interior", "base_0_1", 99.0, 2.0, 0, 0),
    ]
    assert rows(arcs) == [
        ("base_0_0", "base_0_1", 1), ("base_0_0", "base_1", 1), ("base_0_0", "base_1", 2),
        ("base_0_1", "base_1", 1),
    ]
    nodes, arcs = views.drill_down(model, "base_0_0")
    assert rows(nodes.select("kind", "id", "v")) == [
        ("border", "base_0_1", None), ("border", "base_1_0", None),
        ("interior", "a", 97.0), ("interior", "b", 98.0),
    ]
    sends, recvs = views.event_window(model, "base_0_0", 2, 2)
    assert [r["id"] for r in sends.collect()] == ["s"]
    assert [r["id"] for r in recvs.collect()] == ["r1"]
    _, last = views.event_window(model, "base_0_0", 2, 4, last_recv_only=True)
    assert [r["id"] for r in last.collect()] == ["r2"]
    assert rows(model.meta) == [("level", 3), ("time", 4)]
    assert rows(model.value_ranges) == [
        ("messages_received", 0.0, 2.0), ("messages_sent", 0.0, 1.0), ("v", -1.0, 7.0)
    ]
    assert [r[0] for r in views.border_partitions(model, "base_0").collect()] == ["base_1"]
    assert views.rollup_history(model, "base_0", 1, 1).count() == 2
    assert views.stepper(model, "base_0_0").count() == 2
