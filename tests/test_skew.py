"""One key with a third of all rows: split work equals brute force."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from portmesh.operators import matrix as mx
from portmesh.operators import relations as rel
from portmesh.operators import rollups as roll
from portmesh.operators import skew
from portmesh.operators import timelines as tl
from portmesh.operators.checks import log_order
from portmesh.operators.supersteps import aggregate_messages
from portmesh.sinks import xml
from portmesh.sources import xml_snapshots


@pytest.fixture(scope="module")
def log():
    """(id, dev, seq, time): device h owns a third of the rows, with gaps in its seq."""
    draw = random.Random(4)
    out = []
    for i in range(600):
        dev = "h" if i % 3 == 0 else f"d{draw.randrange(40)}"
        out.append((f"e{i:04d}", dev, i * 3, i / 10))
    return out


@pytest.fixture(scope="module")
def log_df(spark, log):
    return spark.createDataFrame(log, "id string, dev string, seq bigint, time double").repartition(5)


def _by_dev(log):
    out = {}
    for row in sorted(log, key=lambda r: (r[2], r[0])):
        out.setdefault(row[1], []).append(row)
    return out


@pytest.mark.parametrize("size", [3, 50, 10_000])
def test_previous_in_order(log, log_df, size):
    want = []
    for events in _by_dev(log).values():
        want += [(e[0], p[0] if p else None) for p, e in zip([None, *events], events)]
    got = rows(tl.timeline(log_df, rows_per_run=size).select("id", "previous_id"))
    assert got == sorted(want, key=lambda r: tuple(map(str, r)))


def test_runs_cut_only_large_keys(log_df):
    assert skew.find_large(log_df, ["dev"], "seq", 1000) is None
    runs = skew.with_runs(log_df, ["dev"], "seq", skew.find_large(log_df, ["dev"], "seq", 50))
    assert {r["dev"] for r in runs.filter("_run is not null").collect()} == {"h"}
    largest = runs.groupBy("dev", "_run").count().agg(F.max("count")).first()[0]
    assert largest <= 52


@pytest.mark.parametrize("size", [4, 10_000])
def test_state_as_of(spark, log, log_df, size):
    facts = log_df.withColumn("value", F.col("seq") * 2)
    asked = [("h", t / 4) for t in range(-4, 260, 3)] + [("d1", 5.0), ("nobody", 1.0), ("h", 30.0)]
    probes = spark.createDataFrame(asked, "dev string, time double")
    want = []
    for dev, t in asked:
        before = [r for r in log if r[1] == dev and r[3] <= t]
        want.append((dev, t, max(before, key=lambda r: r[3])[2] * 2 if before else None))
    got = rel.state_as_of(facts, probes, ["value"], rows_per_run=size)
    assert rows(got) == sorted(want, key=lambda r: tuple(map(str, r)))


def test_log_order_with_copies(spark):
    data = [("h", 1, 1.0)] * 300 + [("h", i, float(i)) for i in range(2, 200)] + [("h", 300, 5.0)]
    data += [("a", 1, 2.0), ("a", 2, 1.0)]
    events = spark.createDataFrame(data, "dev string, seq bigint, time double")
    got = rows(log_order(events, rows_per_run=10).select("key", "detail"))
    assert got == [
        ("a:2", "time goes back"), ("h:1", "seq occurs 300 times"), ("h:300", "time goes back")
    ]


def test_number_rows_and_within(spark):
    names = [("hub" if i % 3 == 0 else f"g{i % 7}", f"n{i:03d}") for i in range(300)]
    df = spark.createDataFrame(names, "g string, id string").repartition(6)
    got = {r["id"]: r["index"] for r in skew.number_rows(df, ["id"]).collect()}
    assert got == {n: i for i, (_, n) in enumerate(sorted(names, key=lambda x: x[1]))}
    want = {}
    for g, n in sorted(names):
        want.setdefault(g, []).append(n)
    want = {n: i + 1 for ns in want.values() for i, n in enumerate(ns)}
    within = skew.number_within(df, ["g"], ["id"], "k")
    assert {r["id"]: r["k"] for r in within.collect()} == want


def test_adjacency_blocks_lose_nothing(spark):
    pairs = [("hub", f"t{i}") for i in range(500)] + [("hub", "t1")] * 200 + [("x", "y")]
    edges = spark.createDataFrame(
        [(s, "out", t, "in") for s, t in pairs],
        "source string, source_port string, target string, target_port string",
    )
    lists = roll.adjacency(edges, block=50)
    sizes = lists.select("source", F.size("targets").alias("n")).collect()
    assert max(r["n"] for r in sizes) < 120
    assert sum(r["n"] for r in sizes if r["source"] == "hub") == 500
    total = lists.select(F.explode("targets").alias("t")).agg(F.sum("t.edges")).first()[0]
    assert total == len(pairs)


def test_snapshot_blocks_read_back_whole(spark, tmp_path):
    states = spark.range(700).select(
        F.concat(F.lit("d"), "id").alias("id"), F.lit(3).cast("bigint").alias("epoch"),
        F.lit(1).cast("bigint").alias("sequence"), (F.col("id") % 5).alias("rts"),
        F.concat(F.lit('"v":'), "id").alias("state"),
    )
    elements = xml.snapshot_rows(states, block=100)
    assert elements.select(F.max(F.size("DevS"))).first()[0] < 200
    xml.write_snapshots_xml(states, str(tmp_path / "s"), block=100)
    back = xml_snapshots.read_device_states(spark, str(tmp_path / "s"))
    assert rows(back.select("id", "rts", "state")) == rows(states.select("id", "rts", "state"))


def test_hub_edges_in_blocks_give_the_same_sums(spark):
    edges = spark.createDataFrame(
        [("hub", f"v{i}", 1.0 + i) for i in range(90)] + [(f"v{i}", "hub", 2.0) for i in range(90)],
        "source string, target string, w double",
    )
    vertices = spark.createDataFrame(
        [("hub", 1.0)] + [(f"v{i}", float(i)) for i in range(90)], "id string, v double"
    )
    run = lambda block: aggregate_messages(
        vertices, edges, "w * src_v", "sum(msg)", {"v": "v + coalesce(agg, 0)"}, 3, block
    )
    assert dict(rows(run(7))) == pytest.approx(dict(rows(run(10**6))))
    a = edges.select(F.col("target").alias("row"), F.col("source").alias("col"), F.col("w").alias("value"))
    eye = vertices.select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(200.0).alias("value"))
    b = vertices.select(F.col("id").alias("i"), F.lit(1.0).alias("value"))
    solve = lambda block: mx.jacobi(a.unionByName(eye), b, b, 0.9, 2, block)
    small, large = dict(rows(solve(5))), dict(rows(solve(10**6)))
    assert small == pytest.approx(large)


def test_first_by_id_keeps_the_earliest_of_many_copies(spark):
    data = [("x", float(100 - i), i, f"d{i}") for i in range(100)] + [("y", 1.0, 5, "d")]
    events = spark.createDataFrame(data, "id string, time double, seq bigint, dev string")
    assert rows(rel.first_by_id(events)) == [("x", 1.0, 99, "d99"), ("y", 1.0, 5, "d")]
