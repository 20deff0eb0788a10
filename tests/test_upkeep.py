"""Derived tables kept up batch by batch against one build of everything."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from portmesh.operators import rollups as roll
from portmesh.sinks.upkeep import Kept, KeptModel
from portmesh.streaming import log_streams as ls

BATCHES = 10


@pytest.fixture(scope="module")
def run(spark):
    ids = spark.range(60).toDF("n")
    name = F.concat(F.lit("d"), "n").alias("id")
    parts = ids.select(name, F.concat(F.lit("base_"), F.col("n") % 3).alias("partition_0"),
                       F.concat(F.lit("base_"), F.col("n") % 3, F.lit("_"), F.col("n") % 12).alias("partition_1"))
    states = ids.crossJoin(spark.range(BATCHES).toDF("epoch")).select(
        name, "epoch", F.lit(0).alias("init"), (F.col("n") * 1.5 + F.col("epoch")).alias("v"),
        F.when(F.col("n") % 4 != 0, F.col("n")).alias("k"),
    )
    # only some devices are active in a batch
    events = ids.crossJoin(spark.range(BATCHES * 3).toDF("t")).where("(n + t) % 7 < 2").select(
        F.concat(F.lit("d"), "n").alias("dev"), F.when(F.col("t") % 2 == 0, "send").otherwise("recv").alias("type"),
        F.col("t").cast("double").alias("time"), F.format_string('{"v":%d,"w":"%d"}', F.col("n") - F.col("t"), F.col("t")).alias("s"),
    )
    return parts, states, events


def part_of(df, column, k, step):
    return df.where((F.col(column) >= k * step) & (F.col(column) < (k + 1) * step))


def built(run):
    parts, states, events = run
    names = ["level", "parent", "partition_id", "epoch", "init", "v", "k"]
    return [
        rows(roll.message_counts(events)), rows(roll.all_ranges(events)), rows(roll.meta(events, 3)),
        rounded(roll.state_rollup(states, parts).select(*names)),
    ]


def rounded(df):
    return rows(df.withColumns({c: F.round(c, 6) for c in ("v", "k")}))


def kept(spark, model):
    m = model.model(spark)
    names = ["level", "parent", "partition_id", "epoch", "init", "v", "k"]
    counts = model.counts.read(spark).select("dev", "messages_sent", "messages_received")
    return [rows(counts), rows(m.value_ranges), rows(m.meta), rounded(m.state_rollup.select(*names))]


def test_batches_equal_one_build(spark, run, tmp_path):
    parts, states, events = run
    model = KeptModel(str(tmp_path), parts, ["v", "k"], buckets=8)
    for k in range(BATCHES):
        mine = part_of(events, "time", k, 3), part_of(states, "epoch", k, 1)
        assert model.add(k, *mine) == ["message_counts", "value_ranges", "time", "state_sums"]
        if k in (0, 4):
            before = kept(spark, model)
            files = sorted(str(f) for f in tmp_path.rglob("*.parquet"))
            assert model.add(k, *mine) == []  # a batch that comes again
            assert kept(spark, model) == before and sorted(str(f) for f in tmp_path.rglob("*.parquet")) == files
    assert kept(spark, model) == built(run)


def test_a_batch_writes_only_what_it_touches(spark, tmp_path):
    table = Kept(str(tmp_path), "t", ["k"], ["n"], ["low"], ["high"], buckets=16)
    frame = lambda rows_: spark.createDataFrame(rows_, "k string, n long, low double, high double")
    assert table.read(spark) is None and table.versions(spark) == (-1, {})
    table.merge(frame([(f"k{i}", 1, float(i), float(i)) for i in range(100)]), 0)
    assert len(table.versions(spark)[1]) == 16
    table.merge(frame([("k5", 2, -1.0, 2.0), ("k5", 3, 0.0, 9.0)]), 1)
    versions = table.versions(spark)[1]
    assert sorted(versions.values()) == [0] * 15 + [1]
    written = [f.parent.name for f in (tmp_path / "t/rows/version=1").rglob("*.parquet")]
    assert written == [f"bucket={b}" for b, v in versions.items() if v == 1]
    assert rows(table.read(spark).where("k = 'k5'").select("n", "low", "high")) == [(6, -1.0, 9.0)]
    assert table.read(spark).count() == 100
    table.merge(frame([]), 5)  # an empty batch counts too
    assert table.versions(spark) == (5, versions) and not table.merge(frame([("k1", 1, 0.0, 0.0)]), 5)


def test_a_batch_that_failed_half_way(spark, tmp_path):
    """Rows without a list don't count, and the next attempt writes them again."""
    table = Kept(str(tmp_path), "t", ["k"], ["n"], buckets=4)
    frame = lambda n: spark.createDataFrame([("a", n), ("b", n)], "k string, n long")
    table.merge(frame(1), 0)
    table.merge(frame(10), 1)
    for f in (tmp_path / "t/lists/batch=1").iterdir():  # as if the list had not been written
        f.unlink()
    (tmp_path / "t/lists/batch=1").rmdir()
    assert rows(table.read(spark).select("k", "n")) == [("a", 1), ("b", 1)]
    assert table.merge(frame(10), 1)
    assert rows(table.read(spark).select("k", "n")) == [("a", 11), ("b", 11)]


def test_kept_by_a_stream(spark, run, tmp_path):
    """Batches of a stream, and a restart of it."""
    parts, _, events = run
    for k in range(3):
        part_of(events, "time", k, 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    model = KeptModel(f"{tmp_path}/m", parts, ["v"], buckets=4)
    for _ in range(2):
        stream = ls.stream_parquet(spark, f"{tmp_path}/in", events.schema, files_per_trigger=1)
        ls.push(stream, lambda batch, k: model.add(k, batch), f"{tmp_path}/cp").awaitTermination()
    got = model.counts.read(spark).select("dev", "messages_sent", "messages_received")
    assert rows(got) == rows(roll.message_counts(events))
    assert rows(model.model(spark).value_ranges) == rows(roll.all_ranges(events))
