"""Views on a clustered model read the files of their partition only."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from portmesh.plans import views
from portmesh.sinks import clustered
from portmesh.tables import Model


def small_model(spark, devices=240):
    """Devices in 4 x 6 leaf partitions, one of them with most of the events; one device is in none."""
    ids = spark.range(devices).select(F.concat(F.lit("d"), "id").alias("id"), "id")
    ids = ids.toDF("id", "n")
    a, b = F.col("n") % 4, F.col("n") % 24
    parts = ids.where(F.col("n") > 0).select(
        "id", F.concat(F.lit("base_"), a).alias("partition_0"), F.concat(F.lit("base_"), a, F.lit("_"), b).alias("partition_1")
    )
    states = ids.crossJoin(spark.range(5).toDF("epoch")).select("id", "epoch", F.lit(0).alias("init"), (F.col("n") * F.col("epoch")).alias("v"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("n") == 30, 3000).otherwise(6)))
    events = ids.select("id", copies.alias("k")).select(
        F.concat_ws("_", "id", "k").alias("id"), F.col("id").alias("dev"), F.when(F.col("k") % 2 == 0, "send").otherwise("recv").alias("type"),
        F.col("k").cast("double").alias("time"), F.lit(None).cast("string").alias("send_id"),
    )
    edges = spark.createDataFrame([], "level int, parent string, source string, target string, count long")
    border = spark.createDataFrame([], "level int, parent string, lower string, higher string, count long")
    return Model(
        device_partitions=parts, device_states=states, events=events, partition_edges=edges, border_edges=border,
        device_properties=ids.select("id", (F.col("n") * 2).alias("p")),
    )


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("clustered")
    model = small_model(spark)
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # or a model as small as this becomes one task
    spark.conf.set(name, "false")
    clustered.save_clustered(model, str(path), leaves_per_cell=3)
    spark.conf.unset(name)
    return model, clustered.load_clustered(spark, str(path), model), path


def answers(model, part, both=False):
    out = [rows(views.stepper(model, part)), *(rows(x) for x in views.event_window(model, part, 2, 5))]
    out.append(rows(views.event_window(model, part, 2, 3000, True)[1]))
    return out + [rows(x) for x in views.drill_down(model, part, init=0, epoch=3)] if both else out


def test_the_same_rows(stored):
    plain, laid, _ = stored
    for part in ("base_2_6", "base_0_0", "base_3_23"):
        assert answers(laid, part, True) == answers(plain, part, True)
    assert rows(views.event_window(laid, "base_1", 0, 9)[0]) == rows(views.event_window(plain, "base_1", 0, 9)[0])
    for name in clustered.CLUSTERED:
        assert getattr(laid, name).count() == getattr(plain, name).count()


def test_a_very_active_device_has_several_files(stored):
    _, laid, path = stored
    home = laid.events.where("dev = 'd30'").select("_metadata.file_name").distinct().count()
    assert home > 1


def test_folders_are_pruned(spark, stored):
    plain, laid, path = stored
    cells = {r.partition_1: r.cell for r in laid.cells.collect()}
    assert len(set(cells.values())) > 4
    before = answers(laid, "base_2_6", True)
    plan = views.event_window(laid, "base_2_6", 2, 5)[1]._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan and "dynamicpruning" in plan
    # files of other cells can't be read any more, and the view doesn't notice
    spoilt = 0
    for file in path.glob("*/cell=*/*.parquet"):
        if file.parent.name != f"cell={cells['base_2_6']}":
            file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
            file.write_bytes(b"no")
            spoilt += 1
    assert spoilt >= 12
    assert answers(laid, "base_2_6", True) == before
    with pytest.raises(Exception, match="(?i)parquet|file"):
        laid.events.agg(F.sum("time")).collect()


def test_rows_without_a_partition_are_kept(spark, tmp_path):
    model = small_model(spark, 30)
    clustered.save_clustered(model, str(tmp_path))
    laid = clustered.load_clustered(spark, str(tmp_path), model)
    assert rows(laid.device_states.where(F.col("cell") == clustered.NOWHERE).select("id").distinct()) == [("d0",)]
