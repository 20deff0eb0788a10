"""A model stored for its views: rows of devices lie by the partition their device is in.

The leaf partitions are put in order of their path and cut into cells, ranges with about the same number of
leaves. Every table with rows of devices is written with one folder per cell, sorted by path and time inside, and
repeats the partition columns of the device. A partition of any level is a range of leaves, so its rows lie in few
neighbouring cells: a view looks those up in the small ``cells`` table, whose result prunes the folders while the
query runs, and the sorted files skip row groups by partition and time.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portmesh.session import checkpoint
from portmesh.tables import Model, partition_columns

#: Folders of a table at most; the table of cells has one row for each leaf partition.
MOST_CELLS = 4096
#: Leaf partitions of a cell, about, in models that need fewer cells.
LEAVES_PER_CELL = 8
#: Tables with rows of devices: the column that names the device, and what rows are sorted by after the path.
CLUSTERED = {
    "device_states": ("id", ["epoch", "id"]),
    "device_properties": ("id", ["id"]),
    "events": ("dev", ["time", "id"]),
}
#: The cell of rows whose device is in no partition.
NOWHERE = -1


def leaf_cells(parts: DataFrame, leaves_per_cell: int = LEAVES_PER_CELL) -> DataFrame:
    """The partition columns of each leaf partition and its ``cell``. Cells follow the order of paths."""
    path = partition_columns(parts)
    leaves = parts.select(*path).distinct()
    cells = min(MOST_CELLS, -(-leaves.count() // leaves_per_cell)) or 1
    spread = leaves.repartitionByRange(cells, *path).withColumn("cell", F.spark_partition_id())
    return checkpoint(spread)  # the ranges come from a sample: fix them


def save_clustered(
    model: Model, path: str, leaves_per_cell: int = LEAVES_PER_CELL, mode: str = "errorifexists"
) -> None:
    """Write the cells and the tables of ``CLUSTERED`` that the model has."""
    parts = model.device_partitions
    cells = leaf_cells(parts, leaves_per_cell)
    cells.write.mode(mode).parquet(f"{path}/cells")
    columns = partition_columns(parts)
    home = parts.join(cells, columns)
    for name, df in model.tables().items():
        if name not in CLUSTERED:
            continue
        device, order = CLUSTERED[name]
        order = [c for c in order if c in df.columns]
        placed = df.join(home.withColumnRenamed("id", device), device, "left").withColumn(
            "cell", F.coalesce("cell", F.lit(NOWHERE))
        )
        # ranges, not hashes: a cell with a very active device becomes several files, each a stretch of it
        by = ["cell", *columns, *order]
        placed.repartitionByRange(*by).sortWithinPartitions(*by).write.mode(mode).partitionBy("cell").parquet(
            f"{path}/{name}"
        )


def load_clustered(spark: SparkSession, path: str, model: Model) -> Model:
    """``model`` with its clustered tables in place of the plain ones."""
    stored = {name: spark.read.parquet(f"{path}/{name}") for name in model.tables() if name in CLUSTERED}
    return replace(model, cells=spark.read.parquet(f"{path}/cells"), **stored)


def inside(df: DataFrame, cells: DataFrame, part_id: str, column: str) -> DataFrame:
    """Rows of a clustered table whose device is in a partition; only its cells are read."""
    reach = cells.filter(F.col(column) == part_id).select("cell").distinct()  # at most MOST_CELLS rows
    found = df.filter(F.col(column) == part_id).join(F.broadcast(reach), "cell", "left_semi")
    return found.drop("cell", *partition_columns(df))
