"""Session set-up and reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "portmesh", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; a cluster normally brings its own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # long texts: Arrow batches are bounded by bytes, not only by rows
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; a scratch folder only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="portmesh-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name next to the checkpoints, for files that one job writes and reads back."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there.

    The result survives the loss of executors, so it is also the anchor for anything that must be
    evaluated once (range partitioning, row numbering).
    """
    ensure_checkpoint_dir(df.sparkSession)
    with _shuffles_end(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside leave no shuffle files behind. They must not be run again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def first_row(df: DataFrame) -> Row:
    """The first row; what was shuffled for it is removed at once."""
    with _shuffles_end(df.sparkSession):
        return df.select("*").first()


def stored(df: DataFrame, name: str = "kept", buckets: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` next to the checkpoints, compressed, and read it from there; ``drop`` removes it.

    With ``buckets`` the rows lie in one file per bucket of the columns ``by``, and joins by these columns don't move them.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark, name)
    with _shuffles_end(spark):
        if not buckets:
            df.select("*").write.option("compression", "zstd").parquet(folder)
            out = spark.read.schema(df.schema).parquet(folder)
            out._stored = (folder, None)
            return out
        table = f"{name}_{uuid.uuid4().hex}"
        spread = df.repartition(buckets, *by)
        writer = spread.write.format("parquet").option("path", folder).option("compression", "zstd")
        writer.bucketBy(buckets, *by).sortBy(*by).saveAsTable(table)
    out = spark.table(table)
    out._stored = (folder, table)
    return out


def drop(df: DataFrame) -> None:
    """Remove the files of a table that ``stored`` returned; nothing may read it from here on."""
    spark, (folder, table) = df.sparkSession, df._stored
    if table:
        spark.sql(f"drop table if exists {table}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
