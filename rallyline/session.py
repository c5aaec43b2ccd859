"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str = "local[*]", app: str = "rallyline", **extra: str) -> SparkSession:
    """A session for tests, the bench and scripts; a cluster brings its own."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (SETTINGS | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a fresh local one if all runs in one process; on a cluster
    that would be a folder of one machine only, so it is an error."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not _is_local(spark):
            raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="rallyline-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark can write one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def settle(df: DataFrame) -> DataFrame:
    """Compute df once into the shared folder and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS_PER_BATCH = 2000  # of whole texts: a Python worker holds a batch or two at a time


def ship_package(spark: SparkSession) -> None:
    """Make ready for Python workers: send this package to the executors, once per application, unless they are this
    process and PYTHONPATH names it, and keep their Arrow batches small where the session still has Spark's default."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, str(ROWS_PER_BATCH))
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _shipped or _is_local(spark) and str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted((root / "rallyline").rglob("*.py")):
            out.write(path, path.relative_to(root))
    target = Path(tempfile.mkdtemp(prefix="rallyline-ship-")) / "rallyline.zip"
    target.write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
