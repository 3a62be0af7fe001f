"""Session settings the operators rely on, and the shared folder for materialised cuts."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Keyed stream state with timers needs it; read when a streaming query starts.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator assumes (UTC wall clock, AQE)."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    _ship_package(spark)
    return spark


_shipped: set[str] = set()


def _ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that functions sent by reference are found there."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = Path(__file__).resolve().parent
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-package-"), f"{root.name}.zip")
    Path(archive).write_bytes(content.getvalue())
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can read. Taken from the session; a temporary one only where unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="spark-ordertide-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_run_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Cut lineage through a written table in the shared folder; survives executor loss."""
    path = new_run_folder(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
