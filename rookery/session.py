"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every job relies on. Partition counts and memory stay
# with the cluster; only result-relevant or skew-relevant settings are pinned.
_RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot actor or viewer may hold a third of a table: let the runtime split
    # such a join partition even where that costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Retention keeps up to 2,000 rows per group; keep the map-side top-n
    # (WindowGroupLimit) active up to there.
    "spark.sql.optimizer.windowGroupLimitThreshold": "4096",
}

_local_scratch: str | None = None
_shipped_to: str | None = None


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built, and send the
    package to its executors."""
    for key, value in _RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application: functions that run in
    Python workers import it there, wherever the job was started."""
    global _shipped_to
    if _shipped_to == spark.sparkContext.applicationId:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    parent, name = os.path.split(package)
    archive = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in sorted(os.walk(package)):
            for file in sorted(files):
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    out.write(path, os.path.relpath(path, parent))
    spark.sparkContext.addPyFile(archive)
    _shipped_to = spark.sparkContext.applicationId


def local_session(cores: str = "*", memory: str = "8g") -> SparkSession:
    """Single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rookery")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. A machine-local folder is
    used only in local mode with the setting absent.
    """
    global _local_scratch
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    named = named or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="rookery-")
    return _local_scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/rookery/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back.

    Cuts the lineage: rows that depend on task-local facts (partition number,
    arrival) keep their values when an executor is lost later.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
