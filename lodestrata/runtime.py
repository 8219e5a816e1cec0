"""Session, table and shared-storage helpers used by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def local_session(app: str = "lodestrata", cores: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by the Python workers.

    Nothing is done where the workers inherit it through PYTHONPATH.
    """
    root = str(PACKAGE_ROOT.parent)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or ""
    folder = named.removeprefix("file://") if named.startswith(("file://", "/")) else ""
    if folder:
        os.makedirs(folder, exist_ok=True)
    archive = Path(tempfile.mkdtemp(dir=folder or None)) / "lodestrata.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in PACKAGE_ROOT.rglob("*.py"):
            z.write(p, p.relative_to(PACKAGE_ROOT.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='lodestrata-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write to the shared folder and read back.

    Unlike ``checkpoint()`` this computes the plan once and keeps the result columnar.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def row_bound(df: DataFrame) -> int:
    """Number of rows; for a parquet scan only the footers are read."""
    return df.count()


def partitions_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Enough partitions that none holds more than about ``rows_per_task`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task))
