"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "srcatlas", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; `conf` keys use `__` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    base |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in base.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or a temporary one where it is unset (tests, local mode)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("srcatlas.local.shared", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("srcatlas.local.shared", root)
    return root.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def clear_materialized() -> None:
    """Delete what `materialize` wrote; to be called once the results that read it are no longer needed."""
    while _written:
        spark, path = _written.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut lineage: write `df` to the shared folder as Parquet and read it back.

    Unlike a cached or locally checkpointed frame, the result outlives any executor. It stays until `clear_materialized`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/srcatlas-{os.getpid()}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession, per_core: int = 3) -> int:
    """Partitions for a CPU-bound stage: a few per core, at least the configured shuffle width."""
    cores = spark.sparkContext.defaultParallelism
    return max(cores * per_core, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers once per application, so that they need no copy of their own."""
    app = spark.sparkContext.applicationId
    if spark.conf.get("srcatlas.shipped", None) == app:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-pkg-")) / "srcatlas.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    spark.conf.set("srcatlas.shipped", app)
