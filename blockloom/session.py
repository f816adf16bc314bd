"""Session helpers: building a local session, and cutting lineage through a shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OPEN: dict[str, SparkSession] = {}


def local_session(cpus: int = 8, memory: str = "12g", **conf: str) -> SparkSession:
    """A local session with the settings the engine is written for; used by tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("blockloom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for written intermediate tables: spark.checkpoint.dir, as the session has it.

    Where it is unset, a temporary folder is used, but only by a local session: on a cluster a
    machine-local folder would be lost with its machine, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="blockloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table written by ``materialize``."""
    fs, target = _filesystem(spark, path)
    fs.delete(target, True)
    _OPEN.pop(path, None)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_OPEN.items()):
        try:
            drop(spark, path)
        except Exception:  # the session may be gone already
            pass


def materialize(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, executors may be lost.

    Unlike ``checkpoint`` the plan runs once, and later readers prune columns. Returns the table and
    its path; ``drop`` removes it, the end of the driver does so otherwise.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/blockloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _OPEN[path] = spark
    return spark.read.schema(df.schema).parquet(path), path


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of all executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_blockloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="blockloom-code-")) / "blockloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._blockloom_shipped = True
