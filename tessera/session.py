"""Sessions, the package on workers, tables and scratch tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
#: Rows and bytes of the batches that readers fill and Python workers get, set where the session has Spark's defaults: texts
#: are long, and several workers share an executor's memory.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": ("4096", "1024"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1024"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b")}


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on, UTC and the given settings."""
    builder = SparkSession.builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Once a session: sets the batches, and gives workers this package where neither PYTHONPATH nor the
    working directory holds it."""
    if getattr(spark, "_tessera_shipped", False):
        return
    spark._tessera_shipped = True
    for name, (usual, own) in BATCHES.items():
        if spark.conf.get(name) == usual:
            spark.conf.set(name, own)
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or Path.cwd() == ROOT:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((ROOT / "tessera").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset on one machine, as in tests, a fresh temporary folder,
    removed at the end, becomes it; on a cluster, whose machines share no such folder, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_tessera_shared", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
        spark._tessera_shared = found
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not hasattr(spark, "_tessera_scratch"):
        spark._tessera_scratch = []
    spark._tessera_scratch.append(path)
    return path


def _hadoop(spark: SparkSession, path: str):
    """The file system and its name of a path, through Spark, so any store works."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def clear(spark: SparkSession) -> int:
    """Deletes the scratch tables that this session has made so far; results that still read them are lost. How many."""
    paths = getattr(spark, "_tessera_scratch", [])
    for path in paths:
        fs, p = _hadoop(spark, path)
        fs.delete(p, True)
    spark._tessera_scratch = []
    return len(paths)


def finished(spark: SparkSession, run: str | None, name: str) -> DataFrame | None:
    """The table that a step of a named run has left, if it was written to its end."""
    if run is None:
        return None
    path = f"{shared_dir(spark)}/run-{run}/{name}"
    fs, p = _hadoop(spark, f"{path}/_SUCCESS")
    return spark.read.parquet(path) if fs.exists(p) else None


def kept(df: DataFrame, run: str | None, name: str) -> DataFrame:
    """df as a table: of a named run, where finished() finds it again, else a scratch one."""
    if run is None:
        return written(df, name)
    path = f"{shared_dir(df.sparkSession)}/run-{run}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors. With files, rows are
    first dealt to so many tasks: a table of ids made by many tasks isn't left in as many tiny files."""
    path = scratch_path(df.sparkSession, name)
    (df.repartition(files) if files else df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
