"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


_OWNED: set[str] = set()          # run folders that already have an owner


def local_session(cpus: int | str = 8, app: str = "barloom", **extra: str) -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = dict(DEFAULTS, **{"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "12g"})
    settings.update(extra)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it. Where one process runs everything and none is named, the warehouse serves."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"


def run_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; the driver's JVM removes it when it ends."""
    path = f"{shared_dir(spark)}/barloom-{spark.sparkContext.applicationId}"
    if path not in _OWNED:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
        _OWNED.add(path)
    return path


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder for one run of one job."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stored frame of this run that nothing reads any more."""
    if not path.startswith(f"{run_dir(spark)}/"):
        raise ValueError("only a stored frame of this run may be removed")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def parts_for(spark: SparkSession, path: str, mb: int) -> int:
    """Into how many parts the rows of a stored table are dealt: one for every `mb` megabytes of its files, no fewer than there are cores. What a task
    holds then stays the same however large the table is, whatever number of shuffle partitions the session names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stored = sum(fs.getContentSummary(x.getPath()).getLength() for x in fs.globStatus(where) or ())
    return max(spark.sparkContext.defaultParallelism, -(-stored // (mb << 20)))


def cut_lineage(df, label: str):
    """Materialise a frame in the shared folder so that a lost executor only re-reads it, never re-derives it."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
