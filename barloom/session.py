"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "barloom", master: str | None = None, cores: int = 8) -> SparkSession:
    """A session with the settings the library relies on.

    On a cluster the caller's own session is used as it is; the master and the memory
    settings below only matter for local runs.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = (
            builder.master(master)
            .config("spark.driver.memory", os.environ.get("BARLOOM_DRIVER_MEMORY", "16g"))
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.ui.enabled", "false")
        )
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # call sites of every expression cost many round trips while large plans are built
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .getOrCreate()
    )


_LOCAL_FOLDERS: dict[str, str] = {}
# exchanges' files of an execution are removed at its end
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session without one (tests) gets a fresh local folder; a cluster session must
    name a folder all executors can reach.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_FOLDERS[app]


def discard(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, name: str = "stage", paths: list[str] | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Parquet instead of an RDD checkpoint keeps column pruning and filter pushdown for the
    readers, and a lost executor costs a re-read instead of a recomputation. ``paths`` is for a chain of tables
    that are each read by the next one only: it holds the last one's path, which goes once this one is written. So do the files that
    this one's exchanges left, which otherwise stay until the driver collects garbage.
    """
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if paths is None:
        df.write.mode("errorifexists").parquet(path)
    else:
        conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
        finally:
            conf.set(CLEANUP, before)
        for old in paths:
            discard(df.sparkSession, old)
        paths[:] = [path]
    return df.sparkSession.read.schema(df.schema).parquet(path)
