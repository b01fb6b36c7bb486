"""Session settings shared by tests, the benchmark and stand-alone runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "crawlscope", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session; `master` is only given for local runs, a cluster submits with its own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_batches(rows: int) -> None:
    """Set Arrow batches to at most `rows` rows for the session, if they are larger: a Python worker holds a whole batch, so its memory must not hang on the size of a partition."""
    spark, key = SparkSession.active(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a folder of our own only in a local session that names none.

    Executors of a cluster see no folder of the driver's disk, so without a name a cluster session stops here.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return context.getCheckpointDir()


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cut the lineage of a table that many later steps read, so a lost executor does not redo the extraction.

    The table is written to the shared folder and read back, which survives executor loss and lets later
    readers prune columns.
    """
    spark = df.sparkSession
    target = f"{path or shared_checkpoint_dir(spark)}/{name}"
    df.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def cut(df: DataFrame, name: str) -> DataFrame:
    """`materialise` under a fresh name: for intermediate tables that a query reads several times."""
    return materialise(df, f"{name}-{uuid.uuid4().hex}")
