"""Session set-up and the one way this library cuts lineage.

Intermediate results that later steps read more than once go to the folder all
executors share (``spark.checkpoint.dir``), so a lost executor costs a re-read
and never a restart.  A folder of our own is set only where the session names
none, as in local tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vectrail")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder.  A machine's own folder stands in for it only where driver and executors are one machine."""
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (current.get() if current.isDefined() else None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = getattr(spark, "_vectrail_scratch", None) or tempfile.mkdtemp(prefix="vectrail-")
        spark._vectrail_scratch = named
    ctx = spark.sparkContext
    if ctx._jsc.sc().getCheckpointDir().isEmpty():
        ctx.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession) -> str:
    """An unused path for a table of this application in the shared folder."""
    return f"{_own_dir(spark)}/{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/vectrail-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def scratch(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back.

    Unlike a checkpoint it keeps columns apart and can be read one partition
    value at a time.  Used where several later passes read parts of ``df``.
    """
    spark = df.sparkSession
    path = new_path(spark)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._vectrail_path = path
    return back


def release(df: DataFrame) -> None:
    """Deletes the scratch table behind ``df``; for loops whose next round has already been written."""
    path = getattr(df, "_vectrail_path", None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes this application's scratch tables; call it once no frame built on them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
