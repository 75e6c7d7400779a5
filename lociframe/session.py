"""Session defaults, the shared folder, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def local_session(cores: int | str = "*", app: str = "lociframe", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the local bench. On a cluster the session comes from spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by spark.checkpoint.dir; where none is set, make one on a local master, else fail."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            configured = tempfile.mkdtemp(prefix="lociframe-ckpt-")
        sc.setCheckpointDir(configured)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, in a folder of this application that is deleted when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        ensure_checkpoint_dir(spark)
        base = spark.sparkContext.getCheckpointDir()
    own = f"{base.rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: computed once, never again when an executor is lost.

    Unlike an RDD checkpoint it runs the plan above it once, keeps column pruning and filters of what reads it, and
    its size is known to the planner. A column of no type can't be written; then a reliable checkpoint is made.
    """
    if any(isinstance(f.dataType, T.NullType) for f in df.schema.fields):
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash partitions by the columns in a fixed number.

    For stages that compute far more than they read: without a number the adaptive plan would merge
    their few bytes into a few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)
