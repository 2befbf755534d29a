"""Session helpers: a local session for tests and bench, and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int = 4, checkpoint_dir: str | None = None) -> SparkSession:
    """A single-machine session; a cluster brings its own (see README)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("almoner")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if checkpoint_dir:
        builder = builder.config(CHECKPOINT_CONF, checkpoint_dir)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as named by spark.checkpoint.dir.

    A session without that setting must be a local one: it gets a temporary
    folder of this machine. On a cluster that would lose data, so it is refused.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="almoner-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the shared folder; what is written there is deleted when the
    application ends."""
    folder = f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Runs ``df`` once into Parquet below the shared folder: later reads see the same rows in
    the same partitions, also after an executor is lost."""
    folder = fresh_dir(df.sparkSession, "staged")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
