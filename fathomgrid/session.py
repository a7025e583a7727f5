"""Session helpers shared by every operator: table loading, sizes, checkpoints."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "fathomgrid", cores: int | str = "*", partitions: int | None = None) -> SparkSession:
    """A local session with the settings the engine expects (a cluster brings its own)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data directory; a Parquet file or a directory of part files."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder in spark.checkpoint.dir; only a local session gets one of its own."""
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="fathomgrid-ckpt-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the shared folder, so that a lost executor costs nothing twice."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than there are cores, dealt out over all of them; any other plan as it
    is.  Heavy work on the texts of a few small files runs on every core so; a scan of many files (the
    case at scale) isn't touched."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":  # has an exchange already
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if plan.execute().getNumPartitions() >= cores else df.repartition(cores)


def default_sf_dir() -> str:
    return os.environ.get("FATHOMGRID_SF_DIR", "/root/testdata/sf0.001")
