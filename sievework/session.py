"""Session helpers: configuration defaults and reliable lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "sievework") -> SparkSession:
    """A session for tests and the bench; clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder the cluster names; fall back to a temp folder in local mode only."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="sievework-ckpt-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet below the shared checkpoint folder and go on from the stored copy.

    Sizes then come from the files, not from estimates multiplied through earlier rounds, and only
    the columns asked for are read. Partitions and their order are not kept; see `checkpointed`.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def shuffled(df: DataFrame) -> DataFrame:
    """One side of a join whose rows are to meet by a shuffle on any size.

    Stored copies are small files of many rows, which Spark would collect on the driver and broadcast, each
    round of a loop again.
    """
    return df.hint("merge")


def checkpointed(df: DataFrame) -> DataFrame:
    """Like `cut`, for callers that rely on the partitions and the order of rows in them."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def discard(*frames: DataFrame) -> None:
    """Delete the stored copies behind frames returned by `cut` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
