"""Table sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.columns import ROW_ID, c


def with_file_row_id(df: DataFrame) -> DataFrame:
    """Number rows by (file, block, position) without sorting them.

    Only one summary row per file split takes part in the running total.
    """
    tagged = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_o"),
                       F.monotonically_increasing_id().alias("_m"))
    splits = tagged.groupBy("_f", "_o").agg(F.count("*").alias("_n"), F.min("_m").alias("_base"))
    per_file = splits.groupBy("_f").agg(F.sum("_n").alias("_fn"))
    # Two-level totals: inside a file, then over files.
    file_off = per_file.select("_f", (F.sum("_fn").over(W.orderBy("_f")) - F.col("_fn")).alias("_foff"))
    inner = F.sum("_n").over(W.partitionBy("_f").orderBy("_o")) - F.col("_n")
    offsets = splits.withColumn("_in", inner).join(file_off, "_f").select("_f", "_o", "_base", (F.col("_foff") + F.col("_in")).alias("_off"))
    return tagged.join(offsets, ["_f", "_o"]).withColumn(ROW_ID, F.col("_m") - F.col("_base") + F.col("_off")).drop("_f", "_o", "_m", "_base", "_off")


def read_table(spark: SparkSession, path: str, row_id: str | None = None, infer: bool = True) -> DataFrame:
    """CSV with header (types inferred unless `infer` is off) or Parquet, plus a row id.

    `row_id` names an existing key column to use instead of file positions.
    """
    base = path.rstrip("/").lower()
    if base.endswith((".csv", ".csv.gz")):
        df = spark.read.option("header", True).option("inferSchema", infer).csv(path)
    elif base.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported table format: {path}")
    if row_id:
        return df.withColumn(ROW_ID, c(row_id).cast("long"))
    return with_file_row_id(df)


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    out = df.drop(ROW_ID).write.mode("overwrite")
    out.option("header", True).csv(path) if fmt == "csv" else out.parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """Report rows as JSON lines."""
    report.write.mode("overwrite").json(path)


def write_stats_row(stats: dict | DataFrame, path: str, spark: SparkSession | None = None) -> DataFrame:
    """One row of counters or metrics as CSV; returns the row."""
    df = stats if isinstance(stats, DataFrame) else spark.createDataFrame([stats])
    df.write.mode("overwrite").option("header", True).csv(path)
    return df


def read_image_labels(spark: SparkSession, path: str, target: str) -> DataFrame | None:
    """(name, label) with the first column as image name; None when the target is absent."""
    df = spark.read.option("header", True).csv(path)
    if target not in df.columns:
        return None
    return with_file_row_id(spark.read.option("header", True).csv(path)).select(
        c(df.columns[0]).alias("name"), c(target).alias("label"), ROW_ID)
