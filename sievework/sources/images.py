"""Image folder source and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes read as images.
SUFFIXES = [".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".webp"]


def _suffix_ok(col: str):
    low = F.lower(F.col(col))
    ok = F.lit(False)
    for s in SUFFIXES:
        ok = ok | low.endswith(s)
    return ok


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file_size, height, width, channels, data) of all images below the folder.

    Files that do not decode stay in the table with empty dimensions.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        .select("path", F.col("length").alias("file_size")).filter(_suffix_ok("path"))
    )
    img = (
        spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(folder)
        .select("image.*").filter("height > 0")
        .selectExpr("replace(origin, 'file:///', 'file:/') AS path", "height", "width", "nChannels AS channels", "data")
    )
    return files.join(img, "path", "left")


def write_clean_images(spark: SparkSession, manifest: DataFrame, folder: str, out: str) -> None:
    """Store (filename, content) of the surviving images as Parquet."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")
    kept = files.join(manifest.select("path"), "path", "left_semi")
    kept.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content").write.mode("overwrite").parquet(out)
