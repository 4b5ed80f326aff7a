"""Duplicate rows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.columns import ROW_ID, c, row_fingerprint


def _first_ids(df: DataFrame, cols: list[str]) -> DataFrame:
    """Smallest row id per fingerprint. Copies collapse map-side, so a hot group stays cheap."""
    return df.groupBy(row_fingerprint(cols).alias("_fp")).agg(
        F.min(ROW_ID).alias(ROW_ID), F.count("*").alias("copies")
    )


def dedup_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Keep the first copy (smallest row id) of every distinct row."""
    cols = cols or [n for n in df.columns if n != ROW_ID]
    return df.join(_first_ids(df, cols).select(ROW_ID), ROW_ID, "left_semi")


def duplicate_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Row ids of all copies except the first."""
    cols = cols or [n for n in df.columns if n != ROW_ID]
    return df.select(ROW_ID).join(_first_ids(df, cols).select(ROW_ID), ROW_ID, "left_anti")


def duplicate_count(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or [n for n in df.columns if n != ROW_ID]
    return _first_ids(df, cols).agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_count")
    )


def append_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def zip_columns(x: DataFrame, y: DataFrame) -> DataFrame:
    """Put the columns of both tables side by side, matched on the row id."""
    return x.join(y, ROW_ID)


def label_union(a: DataFrame, b: DataFrame, label: str) -> DataFrame:
    return a.select(c(label).alias("label")).union(b.select(c(label).alias("label"))).distinct()
