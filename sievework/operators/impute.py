"""Imputation: column statistics, row-order fills and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.columns import ROW_ID, c
from sievework.operators.knn import nearest
from sievework.operators.ordering import exact_quantiles
from sievework.operators.profile import unpivot
from sievework.session import checkpointed, cut

# Fixed values of the imputation policy.
HIGH_MISSING_PCT = 5.0
SKEW_LIMIT = 0.5


def _fill(df: DataFrame, values: dict) -> DataFrame:
    known = {n: v for n, v in values.items() if v is not None}
    return df.select(*[
        F.coalesce(c(n), F.lit(known[n])).alias(n) if n in known else c(n) for n in df.columns
    ])


def means(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    row = df.agg(*[F.avg(c(n)).alias(str(i)) for i, n in enumerate(cols)]).first()
    return dict(zip(cols, row))


def fill_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    return _fill(df, means(df, cols)) if cols else df


def fill_median(df: DataFrame, cols: list[str]) -> DataFrame:
    found = exact_quantiles(df, {n: [0.5] for n in cols})
    return _fill(df, {n: v[0] for n, v in found.items()})


def fill_by_skew(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns under the missing limit: median when the population skew is large, else mean."""
    if not cols:
        return df
    aggs = [F.count("*").alias("n")]
    for i, n in enumerate(cols):
        aggs += [F.skewness(c(n)).alias(f"s{i}"), F.avg(c(n)).alias(f"m{i}"), F.count(c(n)).alias(f"k{i}")]
    got = df.agg(*aggs).first()
    low = [i for i, n in enumerate(cols) if got.n and (1 - got[f"k{i}"] / got.n) * 100 < HIGH_MISSING_PCT]
    skewed = [i for i in low if got[f"s{i}"] is not None and abs(got[f"s{i}"]) > SKEW_LIMIT]
    medians = exact_quantiles(df, {cols[i]: [0.5] for i in skewed})
    values = {cols[i]: got[f"m{i}"] for i in low}
    values.update({n: v[0] for n, v in medians.items()})
    return _fill(df, values)


def modes(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """Most frequent value per column as text; ties go to the smallest value of the column type."""
    values = {}
    counts = None
    for n in cols:
        part = df.filter(c(n).isNotNull()).groupBy(c(n).alias("v")).agg(F.count("*").alias("k"))
        best = part.agg(F.min_by("v", F.struct(-F.col("k"), "v")).cast("string").alias("v"))
        row = best.select(F.lit(n).alias("col"), "v")
        counts = row if counts is None else counts.unionByName(row)
    if counts is not None:
        values = {r["col"]: r["v"] for r in counts.collect()}  # one row per column
    return values


def fill_mode(df: DataFrame, cols: list[str], when_empty: str | None = None) -> DataFrame:
    """Fill with the mode; columns without any value stay as they are or take `when_empty`."""
    found = modes(df, cols)
    types = dict(df.dtypes)
    out = []
    for n in df.columns:
        value = found.get(n) if n in cols else None
        if n in cols and value is None:
            value = when_empty
        out.append(F.coalesce(c(n), F.lit(value).cast(types[n])).alias(n) if value is not None else c(n))
    return df.select(*out)


def fill_forward_backward(df: DataFrame, cols: list[str]) -> DataFrame:
    """Forward fill, then backward fill, in row-id order.

    Rows are range-partitioned once; each partition is summarised by its first and last known
    values and only these summaries (one row per partition) are carried across partitions.
    """
    stored = checkpointed(df.repartitionByRange(F.col(ROW_ID))).withColumn("_pid", F.spark_partition_id())
    aggs = []
    for i, n in enumerate(cols):
        known = F.when(c(n).isNotNull(), F.col(ROW_ID))
        aggs += [F.max_by(c(n), known).alias(f"_last{i}"), F.min_by(c(n), known).alias(f"_first{i}")]
    ends = stored.groupBy("_pid").agg(F.min(ROW_ID).alias("_lo"), *aggs)
    before = W.orderBy("_lo").rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy("_lo").rowsBetween(1, W.unboundedFollowing)
    carry = ends.select(
        "_pid",
        *[F.last(f"_last{i}", ignorenulls=True).over(before).alias(f"_prev{i}") for i in range(len(cols))],
        *[F.first(f"_first{i}", ignorenulls=True).over(after).alias(f"_next{i}") for i in range(len(cols))],
    )
    joined = stored.join(carry, "_pid")
    up = W.partitionBy("_pid").orderBy(ROW_ID).rowsBetween(W.unboundedPreceding, 0)
    # Looking ahead is looking back in descending order, which Spark evaluates in linear time.
    down = W.partitionBy("_pid").orderBy(F.desc(ROW_ID)).rowsBetween(W.unboundedPreceding, 0)
    filled = []
    for n in df.columns:
        if n not in cols:
            filled.append(c(n))
            continue
        i = cols.index(n)
        filled.append(
            F.coalesce(
                F.last(c(n), ignorenulls=True).over(up), F.col(f"_prev{i}"),
                F.last(c(n), ignorenulls=True).over(down), F.col(f"_next{i}"),
            ).alias(n)
        )
    return joined.select(*filled)


def fill_knn(df: DataFrame, cols: list[str], k: int = 5) -> DataFrame:
    """Mean of the k nearest rows that know the column, on z-scaled values, in original units.

    A row without any comparable donor takes the column mean. The rows are stored first: every search reads
    them several times and would run the steps behind them again.
    """
    df = cut(df)
    aggs = []
    for i, n in enumerate(cols):
        aggs += [F.avg(c(n)).alias(f"m{i}"), F.stddev_pop(c(n)).alias(f"s{i}"),
                 (F.count("*") - F.count(c(n))).alias(f"k{i}")]
    got = df.agg(*aggs).first()
    if all(got[f"m{i}"] is None for i in range(len(cols))):
        return df
    usable = [i for i in range(len(cols)) if got[f"m{i}"] is not None]
    scaled = [((c(cols[i]).cast("double") - got[f"m{i}"]) / (got[f"s{i}"] or 1.0)).alias(f"z{i}") for i in usable]
    points = df.select(ROW_ID, *scaled)
    out = df
    for i in usable:
        n, others = cols[i], [f"z{j}" for j in usable if j != i]
        if not got[f"k{i}"]:
            continue
        if not others:
            out = out.withColumn(n, F.coalesce(c(n), F.lit(got[f"m{i}"])))
            continue
        donors = points.filter(f"z{i} is not null").select(*others, F.col(f"z{i}").alias("value"))
        queries = points.filter(f"z{i} is null").select(F.col(ROW_ID).alias("query_id"), *others)
        # Scaling by one more column than `others`: the distance factor is common to all donors
        # of equal overlap, and overlap is counted the same way, so the ranking is unchanged.
        near = nearest(queries, donors, others, k)
        guess = near.groupBy("query_id").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("_z"))
        value = F.col("_z") * F.lit(got[f"s{i}"] or 1.0) + F.lit(got[f"m{i}"])
        out = (
            out.join(guess.withColumnRenamed("query_id", ROW_ID), ROW_ID, "left")
            .withColumn(n, F.coalesce(c(n), value, F.lit(got[f"m{i}"])))
            .drop("_z")
        )
    return out.select(*[c(n) for n in df.columns])


def fill_knn_all(df: DataFrame, numeric: list[str], categorical: list[str], k: int = 7) -> DataFrame:
    return fill_mode(fill_knn(df, numeric, k), categorical)


def missing_share(df: DataFrame, cols: list[str]) -> dict[str, float]:
    row = df.agg(F.count("*").alias("n"), *[F.count(c(n)).alias(f"k{i}") for i, n in enumerate(cols)]).first()
    return {n: (1 - row[f"k{i}"] / row.n) * 100 if row.n else 0.0 for i, n in enumerate(cols)}


def impute(df: DataFrame, types: dict[str, str], k: int = 5) -> DataFrame:
    """Policy: datetime by order, object by mode, numbers by neighbours or by a column statistic."""
    numeric = [n for n, t in types.items() if t in ("int", "float")]
    share = missing_share(df, list(types))
    high = [n for n in numeric if share[n] >= HIGH_MISSING_PCT]
    low = [n for n in numeric if 0 < share[n] < HIGH_MISSING_PCT]
    dates = [n for n, t in types.items() if t == "datetime" and share[n] > 0]
    texts = [n for n, t in types.items() if t == "object" and share[n] > 0]
    out = fill_by_skew(df, low)
    out = fill_mode(out, texts) if texts else out
    out = fill_forward_backward(out, dates) if dates else out
    return cut(fill_knn(out, high, k)) if high else out


def missing_cells(df: DataFrame, cols: list[str]) -> DataFrame:
    """Remaining nulls per column after imputation."""
    long = unpivot(df, {n: c(n).isNull().cast("long") for n in cols})
    return long.groupBy("column_name").agg(F.sum("value").alias("missing"))
