"""Profiling, type inference and validation. Statistics of all columns share one aggregate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.columns import (
    ROW_ID,
    c,
    clean_text,
    extract_numeric,
    parse_boolean,
    parse_datetime,
)
from sievework.operators.ordering import exact_quantiles

# Fixed value: above this share of distinct numbers a column is numeric, below it is coded text.
DISTINCT_RATIO = 0.2


def data_columns(df: DataFrame) -> list[str]:
    return [n for n in df.columns if n != ROW_ID]


def unpivot(df: DataFrame, exprs: dict[str, Column], keys: list[str] | None = None,
            name: str = "column_name", value: str = "value") -> DataFrame:
    """Long table (keys, name, value) from one pass over the rows."""
    pairs = F.array(*[
        F.struct(F.lit(n).alias(name), e.alias(value)) for n, e in exprs.items()
    ])
    keep = [c(k) for k in keys or []]
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, f"_p.{name}", f"_p.{value}")


def stat_rows(row_df: DataFrame, names: list[str], stats: list[str]) -> DataFrame:
    """Turn the one-row aggregate with fields `<stat>__<i>` into one row per column."""
    items = [
        F.struct(F.lit(n).alias("column_name"), *[F.col(f"{s}__{i}").alias(s) for s in stats])
        for i, n in enumerate(names)
    ]
    return row_df.select(F.explode(F.array(*items)).alias("_s")).select("_s.*")


def load_report(df: DataFrame) -> DataFrame:
    """One row per column: position plus the table's row and column totals."""
    names = data_columns(df)
    positions = F.array(*[
        F.struct(F.lit(n).alias("column_name"), F.lit(i).alias("position"))
        for i, n in enumerate(names)
    ])
    return (
        df.agg(F.count("*").alias("total_rows"))
        .select("total_rows", F.lit(len(names)).alias("total_columns"), F.explode(positions).alias("_c"))
        .select("_c.column_name", "_c.position", "total_rows", "total_columns")
    )


def categorize_columns(df: DataFrame) -> dict[str, str]:
    """Role of every column by type; text that parses completely as dates stays categorical."""
    roles = {}
    for f in df.schema.fields:
        if f.name == ROW_ID:
            continue
        if isinstance(f.dataType, T.NumericType):
            roles[f.name] = "numeric"
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            roles[f.name] = "datetime"
        else:
            roles[f.name] = "categorical"
    return roles


def roles_table(df: DataFrame) -> DataFrame:
    """`categorize_columns` as rows, with the non-null count behind each role."""
    roles = categorize_columns(df)
    names = list(roles)
    row = df.agg(*[F.count(c(n)).alias(f"non_null__{i}") for i, n in enumerate(names)])
    role = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(roles[n]))])
    return stat_rows(row, names, ["non_null"]).withColumn("role", role[F.col("column_name")])


def categorical_domains(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Distinct non-null values per categorical column as a table, never a collected set."""
    if cols is None:
        cols = [n for n, r in categorize_columns(df).items() if r == "categorical"]
    long = unpivot(df, {n: c(n).cast("string") for n in cols})
    return long.filter("value is not null").distinct()


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    long = unpivot(df, {n: c(n).cast("string") for n in cols})
    return long.filter("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, cols: list[str], k: int = 5) -> DataFrame:
    """The k most frequent values per column; ties go to the smaller text."""
    w = W.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return value_counts(df, cols).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def profile(df: DataFrame, quantiles: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Minimal per-column profile, one row per column."""
    roles = categorize_columns(df)
    names = list(roles)
    numeric = [n for n in names if roles[n] == "numeric"]
    total = F.count("*")
    null = F.lit(None).cast("double")
    aggs = [total.alias("_total")]
    for i, n in enumerate(names):
        x = c(n).cast("double") if n in numeric else null
        text = F.length(c(n).cast("string")) if roles[n] == "categorical" else F.lit(None).cast("int")
        aggs += [
            total.alias(f"n_rows__{i}"),
            (total - F.count(c(n))).alias(f"n_missing__{i}"),
            F.min(x).alias(f"min__{i}"),
            F.max(x).alias(f"max__{i}"),
            F.avg(x).alias(f"mean__{i}"),
            F.stddev_samp(x).alias(f"std__{i}"),
            F.var_samp(x).alias(f"variance__{i}"),
            F.skewness(x).alias(f"skewness__{i}"),
            F.kurtosis(x).alias(f"kurtosis__{i}"),
            F.sum((x == 0).cast("long")).alias(f"n_zeros__{i}"),
            F.sum((x < 0).cast("long")).alias(f"n_negative__{i}"),
            F.min(text).alias(f"min_length__{i}"),
            F.max(text).alias(f"max_length__{i}"),
            F.avg(text).alias(f"mean_length__{i}"),
        ]
    row = df.agg(*aggs)
    stats = ["n_rows", "n_missing", "min", "max", "mean", "std", "variance", "skewness", "kurtosis",
             "n_zeros", "n_negative", "min_length", "max_length", "mean_length"]
    table = stat_rows(row, names, stats).withColumn(
        "missing_pct", F.round(F.col("n_missing") / F.col("n_rows") * 100, 2)
    )
    distinct = value_counts(df, names).groupBy("column_name").agg(F.count("*").alias("n_distinct"))
    table = table.join(distinct, "column_name", "left").withColumn(
        "n_distinct", F.coalesce("n_distinct", F.lit(0))
    )
    found = exact_quantiles(df, {n: list(quantiles) for n in numeric})
    for j, p in enumerate(quantiles):
        col = F.lit(None).cast("double")
        for n in numeric:
            col = F.when(F.col("column_name") == n, F.lit(found[n][j])).otherwise(col)
        table = table.withColumn(f"p{round(p * 100):02d}", col)
    return table


def require_rows(df: DataFrame) -> DataFrame:
    """Profiling an empty table is an error."""
    if df.isEmpty():
        raise ValueError("cannot profile an empty table")
    return df


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with at least one null: count and percentage rounded to two places."""
    names = data_columns(df)
    aggs = []
    for i, n in enumerate(names):
        aggs += [(F.count("*") - F.count(c(n))).alias(f"total_missing__{i}"),
                 F.count("*").alias(f"_n__{i}")]
    return (
        stat_rows(df.agg(*aggs), names, ["total_missing", "_n"])
        .filter("total_missing > 0")
        .withColumn("missing_percentage", F.round(F.col("total_missing") / F.col("_n") * 100, 2))
        .drop("_n")
    )


def missing_rows(df: DataFrame) -> DataFrame:
    """(column, row id) of every null cell."""
    return (
        unpivot(df, {n: c(n).isNull() for n in data_columns(df)}, [ROW_ID])
        .filter("value").drop("value")
    )


def infer_boolean(df: DataFrame, cols: list[str]) -> DataFrame:
    """Whether every non-null value reads as a boolean."""
    aggs = [F.coalesce(F.min(parse_boolean(c(n)).isNotNull() | c(n).isNull()) & (F.count(c(n)) > 0),
                       F.lit(False)).alias(f"is_boolean__{i}") for i, n in enumerate(cols)]
    return stat_rows(df.agg(*aggs), cols, ["is_boolean"])


def infer_numeric_kind(df: DataFrame, cols: list[str]) -> DataFrame:
    """int / float when the distinct share is above the threshold, object otherwise."""
    long = unpivot(df, {n: extract_numeric(c(n)) for n in cols})
    per_value = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    stats = per_value.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        F.count("value").alias("n_distinct"),
        F.coalesce(F.min(F.col("value").isNotNull() & (F.col("value") == F.floor("value"))), F.lit(False)).alias("integral"),
    )
    numeric = F.col("n_distinct") / F.col("n_rows") > DISTINCT_RATIO
    kind = F.when(numeric & F.col("integral"), "int").when(numeric, "float").otherwise("object")
    return stats.select("column_name", "n_rows", "n_distinct", kind.alias("kind"))


def infer_datetime(df: DataFrame, cols: list[str], formats: list[str] | None = None) -> DataFrame:
    """Whether the whole text column parses as date-times."""
    aggs = [F.coalesce(F.min(parse_datetime(c(n), formats).isNotNull() | c(n).isNull()) & (F.count(c(n)) > 0),
                       F.lit(False)).alias(f"is_datetime__{i}") for i, n in enumerate(cols)]
    return stat_rows(df.agg(*aggs), cols, ["is_datetime"])


@dataclass
class Validated:
    """Converted table, inferred type per column, summary rows and the invalid cells."""

    df: DataFrame
    types: dict[str, str]
    report: DataFrame
    invalid_rows: DataFrame
    stats: dict[str, dict] = field(default_factory=dict)


def validate_types(
    df: DataFrame, formats: list[str] | None = None, min_parse: float = 0.5
) -> Validated:
    """Infer boolean, int, float, datetime or object per column and convert the values.

    Columns the reader already typed keep their type. A text column becomes numeric only when at
    least `min_parse` of its non-null values hold a number.
    """
    fields = [f for f in df.schema.fields if f.name != ROW_ID]
    text = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    numeric_typed = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    aggs = [F.count("*").alias("total")]
    for i, n in enumerate(text):
        num = extract_numeric(c(n))
        aggs += [
            F.count(c(n)).alias(f"present{i}"),
            F.count(parse_boolean(c(n))).alias(f"bool{i}"),
            F.count(num).alias(f"num{i}"),
            F.sum((num == F.floor(num)).cast("long")).alias(f"int{i}"),
            F.hll_sketch_estimate(F.hll_sketch_agg(num.cast("string"), 12)).alias(f"dist{i}"),
            F.count(parse_datetime(c(n), formats)).alias(f"date{i}"),
        ]
    for i, n in enumerate(numeric_typed):
        aggs.append(F.min(c(n) == F.floor(c(n))).alias(f"whole{i}"))
    got = df.agg(*aggs).first().asDict()
    total = got["total"]
    # The sketch decides clear cases; only columns near the threshold pay for an exact count.
    close = [i for i in range(len(text)) if total and 0.17 < (got[f"dist{i}"] or 0) / total < 0.23]
    if close:
        exact = df.agg(*[F.countDistinct(extract_numeric(c(text[i]))).alias(f"dist{i}") for i in close])
        got.update(exact.first().asDict())

    types: dict[str, str] = {}
    converted: dict[str, Column] = {}
    for f in fields:
        n = f.name
        if n in numeric_typed:
            types[n] = "int" if got[f"whole{numeric_typed.index(n)}"] else "float"
            converted[n] = c(n)
        elif n not in text:
            is_bool = isinstance(f.dataType, T.BooleanType)
            is_time = isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
            types[n] = "boolean" if is_bool else "datetime" if is_time else "object"
            converted[n] = c(n)
        else:
            i = text.index(n)
            present, num = got[f"present{i}"], got[f"num{i}"]
            if present and got[f"bool{i}"] == present:
                types[n], converted[n] = "boolean", parse_boolean(c(n))
            elif present and got[f"date{i}"] == present:
                types[n], converted[n] = "datetime", parse_datetime(c(n), formats)
            elif num and num >= min_parse * present:
                if (got[f"dist{i}"] or 0) / total <= DISTINCT_RATIO:
                    types[n], converted[n] = "object", extract_numeric(c(n))
                elif got[f"int{i}"] == num:
                    types[n], converted[n] = "int", extract_numeric(c(n)).cast("long")
                else:
                    types[n], converted[n] = "float", extract_numeric(c(n))
            else:
                types[n], converted[n] = "object", clean_text(c(n))
    keys = [ROW_ID] if ROW_ID in df.columns else []
    out = df.select(*keys, *[converted[f.name].alias(f.name) for f in fields])
    bad = {n: c(n).isNotNull() & converted[n].isNull() for n in types}
    type_of = F.create_map(*[x for n, t in types.items() for x in (F.lit(n), F.lit(t))])
    names = list(types)
    report = stat_rows(
        df.agg(*[F.sum(bad[n].cast("long")).alias(f"invalid_entries_count__{i}") for i, n in enumerate(names)]),
        names, ["invalid_entries_count"],
    ).withColumn("inferred_type", type_of[F.col("column_name")])
    invalid = unpivot(df, bad, keys).filter("value").drop("value")
    return Validated(out, types, report, invalid, {"total": total})


def value_distribution(df: DataFrame, col: str) -> DataFrame:
    """Count per label with the max/min imbalance ratio and the unknown share."""
    label = F.coalesce(c(col).cast("string"), F.lit("Unknown"))
    counts = df.select(label.alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    unknown = F.lower("label").isin("unknown", "nan")
    summary = counts.agg(
        F.max("n").alias("_max"), F.min("n").alias("_min"), F.sum("n").alias("_all"),
        F.sum(F.when(unknown, F.col("n")).otherwise(0)).alias("_unknown"),
    )
    # `summary` is a single row by construction.
    return counts.join(F.broadcast(summary)).select(
        "label", "n",
        F.round(F.col("_max") / F.col("_min"), 6).alias("imbalance_ratio"),
        (F.col("_max") / F.col("_min") > 10).alias("imbalanced"),
        F.round((F.col("_all") - F.col("_unknown")) / F.col("_all") * 100, 4).alias("match_rate"),
    )


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles."""
    aggs = []
    for i, n in enumerate(cols):
        x = c(n).cast("double")
        aggs += [F.count(x).alias(f"count__{i}"), F.avg(x).alias(f"mean__{i}"),
                 F.stddev_samp(x).alias(f"std__{i}"), F.min(x).alias(f"min__{i}"), F.max(x).alias(f"max__{i}")]
    table = stat_rows(df.agg(*aggs), cols, ["count", "mean", "std", "min", "max"])
    found = exact_quantiles(df, {n: [0.25, 0.5, 0.75] for n in cols})
    for j, name in enumerate(["p25", "p50", "p75"]):
        col = F.lit(None).cast("double")
        for n in cols:
            col = F.when(F.col("column_name") == n, F.lit(found[n][j])).otherwise(col)
        table = table.withColumn(name, col)
    return table


def removal_summary(df: DataFrame, before: str, after: str, steps: list[str]) -> DataFrame:
    """Cleaning counters with removed totals and percentages, guarded against an empty start."""
    pct = lambda part: F.round(F.when(c(before) > 0, part / c(before) * 100).otherwise(0.0), 2)
    return df.select(
        "*", (c(before) - c(after)).alias("removed"), pct(c(before) - c(after)).alias("removed_pct"),
        *[pct(c(s)).alias(f"{s}_pct") for s in steps],
    )
