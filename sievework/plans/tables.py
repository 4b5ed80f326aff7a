"""Whole-table jobs: cleaning with report, and the side-by-side model run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.columns import ROW_ID
from sievework.operators import dedup, encode, impute, outliers, profile, rules, synth, train
from sievework.operators.outliers import inverse_standardize
from sievework.session import cut


@dataclass
class CleanedTable:
    """Cleaned rows, inferred types, report rows and the detail tables behind them."""

    df: DataFrame
    types: dict[str, str]
    report: DataFrame
    missing: DataFrame
    invalid: DataFrame
    duplicates: DataFrame
    outliers: DataFrame


def clean_table(
    df: DataFrame, rule_source: str | dict | None = None, synthesize: bool = False, seed: int = 42, knn_k: int = 5,
    eps: float = 0.5, min_samples: int = 5,
) -> CleanedTable:
    """Rules, missing report, types, imputation, duplicates, outliers, report, optional new rows."""
    source = cut(rules.apply_rules(df, rules.load_rules(rule_source)))
    missing = profile.missing_report(source)
    checked = profile.validate_types(source)
    filled = cut(impute.impute(checked.df, checked.types, knn_k))
    unique = cut(dedup.dedup_rows(filled))
    repeats = dedup.duplicate_rows(filled)
    kept, noise = outliers.remove_outliers(unique, checked.types, eps, min_samples)
    kept = cut(kept)
    report = profiling_report(source, filled, unique, kept, missing, checked.report)
    out = synth.synthesize(kept, 0.2, seed) if synthesize else kept
    return CleanedTable(out, checked.types, report, profile.missing_rows(source), checked.invalid_rows, repeats, noise)


def profiling_report(source, filled, unique, kept, missing, types) -> DataFrame:
    """(section, item, value): shapes, duplicates, missing values, type checks and outliers."""
    row = lambda df, name: df.agg(F.count("*").cast("double").alias("value")).select(F.lit("shape").alias("section"), F.lit(name).alias("item"), "value")
    parts = [row(source, "original_rows"), row(filled, "typed_rows"), row(unique, "unique_rows"), row(kept, "processed_rows")]
    shapes = parts[0]
    for p in parts[1:]:
        shapes = shapes.unionByName(p)
    counts = shapes.groupBy().pivot("item", ["original_rows", "typed_rows", "unique_rows", "processed_rows"]).agg(F.max("value"))
    derived = counts.selectExpr("""inline(array(
        struct('duplicates' AS section, 'duplicate_count' AS item, typed_rows - unique_rows AS value),
        struct('outliers' AS section, 'outliers_removed' AS item, unique_rows - processed_rows AS value),
        struct('outliers' AS section, 'outlier_percentage' AS item, IF(unique_rows > 0, round((unique_rows - processed_rows) / unique_rows * 100, 2), 0D) AS value)))""")
    lost = missing.selectExpr("'missing' AS section", "column_name AS item", "CAST(total_missing AS DOUBLE) AS value")
    bad = types.selectExpr("concat('type_', inferred_type) AS section", "column_name AS item", "CAST(invalid_entries_count AS DOUBLE) AS value")
    return shapes.unionByName(derived).unionByName(lost).unionByName(bad)


def _path(prepared: encode.Prepared, model: str, task: str, test: float, seed: int) -> DataFrame:
    data = cut(train.assemble(prepared.df, prepared.features, prepared.target))
    a, b = train.split(data, test, seed)
    _, pred = train.fit_predict(a, b, model, task)
    if task == "prediction" and prepared.target_stat:
        back = lambda n: inverse_standardize(F.col(n), prepared.target_stat).alias(n)
        pred = pred.select(ROW_ID, back("label"), back("prediction"))
    return cut(pred)


def run_model(raw: DataFrame, model: str, target: str, task: str, test: float = 0.2, seed: int = 42, **clean) -> DataFrame:
    """Metrics of one model on the cleaned and on the conventionally prepared data."""
    rules.require_columns(raw, [target])
    known = train.REGRESSORS if task == "prediction" else train.CLASSIFIERS
    if model not in known:
        raise ValueError(f"model {model} not available for {task}; choose from {known}")
    cleaned = clean_table(raw, **clean).df
    ready = encode.transform(rules.drop_null_target(cleaned, target), target, task)
    plain = encode.baseline_prepare(raw, target, task)
    rows = None
    for side, prepared in (("cleaned", ready), ("conventional", plain)):
        pred = _path(prepared, model, task, test, seed)
        measured = train.regression_metrics(pred) if task == "prediction" else train.classification_metrics(pred)
        row = measured.select(F.lit(side).alias("side"), F.lit(model).alias("model"), "*")
        rows = row if rows is None else rows.unionByName(row)
    return rows


