"""Evaluation metrics as plain aggregates over a predictions table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.columns import c
from sievework.operators.ordering import exact_quantiles
from sievework.session import cut, discard


def _ratio(top, bottom):
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0))


def regression_metrics(pred: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """MSE, RMSE, MAE, MAPE in percent, R2 and explained variance, one row."""
    y, e = c(actual).cast("double"), c(actual).cast("double") - c(predicted).cast("double")
    tiny = F.lit(2.220446049250313e-16)
    return pred.agg(
        F.count("*").alias("n"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.abs(e) / F.greatest(F.abs(y), tiny)) * 100).alias("mape"),
        F.when(F.var_pop(y) > 0, 1 - F.avg(e * e) / F.var_pop(y)).otherwise(0.0).alias("r2"),
        F.when(F.var_pop(y) > 0, 1 - F.var_pop(e) / F.var_pop(y)).otherwise(0.0).alias("explained_variance"),
    )


def pair_counts(pred: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    return pred.groupBy(
        c(actual).cast("string").alias("label"), c(predicted).cast("string").alias("prediction")
    ).agg(F.count("*").alias("n"))


def classification_report(pred: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class; zero where a denominator is empty."""
    pairs = pair_counts(pred, actual, predicted)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("s"), F.lit(0).alias("p"), hit.alias("t")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).alias("s"), F.col("n").alias("p"), F.lit(0).alias("t")),
    ))
    sums = pairs.select(sides.alias("x")).groupBy("x.class").agg(
        F.sum("x.s").alias("support"), F.sum("x.p").alias("_p"), F.sum("x.t").alias("_t")
    )
    rated = sums.withColumn("precision", _ratio(F.col("_t"), F.col("_p"))).withColumn(
        "recall", _ratio(F.col("_t"), F.col("support"))
    )
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rated.select("class", "precision", "recall", f1.alias("f1"), "support")


def classification_metrics(pred: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """One row: accuracy with macro and support-weighted averages."""
    r = classification_report(pred, actual, predicted)
    weighted = lambda m: (F.sum(F.col(m) * F.col("support")) / F.sum("support"))
    return r.agg(
        weighted("recall").alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[weighted(m).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")],
        F.sum("support").alias("support"),
    )


def confusion_matrix(pred: DataFrame, labels: list[str], actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """Dense matrix over the given label set, zero-filled."""
    pairs = pair_counts(pred, actual, predicted)
    every = pred.sparkSession.createDataFrame([(l,) for l in labels], "label string")
    wide = pairs.groupBy("label").pivot("prediction", labels).agg(F.sum("n"))
    return every.join(wide, "label", "left").select(
        "label", *[F.coalesce(c(l), F.lit(0)).alias(f"pred_{l}") for l in labels]
    )


def confusion_cells(pred: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """Long form of the matrix: non-empty cells only, for label sets too large to pivot."""
    return pair_counts(pred, actual, predicted)


def mean_f1(report: DataFrame) -> DataFrame:
    return report.agg(F.avg("f1").alias("mean_f1"))


# Distinct scores that one task of the area ranks.
SCORES_PER_RANGE = 1_000_000


def roc_auc(pred: DataFrame, label: str = "label", score: str = "score", per_range: int = SCORES_PER_RANGE) -> DataFrame:
    """Exact rank-sum area for 0/1 labels; null unless both classes occur. Rows without a score are left out.

    Equal scores are merged first, so no key is hot. The running counts are then taken in two levels: inside
    sorted ranges cut at sampled quantiles, about `per_range` distinct scores each however scores are spread,
    and over the ranges.
    """
    by_score = cut(pred.groupBy(c(score).cast("double").alias("s")).agg(
        F.sum((c(label) == 1).cast("long")).alias("pos"), F.sum((c(label) != 1).cast("long")).alias("neg")
    ).filter("s IS NOT NULL"))
    ranges = by_score.count() // per_range + 1
    placed = cut(by_score.repartitionByRange(ranges, "s").withColumn("b", F.spark_partition_id()))
    discard(by_score)
    # One row a range: their number follows the distinct scores divided by `per_range`.
    per = placed.groupBy("b").agg(F.sum("neg").alias("bn"))
    before = per.select("b", (F.sum("bn").over(W.orderBy("b")) - F.col("bn")).alias("base"))
    inside = W.partitionBy("b").orderBy("s")
    won = (F.col("base") + F.sum("neg").over(inside) - F.col("neg")) + F.col("neg") / 2
    total = placed.join(before, "b").withColumn("w", F.col("pos") * won).agg(
        F.sum("w").alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return total.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p") * F.col("n"))).alias("roc_auc"))


def model_kind(train: DataFrame, label: str) -> DataFrame:
    n = train.agg(F.countDistinct(c(label)).alias("n_classes"))
    return n.select("n_classes", F.when(F.col("n_classes") == 2, "binary").otherwise("multiclass").alias("kind"))


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """(bin, lower, upper, n) over equal-width bins of the observed range; the last bin is closed."""
    x = df.select(c(col).cast("double").alias("x")).filter("x is not null")
    lo, hi = x.agg(F.min("x"), F.max("x")).first()
    if lo is None:
        return x.select(F.lit(0).alias("bin"), F.col("x").alias("lower"), F.col("x").alias("upper"), F.lit(0).alias("n")).limit(0)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    spot = F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)).cast("int")
    counts = x.groupBy(spot.alias("bin")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin", (F.lit(lo) + F.col("bin") * width).alias("lower"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def residuals(pred: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    return pred.withColumn("residual", c(actual) - c(predicted))


def residual_summary(pred: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """Quartiles, whisker bounds and moments of the residuals, one row."""
    r = residuals(pred, actual, predicted)
    q25, q50, q75 = exact_quantiles(r, {"residual": [0.25, 0.5, 0.75]})["residual"]
    iqr = q75 - q25
    return r.agg(F.count("*").alias("n"), F.avg("residual").alias("mean"), F.stddev_pop("residual").alias("std"),
                 F.min("residual").alias("min"), F.max("residual").alias("max")).select(
        "*", F.lit(q25).alias("q25"), F.lit(q50).alias("q50"), F.lit(q75).alias("q75"),
        F.lit(q25 - 1.5 * iqr).alias("lower_fence"), F.lit(q75 + 1.5 * iqr).alias("upper_fence"))


def compare_runs(original: DataFrame, cleaned: DataFrame, measures: tuple[str, ...] = ("accuracy",)) -> DataFrame:
    """Per model present on both sides: values, improvement and improvement percent."""
    a, b = original.alias("a"), cleaned.alias("b")
    cols = []
    for m in measures:
        gain = F.col(f"b.{m}") - F.col(f"a.{m}")
        cols += [F.col(f"a.{m}").alias(f"original_{m}"), F.col(f"b.{m}").alias(f"cleaned_{m}"), gain.alias(f"{m}_improvement"),
                 F.when(F.col(f"a.{m}") > 0, gain / F.col(f"a.{m}") * 100).otherwise(0.0).alias(f"{m}_improvement_pct")]
    return a.join(b, "model").select("model", *cols)


def best_model(comparison: DataFrame, measure: str = "accuracy") -> DataFrame:
    gain = F.col(f"{measure}_improvement")
    # Equal gains resolve to the smaller model name.
    return comparison.agg(
        F.avg(gain).alias("mean_improvement"),
        F.min_by("model", F.struct(-gain, F.col("model"))).alias("best_model"),
        F.min_by("model", F.struct(gain, F.col("model"))).alias("worst_model"),
    )
