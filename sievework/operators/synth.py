"""Distribution-aware synthetic rows with a Gaussian copula."""

from __future__ import annotations

import logging

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.columns import ROW_ID, c, clip_to_range, seeded_uniform
from sievework.operators.dedup import append_rows
from sievework.operators.profile import stat_rows, unpivot

log = logging.getLogger(__name__)
# Knots of the stored quantile function per numeric column.
KNOTS = 101


def synthesis_roles(df: DataFrame) -> dict[str, str]:
    """categorical for text and booleans, numeric for numbers, other for the rest."""
    roles = {}
    for f in df.schema.fields:
        if f.name != ROW_ID:
            text = isinstance(f.dataType, (T.StringType, T.BooleanType))
            roles[f.name] = "categorical" if text else "numeric" if isinstance(f.dataType, T.NumericType) else "other"
    return roles


def _normal_quantile(u: Column) -> Column:
    """Inverse normal CDF through the logistic-free rational form of Abramowitz and Stegun 26.2.23."""
    p = F.least(u, 1 - u)
    t = F.sqrt(-2 * F.log(p))
    # Coefficients of the published approximation.
    num = F.lit(2.515517) + 0.802853 * t + 0.010328 * t * t
    den = F.lit(1.0) + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t
    z = t - num / den
    return F.when(u < 0.5, -z).otherwise(z)


def _normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 26.2.17."""
    x = F.abs(z)
    t = 1 / (1 + F.lit(0.2316419) * x)
    # Coefficients of the published approximation.
    poly = t * (F.lit(0.319381530) + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / F.lit(2.5066282746310002) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def _position(x: Column, knots: list[float]) -> Column:
    """Piecewise-linear CDF of a value on its quantile knots, inside (0, 1)."""
    arr = F.array(*[F.lit(float(k)) for k in knots])
    below = F.size(F.filter(arr, lambda k: k <= x))
    i = F.greatest(F.least(below, F.lit(len(knots) - 1)), F.lit(1))
    lo, hi = F.element_at(arr, i), F.element_at(arr, i + 1)
    frac = F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(0.5)
    u = (i - 1 + F.least(F.greatest(frac, F.lit(0.0)), F.lit(1.0))) / F.lit(len(knots) - 1)
    return F.least(F.greatest(u, F.lit(1e-4)), F.lit(1 - 1e-4))


def _value_at(u: Column, knots: list[float]) -> Column:
    arr = F.array(*[F.lit(float(k)) for k in knots])
    spot = u * (len(knots) - 1)
    i = F.least(F.floor(spot), F.lit(len(knots) - 2)).cast("int")
    lo, hi = F.element_at(arr, i + 1), F.element_at(arr, i + 2)
    return lo + (hi - lo) * (spot - i)


def synthesize(df: DataFrame, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """The source plus int(n * fraction) new rows; on failure the source unchanged."""
    try:
        return append_rows(df, synthetic_rows(df, fraction, seed))
    except Exception as err:
        log.warning("synthesis skipped: %s", err)
        return df


def synthetic_rows(df: DataFrame, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    roles = synthesis_roles(df)
    numeric = [n for n, r in roles.items() if r == "numeric"]
    texts = [n for n, r in roles.items() if r == "categorical"]
    types = dict(df.dtypes)
    probs = [i / (KNOTS - 1) for i in range(KNOTS)]
    has_id = ROW_ID in df.columns
    aggs = [F.count("*").alias("n"), (F.max(ROW_ID) if has_id else F.lit(0)).alias("top")]
    for i, n in enumerate(numeric):
        aggs += [F.percentile_approx(c(n).cast("double"), probs, 10_000).alias(f"q{i}"), F.min(c(n)).alias(f"lo{i}"), F.max(c(n)).alias(f"hi{i}")]
    got = df.agg(*aggs).first()
    wanted = int(got.n * fraction)
    spark = df.sparkSession
    base = spark.range(wanted).select(F.col("id").alias("_k"))
    live = [i for i in range(len(numeric)) if got[f"q{i}"]]
    if live:
        scores = df.select(*[
            F.coalesce(_normal_quantile(_position(c(numeric[i]).cast("double"), got[f"q{i}"])), F.lit(0.0)).alias(f"z{i}")
            for i in live
        ])
        vec = VectorAssembler(inputCols=[f"z{i}" for i in live], outputCol="v").transform(scores).select("v")
        # A columns-by-columns matrix: its size follows the schema, not the data.
        corr = np.nan_to_num(Correlation.corr(vec, "v").head()[0].toArray())
        np.fill_diagonal(corr, 1.0)
        vals, vecs = np.linalg.eigh((corr + corr.T) / 2)
        mix = vecs * np.sqrt(np.clip(vals, 0.0, None))
        base = base.select("_k", *[_normal_quantile(seeded_uniform(seed + 1 + j, F.col("_k"))).alias(f"g{j}") for j in range(len(live))])
        norm = np.sqrt((mix**2).sum(axis=1))
        latent = [sum((F.col(f"g{j}") * float(mix[a, j] / (norm[a] or 1.0)) for j in range(1, len(live))), F.col("g0") * float(mix[a, 0] / (norm[a] or 1.0))) for a in range(len(live))]
        base = base.select("_k", *[
            clip_to_range(_value_at(_normal_cdf(z), got[f"q{i}"]), got[f"lo{i}"], got[f"hi{i}"], types[numeric[i]]).alias(f"x{i}")
            for i, z in zip(live, latent)
        ])
    for t, n in enumerate(texts):
        base = _draw_category(df, base, n, seed + 1000 + t, f"t{t}")
    cols = []
    for n in df.columns:
        if n == ROW_ID:
            cols.append((F.col("_k") + got.top + 1).alias(ROW_ID))
        elif n in numeric and numeric.index(n) in live:
            cols.append(F.col(f"x{numeric.index(n)}").alias(n))
        elif n in texts:
            cols.append(F.col(f"t{texts.index(n)}").cast(types[n]).alias(n))
        else:
            cols.append(F.lit(None).cast(types[n]).alias(n))
    return base.select(*cols)


def _draw_category(df: DataFrame, base: DataFrame, col: str, seed: int, out: str) -> DataFrame:
    """Draw observed values by frequency: intervals of the running share, met on 1/1024 slots."""
    slots = 1024
    counts = df.filter(c(col).isNotNull()).groupBy(c(col).alias("v")).agg(F.count("*").alias("n"))
    # Slot by value hash, so that the running sums need no global sort.
    placed = counts.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(slots)))
    per = placed.groupBy("_s").agg(F.sum("n").alias("m"))
    lead = per.select("_s", (F.sum("m").over(W.orderBy("_s")) - F.col("m")).alias("base"), F.sum("m").over(W.partitionBy()).alias("all"))
    upto = F.col("base") + F.sum("n").over(W.partitionBy("_s").orderBy("v"))
    spans = placed.join(lead, "_s").select("v", ((upto - F.col("n")) / F.col("all")).alias("a"), (upto / F.col("all")).alias("b"))
    spans = spans.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("a") * slots), F.floor(F.col("b") * slots))))
    drawn = base.withColumn("_u", seeded_uniform(seed, F.col("_k"))).withColumn("_slot", F.floor(F.col("_u") * slots))
    hit = (F.col("d._slot") == F.col("s._slot")) & (F.col("d._u") >= F.col("s.a")) & (F.col("d._u") < F.col("s.b"))
    return drawn.alias("d").join(spans.alias("s"), hit, "left").select(*[F.col(f"d.{n}") for n in base.columns], F.col("s.v").alias(out))


def synthesis_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per column and side: distinct count, first five values or numeric bounds, and the row count."""
    return _side(before, "before").unionByName(_side(after, "after"))


def _side(df: DataFrame, side: str) -> DataFrame:
    roles = synthesis_roles(df)
    names = [n for n, r in roles.items() if r != "other"]
    aggs = []
    for i, n in enumerate(names):
        num = c(n).cast("double") if roles[n] == "numeric" else F.lit(None).cast("double")
        aggs += [F.count("*").alias(f"n_rows__{i}"), F.min(num).alias(f"min__{i}"), F.max(num).alias(f"max__{i}")]
    base = stat_rows(df.agg(*aggs), names, ["n_rows", "min", "max"])
    values = unpivot(df, {n: c(n).cast("string") for n in names}).filter("value is not null").distinct()
    counts = values.groupBy("column_name").agg(F.count("*").alias("n_unique"))
    texts = [n for n in names if roles[n] == "categorical"]
    first = values.filter(F.col("column_name").isin(texts)).withColumn(
        "_r", F.row_number().over(W.partitionBy("column_name").orderBy("value"))
    ).filter("_r <= 5").groupBy("column_name").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("first_values"))
    return base.join(counts, "column_name", "left").join(first, "column_name", "left").select(
        F.lit(side).alias("side"), "column_name", "n_rows", F.coalesce("n_unique", F.lit(0)).alias("n_unique"), "min", "max", "first_values")
