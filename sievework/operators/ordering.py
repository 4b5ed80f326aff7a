"""Exact ranks, quantiles and per-group selections that never sort a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.columns import c, seeded_hash
from sievework.session import checkpointed

# Up to this many values the built-in exact percentile aggregate is used directly.
DIRECT_LIMIT = 1 << 20


def ordered_index(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """0-based position in the global order: one range shuffle plus a per-partition offset."""
    stored = checkpointed(df.orderBy(*order))
    keyed = stored.withColumn("_pid", F.spark_partition_id()).withColumn(
        "_pos", F.monotonically_increasing_id()
    )
    # One row per partition, so the running total below stays tiny.
    sizes = keyed.groupBy("_pid").agg(F.count("*").alias("_n"), F.min("_pos").alias("_base"))
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_pid", "_base", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    return (
        keyed.join(offsets, "_pid")
        .withColumn(name, F.col("_pos") - F.col("_base") + F.col("_off"))
        .drop("_pid", "_pos", "_base", "_off")
    )


def exact_quantiles(
    df: DataFrame, probs: dict[str, list[float]], direct_limit: int = DIRECT_LIMIT
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column, as driver scalars.

    Small inputs use the exact aggregate. Larger ones narrow a bracket around each wanted rank
    with approximate quantiles until it holds few rows, then finish exactly inside it.
    """
    names = list(probs)
    if not names:
        return {}
    counts = df.agg(*[F.count(c(n)).alias(f"n{i}") for i, n in enumerate(names)]).first()
    out: dict[str, list[float | None]] = {}
    direct = [n for i, n in enumerate(names) if counts[i] <= direct_limit]
    if direct:
        row = df.agg(
            *[
                F.percentile(c(n).cast("double"), F.array(*[F.lit(float(p)) for p in probs[n]])).alias(f"q{i}")
                for i, n in enumerate(direct)
            ]
        ).first()
        for i, n in enumerate(direct):
            out[n] = list(row[i]) if row[i] is not None else [None] * len(probs[n])
    for i, n in enumerate(names):
        if n not in out:
            values = df.select(c(n).cast("double").alias("v")).filter("v is not null")
            out[n] = [_bracketed(values, counts[i], p, direct_limit) for p in probs[n]]
    return out


def _bracketed(values: DataFrame, n: int, p: float, limit: int) -> float:
    pos = p * (n - 1)
    low_rank, high_rank = int(pos), min(int(pos) + 1, n - 1)
    accuracy = 10_000
    inside, below, size = values, 0, n
    while True:
        margin = 2.0 / accuracy
        lo_p = max(0.0, (low_rank - below) / size - margin)
        hi_p = min(1.0, (high_rank - below + 1) / size + margin)
        lo, hi = inside.agg(F.percentile_approx("v", [lo_p, hi_p], accuracy)).first()[0]
        kept = values.filter(F.col("v").between(lo, hi))
        row = values.agg(
            F.sum((F.col("v") < lo).cast("long")).alias("b"),
            F.sum(F.col("v").between(lo, hi).cast("long")).alias("s"),
        ).first()
        if row.s >= size or row.s <= limit or lo == hi:
            below, size, inside = row.b, row.s, kept
            break
        below, size, inside = row.b, row.s, kept
    # Equal values collapse into one counted row before the ranking.
    grouped = inside.groupBy("v").agg(F.count("*").alias("k"))
    running = grouped.select("v", F.sum("k").over(W.orderBy("v")).alias("upto"))
    picks = running.agg(
        F.min(F.when(F.col("upto") > low_rank - below, F.col("v"))).alias("a"),
        F.min(F.when(F.col("upto") > high_rank - below, F.col("v"))).alias("b"),
    ).first()
    return picks.a + (picks.b - picks.a) * (pos - low_rank)


def take_per_group(
    df: DataFrame, groups: list[str], wanted: Column, key: Column, seed: int, buckets: int = 1024
) -> DataFrame:
    """Mark `_taken` on the `wanted` smallest-hash rows of each group.

    `wanted` is an expression over the group size `_size`. Only the one hash bucket where the
    count is reached gets ranked, so a group holding most rows is still spread over many tasks.
    """
    hashed = df.withColumn("_h", seeded_hash(seed, key)).withColumn(
        "_b", F.pmod(F.shiftrightunsigned("_h", 20), F.lit(buckets))
    )
    per = hashed.groupBy(*[c(g) for g in groups], "_b").agg(F.count("*").alias("_n"))
    by_group = W.partitionBy(*[c(g) for g in groups]) if groups else W.partitionBy(F.lit(1))
    plan = (
        per.withColumn("_size", F.sum("_n").over(by_group))
        .withColumn("_upto", F.sum("_n").over(by_group.orderBy("_b")))
        .withColumn("_left", wanted - (F.col("_upto") - F.col("_n")))
        .select(*[c(g) for g in groups], "_b", "_n", "_left")
    )
    cond = F.col("x._b") == F.col("p._b")
    for g in groups:
        cond = cond & F.col("x." + _q(g)).eqNullSafe(F.col("p." + _q(g)))
    joined = hashed.alias("x").join(plan.alias("p"), cond).select("x.*", "p._n", "p._left")
    whole = joined.filter((F.col("_left") <= 0) | (F.col("_left") >= F.col("_n"))).withColumn(
        "_taken", F.col("_left") > 0
    )
    edge = joined.filter((F.col("_left") > 0) & (F.col("_left") < F.col("_n")))
    rank = F.row_number().over(W.partitionBy(*[c(g) for g in groups], "_b").orderBy("_h", key))
    edge = edge.withColumn("_taken", rank <= F.col("_left"))
    return whole.unionByName(edge).drop("_h", "_b", "_n", "_left")


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
