"""Scaling, projection, density clustering and outlier removal."""

from __future__ import annotations

import math

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.columns import ROW_ID, c
from sievework.operators.components import min_label_components
from sievework.operators.ordering import exact_quantiles, ordered_index
from sievework.session import cut


def scale_stats(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column divides by one."""
    aggs = [f(c(n)).alias(f"{p}{i}") for i, n in enumerate(cols) for p, f in (("m", F.avg), ("s", F.stddev_pop))]
    if not aggs:
        return {}
    row = df.agg(*aggs).first()
    return {n: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, n in enumerate(cols)}


def scaled(col: Column, stat: tuple[float, float]) -> Column:
    return (col - F.lit(float(stat[0]))) / F.lit(float(stat[1]))


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    stats = scale_stats(df, cols)
    return df.select(*[scaled(c(n), stats[n]).alias(n) if n in stats else c(n) for n in df.columns])


def inverse_standardize(col: Column, stat: tuple[float, float]) -> Column:
    return col * F.lit(float(stat[1])) + F.lit(float(stat[0]))


def pca(df: DataFrame, cols: list[str], k: int = 2, key: str = ROW_ID) -> DataFrame:
    """(key, pc1..pck): scores of the standardised columns."""
    k = min(k, len(cols))
    stats = scale_stats(df, cols)
    flat = df.select(c(key), *[scaled(c(n), stats[n]).alias(f"x{i}") for i, n in enumerate(cols)])
    vectors = VectorAssembler(inputCols=[f"x{i}" for i in range(len(cols))], outputCol="v", handleInvalid="skip").transform(flat)
    model = PCA(k=k, inputCol="v", outputCol="s").fit(vectors)
    parts = vector_to_array("s")
    return model.transform(vectors).select(c(key), *[parts[i].alias(f"pc{i + 1}") for i in range(k)])


class _Grid:
    """Distinct positions with counts, on cells whose diagonal is `eps`."""

    def __init__(self, points: DataFrame, coords: list[str], eps: float):
        self.coords, self.eps = coords, eps
        d = len(coords)
        self.side = eps / math.sqrt(d)
        self.reach = math.ceil(math.sqrt(d))
        self.cells = [f"_c{i}" for i in range(d)]
        places = points.groupBy(*coords).agg(F.count("*").alias("_w"), F.min(ROW_ID).alias("_id"))
        self.places = places.select("*", *[
            F.floor(F.col(x) / self.side).cast("long").alias(n) for x, n in zip(coords, self.cells)
        ])

    def around(self, df: DataFrame, cells: list[str]) -> DataFrame:
        """One row per neighbouring cell, the own cell included."""
        near = F.array(*[F.lit(o) for o in range(-self.reach, self.reach + 1)])
        for n in cells:
            df = df.withColumn("_o", F.explode(near)).withColumn(n, F.col(n) + F.col("_o")).drop("_o")
        return df

    def gap2(self, a: str, b: str) -> Column:
        parts = [F.pow(F.col(f"{a}.{x}") - F.col(f"{b}.{x}"), F.lit(2)) for x in self.coords]
        return sum(parts[1:], parts[0])


def _core_and_border(points: DataFrame, coords: list[str], eps: float, min_samples: int):
    """Places marked core or not, plus for every non-core place the core places in reach."""
    grid = _Grid(points, coords, eps)
    load = grid.places.groupBy(*grid.cells).agg(F.sum("_w").alias("_load"))
    places = cut(grid.places.join(load, grid.cells))
    # A full cell holds only core points: all its points lie within eps of each other.
    dense = places.filter(F.col("_load") >= min_samples)
    # Cells below the limit hold fewer than `min_samples` places, so this join stays linear.
    sparse = places.filter(F.col("_load") < min_samples)
    probes = grid.around(sparse.select("_id", *grid.coords, *grid.cells), grid.cells)
    same_cell = [F.col(f"p.{n}") == F.col(f"o.{n}") for n in grid.cells]
    within = grid.gap2("p", "o") <= eps * eps
    seen = (
        probes.alias("p").join(places.alias("o"), [*same_cell])
        .filter(within)
        .groupBy(F.col("p._id").alias("_id")).agg(F.sum("o._w").alias("_near"))
    )
    checked = cut(sparse.join(seen, "_id").withColumn("core", F.col("_near") >= min_samples).drop("_near"))
    core = dense.unionByName(checked.filter("core").drop("core"))
    loose = checked.filter("not core")
    probes = grid.around(loose.select("_id", *grid.coords, *grid.cells), grid.cells)
    touching = (
        probes.alias("p").join(core.alias("o"), [*same_cell]).filter(within)
        .select(F.col("p._id").alias("_id"), *[F.col(f"o.{n}").alias(n) for n in grid.cells])
        .distinct()
    )
    return grid, cut(core), loose, touching


def noise_points(points: DataFrame, coords: list[str], eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """Row ids that are neither core nor within eps of a core point; needs no cluster ids."""
    grid, _, loose, touching = _core_and_border(points, coords, eps, min_samples)
    noise = loose.join(touching.select("_id").distinct(), "_id", "left_anti")
    return points.join(noise.select(*coords), coords, "left_semi").select(ROW_ID)


def _linked_cells(grid: _Grid, core: DataFrame, rounds: int = 8) -> DataFrame:
    """Pairs of neighbouring cells that hold core points within eps of each other.

    Cells are compared through ever smaller boxes: far box pairs drop out, close ones settle the
    cell pair, and only undecided pairs are split further. What remains undecided at the end is
    compared point by point inside its boxes.
    """
    cells, eps = grid.cells, grid.eps
    name_a, name_b = [f"a{n}" for n in cells], [f"b{n}" for n in cells]
    cell_list = core.select(*cells).distinct()
    left = grid.around(
        cell_list.select(*[F.col(n).alias(a) for n, a in zip(cells, name_a)], *cells), cells
    )
    pairs = left.join(cell_list, cells).select(*name_a, *[F.col(n).alias(b) for n, b in zip(cells, name_b)])
    pairs = pairs.filter(F.struct(*name_a) < F.struct(*name_b))

    def boxed(level: int) -> DataFrame:
        size = grid.side / 4**level
        return core.groupBy(*cells, *[F.floor(F.col(x) / size).cast("long").alias(f"x{i}") for i, x in enumerate(grid.coords)]).agg(
            *[f(x).alias(f"{p}{i}") for i, x in enumerate(grid.coords) for p, f in (("lo", F.min), ("hi", F.max))],
            F.count("*").alias("_n"),
        )

    d = len(cells)
    linked = None
    undecided = cut(pairs)
    parents = None
    for level in range(rounds):
        boxes = boxed(level)
        side_a = boxes.select(*[F.col(n).alias(a) for n, a in zip(cells, name_a)], *[
            F.col(f"{p}{i}").alias(f"a{p}{i}") for i in range(d) for p in ("x", "lo", "hi")])
        side_b = boxes.select(*[F.col(n).alias(b) for n, b in zip(cells, name_b)], *[
            F.col(f"{p}{i}").alias(f"b{p}{i}") for i in range(d) for p in ("x", "lo", "hi")])
        if parents is None:
            cand = undecided.join(side_a, name_a).join(side_b, name_b)
        else:
            pa, pb = [f"pa{i}" for i in range(d)], [f"pb{i}" for i in range(d)]
            side_a = side_a.select("*", *[F.shiftright(F.col(f"ax{i}"), 2).alias(pa[i]) for i in range(d)])
            side_b = side_b.select("*", *[F.shiftright(F.col(f"bx{i}"), 2).alias(pb[i]) for i in range(d)])
            cand = parents.join(side_a, [*name_a, *pa]).join(side_b, [*name_b, *pb])
        gap = [F.greatest(F.col(f"alo{i}") - F.col(f"bhi{i}"), F.col(f"blo{i}") - F.col(f"ahi{i}"), F.lit(0.0)) for i in range(d)]
        far = [F.greatest(F.col(f"ahi{i}") - F.col(f"blo{i}"), F.col(f"bhi{i}") - F.col(f"alo{i}")) for i in range(d)]
        cand = cut(cand.select(
            *name_a, *name_b,
            *[F.col(f"ax{i}").alias(f"pa{i}") for i in range(d)], *[F.col(f"bx{i}").alias(f"pb{i}") for i in range(d)],
            sum((g * g for g in gap[1:]), gap[0] * gap[0]).alias("_min2"),
            sum((g * g for g in far[1:]), far[0] * far[0]).alias("_max2"),
        ).filter(F.col("_min2") <= eps * eps))
        sure = cand.filter(F.col("_max2") <= eps * eps).select(*name_a, *name_b).distinct()
        linked = sure if linked is None else linked.unionByName(sure)
        parents = cut(
            cand.join(sure, [*name_a, *name_b], "left_anti")
            .select(*name_a, *name_b, *[f"pa{i}" for i in range(d)], *[f"pb{i}" for i in range(d)])
        )
        if parents.isEmpty():
            return linked
    size = grid.side / 4 ** (rounds - 1)
    inner = core.select(*cells, *grid.coords, *[F.floor(F.col(x) / size).cast("long").alias(f"x{i}") for i, x in enumerate(grid.coords)])
    side_a = inner.select(*[F.col(n).alias(a) for n, a in zip(cells, name_a)], *[F.col(f"x{i}").alias(f"pa{i}") for i in range(d)], *[F.col(x).alias(f"ya{i}") for i, x in enumerate(grid.coords)])
    side_b = inner.select(*[F.col(n).alias(b) for n, b in zip(cells, name_b)], *[F.col(f"x{i}").alias(f"pb{i}") for i in range(d)], *[F.col(x).alias(f"yb{i}") for i, x in enumerate(grid.coords)])
    gaps = [F.pow(F.col(f"ya{i}") - F.col(f"yb{i}"), F.lit(2)) for i in range(d)]
    rest = (
        parents.join(side_a, [*name_a, *[f"pa{i}" for i in range(d)]])
        .join(side_b, [*name_b, *[f"pb{i}" for i in range(d)]])
        .filter(sum(gaps[1:], gaps[0]) <= eps * eps)
        .select(*name_a, *name_b).distinct()
    )
    return linked.unionByName(rest)


def dbscan_labels(points: DataFrame, coords: list[str], eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """(row id, cluster): -1 for noise, clusters numbered by their smallest core row id."""
    grid, core, loose, touching = _core_and_border(points, coords, eps, min_samples)
    key = F.concat_ws(",", *grid.cells)
    cells = core.groupBy(*grid.cells).agg(F.min("_id").alias("_seed")).withColumn("cell", key)
    links = _linked_cells(grid, core).select(
        F.concat_ws(",", *[f"a{n}" for n in grid.cells]).alias("src"),
        F.concat_ws(",", *[f"b{n}" for n in grid.cells]).alias("dst"),
    )
    comp = min_label_components(cells.select(F.col("cell").alias("id")), links)
    owned = cells.join(comp, F.col("cell") == F.col("id")).drop("id")
    first = owned.groupBy("component").agg(F.min("_seed").alias("_seed"))
    numbers = ordered_index(first, [F.col("_seed")], "cluster").select("component", "cluster")
    of_cell = cut(owned.join(numbers, "component").select(*grid.cells, "cluster"))
    core_lab = core.join(of_cell, grid.cells).select(*coords, "cluster")
    border = (
        touching.join(of_cell, grid.cells).groupBy("_id").agg(F.min("cluster").alias("cluster"))
        .join(loose.select("_id", *coords), "_id").select(*coords, "cluster")
    )
    known = core_lab.unionByName(border)
    return points.join(known, coords, "left").select(ROW_ID, F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))


def remove_outliers(
    df: DataFrame, types: dict[str, str], eps: float = 0.5, min_samples: int = 5, k: int = 2
) -> tuple[DataFrame, DataFrame]:
    """Drop noise rows found on the first components of the numeric columns.

    Returns the cleaned table and the outlier row ids (empty when nothing is numeric).
    """
    numeric = [n for n in df.columns if types.get(n) in ("int", "float")]
    if not numeric:
        return df, df.select(ROW_ID).limit(0)
    scores = pca(df, numeric, k)
    noise = cut(noise_points(scores, [n for n in scores.columns if n != ROW_ID], eps, min_samples))
    return df.join(noise, ROW_ID, "left_anti"), noise


def outlier_report(total: DataFrame, noise: DataFrame) -> DataFrame:
    """Outlier count and percentage with two places."""
    n = total.agg(F.count("*").alias("n"))
    k = noise.agg(F.count("*").alias("outliers_removed"))
    # Both sides are one-row aggregates.
    return n.join(F.broadcast(k)).select(
        "outliers_removed",
        F.when(F.col("n") > 0, F.round(F.col("outliers_removed") / F.col("n") * 100, 2)).otherwise(0.0).alias("outlier_percentage"),
    )


def iqr_upper_bound(df: DataFrame, col: str, k: float = 1.5) -> float | None:
    q25, q75 = exact_quantiles(df, {col: [0.25, 0.75]})[col]
    return None if q25 is None else q75 + k * (q75 - q25)
