"""Measures built on breadth-first searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.columns import seeded_hash
from sievework.operators.graph import Graph, adjacency
from sievework.operators.graph_search import distance_sums, path_sums
from sievework.session import cut

# Sources are sampled only if the caller sets a limit; these many are drawn then.
PIVOTS = 100


def pick_sources(g: Graph, exact_limit: int | None = None, pivots: int = PIVOTS, seed: int = 42) -> tuple[DataFrame, int, int]:
    """Source vertices, their number and the vertex count. All vertices, or above a limit that the
    caller sets a seeded sample of pivots."""
    n = g.vertices.count()
    if exact_limit is None or n <= exact_limit:
        return g.vertices.selectExpr("id AS source"), n, n
    chosen = g.vertices.orderBy(seeded_hash(seed, F.col("id")), "id").limit(min(pivots, n))
    return cut(chosen.selectExpr("id AS source")), min(pivots, n), n


def path_measures(g: Graph, exact_limit: int | None = None, pivots: int = PIVOTS) -> DataFrame:
    """(id, reached, total, far, between) of one search that counts paths; see `path_sums`.

    Closeness, betweenness and, on undirected graphs, path statistics and eccentricity can all be told
    from it; pass it to them as `measures`.
    """
    return path_sums(g, _sampled(g, exact_limit, pivots))


def _sampled(g: Graph, exact_limit: int | None, pivots: int = PIVOTS) -> DataFrame | None:
    sources, k, n = pick_sources(g, exact_limit, pivots)
    return sources if k < n else None


def _source_count(n: int, exact_limit: int | None, pivots: int = PIVOTS) -> int:
    return n if exact_limit is None or n <= exact_limit else min(pivots, n)


def eccentricity(g: Graph, measures: DataFrame | None = None, exact_limit: int | None = None) -> DataFrame:
    """Largest distance to a reached vertex (from sampled pivots above a limit, if one is set)."""
    if measures is None or g.directed:
        measures = distance_sums(g, _sampled(g, exact_limit), inward=not g.directed)
    return measures.selectExpr("id", "far AS eccentricity")


def shortest_path_stats(g: Graph, exact_limit: int | None = None, measures: DataFrame | None = None) -> DataFrame:
    """Average path length, diameter and radius; zeros when some vertex does not reach another.

    With sampled sources the distances are those between the sources and all vertices.
    """
    n = g.vertices.count()
    k = _source_count(n, exact_limit)
    if measures is None or g.directed:
        measures = distance_sums(g, _sampled(g, exact_limit), inward=not g.directed)
    return measures.agg(
        (F.sum("reached") == F.lit(k * (n - 1))).alias("connected"), F.sum("total").alias("total"), F.max("far").alias("dia"), F.min("far").alias("rad")
    ).selectExpr(
        "connected",
        f"IF(connected AND {n} > 1, total / ({k}.0D * ({n} - 1)), 0D) AS average_path_length",
        "IF(connected, dia, 0L) AS diameter", "IF(connected, rad, 0L) AS radius",
        f"{str(k == n).lower()} AS exact")


def closeness(g: Graph, exact_limit: int | None = None, measures: DataFrame | None = None) -> DataFrame:
    """(id, closeness) with inward distances; scaled by the reached share.

    With sampled sources the reached count and the distance sum are scaled up to all vertices.
    """
    n = g.vertices.count()
    k = _source_count(n, exact_limit)
    sums = distance_sums(g, _sampled(g, exact_limit)) if measures is None else measures
    scale = n / k if k else 1.0
    return sums.selectExpr(
        "id", f"IF(total = 0 OR {n} < 2, 0D, (least(reached * {scale}D, {n} - 1) / (total * {scale}D)) * least(reached * {scale}D, {n} - 1) / ({n} - 1)) AS closeness")


def betweenness(g: Graph, exact_limit: int | None = None, pivots: int = PIVOTS, measures: DataFrame | None = None) -> DataFrame:
    """(id, betweenness), normalised. Exact; pivot-sampled above a limit, if one is set."""
    n = g.vertices.count()
    k = _source_count(n, exact_limit, pivots)
    sums = path_measures(g, exact_limit, pivots) if measures is None else measures
    scale = (n / k) / ((n - 1) * (n - 2)) if n > 2 and k else 0.0
    return sums.selectExpr("id", f"between * {scale!r}D AS betweenness")


def local_efficiency(g: Graph) -> DataFrame:
    """Average inverse distance inside the neighbour-induced subgraph of every vertex.

    Runs one search per (vertex, neighbour) over that vertex's neighbour edges, so work follows the
    triangles; no neighbour list is gathered in one place.
    """
    from sievework.operators.graph_motifs import triangle_list

    tri = triangle_list(g)
    ego = cut(tri.selectExpr("""explode(array(
        struct(a AS ego, b AS x, c AS y), struct(a AS ego, c AS x, b AS y), struct(b AS ego, a AS x, c AS y),
        struct(b AS ego, c AS x, a AS y), struct(c AS ego, a AS x, b AS y), struct(c AS ego, b AS x, a AS y))) AS e""")
        .selectExpr("e.ego", "e.x", "e.y"))
    level = cut(ego.selectExpr("ego", "x AS source", "x AS id").distinct())
    seen, d, gains = level, 0, []
    while True:
        step = level.join(ego.withColumnRenamed("x", "id"), ["ego", "id"]).selectExpr("ego", "source", "y AS id").distinct()
        level = cut(step.join(seen, ["ego", "source", "id"], "left_anti"))
        if level.isEmpty():
            break
        d += 1
        gains.append(level.groupBy("ego").agg((F.count("*") / d).alias("gain")))
        seen = seen.unionByName(level)
    deg = adjacency(g).groupBy("id").agg(F.count("*").alias("k"))
    if not gains:
        return g.vertices.selectExpr("id", "0D AS local_efficiency")
    total = gains[0]
    for x in gains[1:]:
        total = total.unionByName(x)
    total = total.groupBy(F.col("ego").alias("id")).agg(F.sum("gain").alias("gain"))
    return g.vertices.select("id").join(deg, "id", "left").join(total, "id", "left").selectExpr(
        "id", "IF(k > 1, coalesce(gain, 0D) / (CAST(k AS DOUBLE) * (k - 1)), 0D) AS local_efficiency")
