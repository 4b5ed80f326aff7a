"""Graph value object, degrees, statistics and quality checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.columns import ROW_ID
from sievework.operators.components import min_label_components
from sievework.session import cut


@dataclass(frozen=True)
class Graph:
    """vertices(id) and raw edges(src, dst, weight, _row_id); parallel edges may occur."""

    vertices: DataFrame
    edges: DataFrame
    directed: bool = False


def from_edges(edges: DataFrame, directed: bool = False, vertices: DataFrame | None = None) -> Graph:
    """Build a graph from an edge table; endpoints become vertices."""
    if "weight" not in edges.columns:
        edges = edges.withColumn("weight", F.lit(None).cast("double"))
    if ROW_ID not in edges.columns:
        edges = edges.withColumn(ROW_ID, F.monotonically_increasing_id())
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    if vertices is not None:
        ends = ends.unionByName(vertices.select("id"))
    return Graph(ends.distinct(), edges.select("src", "dst", "weight", ROW_ID), directed)


def canonical_edges(g: Graph) -> DataFrame:
    """One row per edge of the simple graph; a repeated edge keeps the last weight."""
    e = g.edges
    if not g.directed:
        e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight", ROW_ID)
    return e.groupBy("src", "dst").agg(F.max_by("weight", ROW_ID).alias("weight"), F.min(ROW_ID).alias(ROW_ID))


def simple(g: Graph) -> Graph:
    """The simple graph, stored, so that later steps start from collapsed edges."""
    return Graph(cut(g.vertices.select("id")), cut(canonical_edges(g)), g.directed)


def adjacency(g: Graph, loops: bool = False) -> DataFrame:
    """(id, nbr, weight) in both directions, or along the edges when directed. Expects a simple graph."""
    e = g.edges if loops else g.edges.filter("src <> dst")
    out = e.selectExpr("src AS id", "dst AS nbr", "weight")
    if g.directed:
        return out
    return out.unionByName(e.filter("src <> dst").selectExpr("dst AS id", "src AS nbr", "weight"))


def degrees(g: Graph) -> DataFrame:
    """Degree, in- and out-degree per vertex of the simple graph; a self-loop counts twice."""
    e = canonical_edges(g)
    ends = e.selectExpr("explode(array(struct(src AS id, 1 AS o, 0 AS i), struct(dst AS id, 0 AS o, 1 AS i))) AS x")
    sums = ends.groupBy("x.id").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))
    return g.vertices.select("id").join(sums, "id", "left").selectExpr(
        "id", "coalesce(in_degree, 0L) + coalesce(out_degree, 0L) AS degree",
        "coalesce(in_degree, 0L) AS in_degree", "coalesce(out_degree, 0L) AS out_degree")


def graph_stats(g: Graph) -> DataFrame:
    """Nodes, edges, density and degree statistics, one row."""
    m_per_degree = 1 if g.directed else 2
    return degrees(g).agg(
        F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"),
        F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"),
        F.min("degree").alias("min_degree"), F.stddev_pop("degree").alias("degree_std"),
    ).selectExpr(
        "nodes", "edges",
        f"IF(nodes > 1, {m_per_degree}.0D * edges / (CAST(nodes AS DOUBLE) * (nodes - 1)), 0D) AS density",
        "avg_degree", "max_degree", "min_degree", "degree_std")


def quality_issues(g: Graph) -> DataFrame:
    """Isolated vertices, self-loops and repeated edges, counted on the raw edge list."""
    pair = ["src", "dst"] if g.directed else [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    groups = g.edges.select(*pair).groupBy("src", "dst").agg(F.count("*").alias("n"))
    edges = groups.agg(
        F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("n"))), F.lit(0)).alias("self_loops"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_edges"))
    isolated = degrees(g).agg(F.count_if(F.col("degree") == 0).alias("isolated_nodes"))
    return isolated.join(F.broadcast(edges))  # one row each


def validate_graph(g: Graph) -> DataFrame:
    """One row per check with the measured value and whether it raises a warning."""
    stats = graph_stats(g).join(F.broadcast(quality_issues(g)))  # one row each
    return stats.selectExpr("""inline(array(
        struct('no_nodes' AS check, CAST(nodes AS DOUBLE) AS value, nodes = 0 AS warning),
        struct('no_edges' AS check, CAST(edges AS DOUBLE) AS value, edges = 0 AS warning),
        struct('isolated_nodes' AS check, CAST(isolated_nodes AS DOUBLE) AS value, isolated_nodes > 0 AS warning),
        struct('self_loops' AS check, CAST(self_loops AS DOUBLE) AS value, self_loops > 0 AS warning),
        struct('hub' AS check, CAST(max_degree AS DOUBLE) AS value, max_degree > 10 * avg_degree AS warning)))""")


def connected_components(g: Graph) -> DataFrame:
    """(id, component): weak components, named by their smallest vertex."""
    return min_label_components(g.vertices, g.edges)


def component_summary(components: DataFrame) -> DataFrame:
    sizes = components.groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("num_components"), F.max("n").alias("largest_component"),
                     (F.count("*") == 1).alias("is_connected"))


def subgraph(g: Graph, nodes: DataFrame) -> Graph:
    """Induced subgraph on the given ids."""
    keep = nodes.select("id")
    e = g.edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi")
    e = e.join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph(g.vertices.join(keep, "id", "left_semi"), e.select("src", "dst", "weight", ROW_ID), g.directed)


def limit_nodes(g: Graph, n: int) -> Graph:
    """Induced subgraph of the first n vertices by first appearance in the edge list."""
    seen = g.edges.selectExpr(f"explode(array(struct(src AS id, {ROW_ID} * 2 AS at), struct(dst AS id, {ROW_ID} * 2 + 1 AS at))) AS x")
    first = seen.groupBy("x.id").agg(F.min("x.at").alias("at"))
    picked = g.vertices.join(first, "id", "left").orderBy(F.col("at").asc_nulls_last(), "id").limit(n)
    return subgraph(g, cut(picked.select("id")))


def strong_components(g: Graph) -> DataFrame:
    """(id, component) of a directed graph, each named by its smallest vertex.

    Vertices without in- or out-edges are settled at once. Then the smallest reaching vertex is
    spread forward; what reaches that vertex backwards inside the same colour is one component.
    Every round settles a vertex, so the search ends by itself; long directed paths take many rounds.
    """
    edges = cut(g.edges.filter("src <> dst").select("src", "dst").distinct())
    nodes = cut(g.vertices.select("id"))
    done = None
    while True:
        heads, tails = edges.selectExpr("dst AS id").distinct(), edges.selectExpr("src AS id").distinct()
        inner = cut(nodes.join(heads, "id", "left_semi").join(tails, "id", "left_semi"))
        single = nodes.join(inner, "id", "left_anti").selectExpr("id", "id AS component")
        done = single if done is None else done.unionByName(single)
        n_inner, n_nodes = inner.count(), nodes.count()
        keep = inner
        if n_inner == n_nodes and n_inner:
            color = _spread(inner.selectExpr("id", "id AS color"), edges)
            same = cut(edges.join(color.selectExpr("id AS src", "color AS cs"), "src").join(color.selectExpr("id AS dst", "color AS cd"), "dst").filter("cs = cd").select("src", "dst"))
            hit = _reach_back(color, same)
            done = done.unionByName(hit.selectExpr("id", "color AS component"))
            keep = cut(inner.join(hit, "id", "left_anti"))
        if keep.isEmpty():
            return done
        done = cut(done)
        nodes = keep
        edges = cut(edges.join(keep.selectExpr("id AS src"), "src", "left_semi").join(keep.selectExpr("id AS dst"), "dst", "left_semi"))


def _spread(color: DataFrame, edges: DataFrame) -> DataFrame:
    """Forward fixpoint of the smallest colour."""
    color = cut(color)
    while True:
        came = edges.join(color, edges.src == color.id).groupBy("dst").agg(F.min("color").alias("c"))
        new = cut(color.join(came, color.id == came.dst, "left").selectExpr("id", "least(color, coalesce(c, color)) AS color", "coalesce(c < color, false) AS moved"))
        moved = new.filter("moved").isEmpty()
        color = new.drop("moved")
        if moved:
            return color


def _reach_back(color: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices that reach the vertex their colour is named after, inside the colour."""
    front = cut(color.filter("id = color"))
    hit = front
    while True:
        back = edges.join(front, edges.dst == front.id).selectExpr("src AS id", "color").distinct()
        front = cut(back.join(hit, "id", "left_anti"))
        if front.isEmpty():
            return hit
        hit = cut(hit.unionByName(front))


def largest_component(components: DataFrame) -> DataFrame:
    """Ids of the largest component; ties go to the smallest name."""
    sizes = components.groupBy("component").agg(F.count("*").alias("n"))
    top = sizes.agg(F.min_by("component", F.struct(-F.col("n"), "component")).alias("component"))
    return components.join(top, "component", "left_semi").select("id")


def ranked_top(values: DataFrame, value: str, share: float = 0.1) -> DataFrame:
    """Ids of the top max(1, n * share) rows by value; ties go to the smaller id.

    Values that differ only beyond the 12th decimal place, as sums in another order do, are ties.
    """
    k = max(1, int(values.count() * share))
    return values.orderBy(F.desc(F.round(value, 12)), "id").limit(k).select("id")


