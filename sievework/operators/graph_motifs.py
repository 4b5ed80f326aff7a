"""Triangles, squares, wedges, common neighbours and neighbour degrees. Expect a simple graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.operators.graph import Graph, adjacency, degrees
from sievework.session import cut

# Wedges a task handles, and neighbours on either side of a piece of a hub.
WEDGES, PIECE = 1 << 22, 2048


def _ranked(g: Graph) -> DataFrame:
    """(id, nbr, rid, rnbr): both directions with ranks ordered by degree, then id."""
    adj = adjacency(g).select("id", "nbr").distinct()
    rank = adj.groupBy("id").agg(F.count("*").alias("k")).selectExpr("id", "struct(k, id) AS r")
    return adj.join(rank.selectExpr("id", "r AS rid"), "id").join(rank.selectExpr("id AS nbr", "r AS rnbr"), "nbr").select("id", "nbr", "rid", "rnbr")


def _pairs(g: Graph) -> DataFrame:
    """(a, b): neighbours of an undirected graph, once, smaller end first."""
    return g.edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    """(id, k): how many pairs a vertex is in."""
    return pairs.selectExpr("inline(array(struct(a AS id), struct(b AS id)))").groupBy("id").agg(F.count("*").alias("k"))


def triangle_list(g: Graph) -> DataFrame:
    """(a, b, c), once per triangle, a lowest in degree order.

    Edges point from lower to higher degree, so a vertex has at most sqrt(2m) forward neighbours;
    the lists of both ends of an edge are intersected instead of emitting neighbour pairs. What travels
    is the list of the higher end, the shorter one on average; edges whose higher end has none, or whose
    lower end has no second neighbour, do not travel.
    """
    if g.directed:
        fwd = _ranked(g).filter("rid < rnbr").select("id", "nbr")
    else:
        pairs = cut(_pairs(g))
        k = _ends(pairs)
        sized = pairs.join(k.selectExpr("id AS a", "k AS ka"), "a").join(k.selectExpr("id AS b", "k AS kb"), "b")
        up = "ka < kb OR (ka = kb AND a < b)"
        fwd = sized.selectExpr(f"IF({up}, a, b) AS id", f"IF({up}, b, a) AS nbr")
    fwd = cut(fwd)
    lists = cut(fwd.groupBy("id").agg(F.collect_list("nbr").alias("ahead")))
    far = fwd.join(lists.selectExpr("id AS nbr", "ahead AS ahead2"), "nbr")
    both = far.join(lists.filter("size(ahead) > 1"), "id")
    return both.selectExpr("id AS a", "nbr AS b", "explode(array_intersect(ahead, ahead2)) AS c")


def triangles(g: Graph) -> DataFrame:
    """(id, triangles) per vertex."""
    corners = triangle_list(g).selectExpr("explode(array(a, b, c)) AS id").groupBy("id").agg(F.count("*").alias("t"))
    return g.vertices.select("id").join(corners, "id", "left").selectExpr("id", "coalesce(t, 0L) AS triangles")


def _loop_free_degree(g: Graph) -> DataFrame:
    if not g.directed:
        return _ends(_pairs(g))
    return adjacency(g).select("id", "nbr").distinct().groupBy("id").agg(F.count("*").alias("k"))


def clustering(g: Graph) -> DataFrame:
    """(id, triangles, k, clustering); 0 below two neighbours."""
    return triangles(g).join(_loop_free_degree(g), "id", "left").selectExpr(
        "id", "triangles", "coalesce(k, 0L) AS k", "IF(k > 1, 2D * triangles / (CAST(k AS DOUBLE) * (k - 1)), 0D) AS clustering")


def clustering_summary(g: Graph) -> DataFrame:
    """Average clustering and transitivity, one row."""
    wedges = F.sum(F.col("k") * (F.col("k") - 1) / 2)
    return clustering(g).agg(
        F.avg("clustering").alias("average_clustering"),
        F.when(wedges > 0, F.sum("triangles") / wedges).otherwise(0.0).alias("transitivity"))


def common_neighbors(g: Graph, pairs: DataFrame | None = None) -> DataFrame:
    """(src, dst, common) for the given pairs, by default the edges.

    The common neighbours of an edge close its triangles. For other pairs, and along directed edges, the
    neighbours of the smaller end are looked up at the other end.
    """
    if pairs is None and not g.directed:
        e = g.edges.filter("src <> dst").select("src", "dst", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
        sides = triangle_list(g).selectExpr("inline(array(struct(a AS x, b AS y), struct(a AS x, c AS y), struct(b AS x, c AS y)))")
        found = sides.groupBy(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(F.count("*").alias("common"))
        return e.join(found, ["lo", "hi"], "left").selectExpr("src", "dst", "coalesce(common, 0L) AS common")
    pairs = g.edges.filter("src <> dst").select("src", "dst") if pairs is None else pairs.select("src", "dst")
    adj = cut(adjacency(g).select("id", "nbr").distinct())
    k = adj.groupBy("id").agg(F.count("*").alias("k"))
    sized = pairs.join(k.selectExpr("id AS src", "k AS ks"), "src", "left").join(k.selectExpr("id AS dst", "k AS kd"), "dst", "left")
    turned = sized.selectExpr("src", "dst", "IF(ks <= kd, src, dst) AS small", "IF(ks <= kd, dst, src) AS big")
    seen = turned.join(adj.selectExpr("id AS small", "nbr AS w"), "small").join(adj.selectExpr("id AS big", "nbr AS w"), ["big", "w"], "left_semi")
    found = seen.groupBy("src", "dst").agg(F.count("*").alias("common"))
    return pairs.join(found, ["src", "dst"], "left").selectExpr("src", "dst", "coalesce(common, 0L) AS common")


def square_count(g: Graph) -> DataFrame:
    """(id, square_count): 4-cycles through every vertex.

    Each cycle is found once from its highest vertex in degree order; wedges then number at most
    the sum of the smaller degrees over all edges (Chiba and Nishizeki 1985). The centre of very many
    wedges is cut into pieces, and wedges travel once, to so many tasks that each holds about WEDGES.
    """
    r = cut(_ranked(g))
    sizes = cut(r.groupBy(F.col("id").alias("x")).agg(F.count("*").alias("k"), F.count_if(F.col("rid") < F.col("rnbr")).alias("tops")).filter("tops > 0"))
    wedges = sizes.agg(F.sum(F.col("k") * F.col("tops"))).first()[0] or 0
    tasks = max(g.vertices.sparkSession.sparkContext.defaultParallelism, -(-wedges // WEDGES))
    cuts = sizes.selectExpr("x", f"CAST(ceil(tops / {PIECE}) AS LONG) AS su", f"CAST(ceil(k / {PIECE}) AS LONG) AS sw")
    piece = ["x", "zu", "zw"]
    top = r.filter("rid < rnbr").selectExpr("id AS x", "nbr AS u", "rnbr AS ru").join(cuts, "x").selectExpr(
        "x", "u", "ru", "pmod(xxhash64(u), su) AS zu", "explode(sequence(0L, sw - 1)) AS zw")
    end = r.selectExpr("id AS x", "nbr AS w", "rnbr AS rw").join(cuts, "x").selectExpr(
        "x", "w", "rw", "explode(sequence(0L, su - 1)) AS zu", "pmod(xxhash64(w), sw) AS zw")
    met = top.repartition(tasks, *piece).join(end.repartition(tasks, *piece).hint("merge"), piece)
    wedge = met.filter("rw < ru").select("u", "x", "w").repartition(tasks, "u", "w")
    # A pair of ends with c wedges closes c * (c - 1) / 2 cycles: c - 1 halves of a cycle for each wedge.
    same = wedge.withColumn("c", F.count("*").over(W.partitionBy("u", "w"))).filter("c > 1")
    halves = same.selectExpr("inline(array(struct(u AS id, c - 1 AS n), struct(w AS id, c - 1 AS n), struct(x AS id, 2 * (c - 1) AS n)))")
    total = halves.groupBy("id").agg(F.expr("sum(n) DIV 2").alias("n"))
    return g.vertices.select("id").join(total, "id", "left").selectExpr("id", "coalesce(n, 0L) AS square_count")


def wedge_count(g: Graph) -> DataFrame:
    return degrees(g).selectExpr("id", "degree * (degree - 1) DIV 2 AS wedge_count")


def neighbor_degree(g: Graph) -> DataFrame:
    """(id, avg_neighbor_degree, num_neighbors); out-neighbours when directed."""
    adj = adjacency(g, loops=True).select("id", "nbr").distinct()
    stats = adj.join(degrees(g).selectExpr("id AS nbr", "degree"), "nbr").groupBy("id").agg(F.avg("degree").alias("a"), F.count("*").alias("k"))
    return g.vertices.select("id").join(stats, "id", "left").selectExpr("id", "coalesce(a, 0D) AS avg_neighbor_degree", "coalesce(k, 0L) AS num_neighbors")


def in_degree_ratio(g: Graph) -> DataFrame:
    return degrees(g).selectExpr("id", "IF(degree > 0, in_degree / degree, 0.5D) AS in_degree_ratio")
