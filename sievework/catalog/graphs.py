"""Queries over graphs derived from whole tables.

parts: consecutive parts inside an order (undirected, repeats and loops kept, quantity as weight).
users: consecutive users inside an hour of one event type (directed).
pages: pages and the link targets found in their whole HTML (undirected, sparse).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.catalog.registry import query, scratch, table
from sievework.functions.columns import ROW_ID
from sievework.operators import graph as gg
from sievework.operators import graph_blocks as gb
from sievework.operators import graph_clean as gcl
from sievework.operators import graph_communities as gc
from sievework.operators import graph_features as gf
from sievework.operators import graph_measures as gm
from sievework.operators import graph_motifs as gmo
from sievework.operators import graph_paths as gp
from sievework.operators import graph_rank as gr
from sievework.session import cut
from sievework.sources import graphs as io

PARTS_RAW = """SELECT l_partkey AS src, lead(l_partkey) OVER w AS dst, l_quantity AS weight, l_orderkey * 1000 + row_number() OVER w AS _row_id FROM lineitem
 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice)"""
USERS_RAW = """SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS dst, event_id AS _row_id FROM events"""
PAGES_RAW = """SELECT 'p' || page_id AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages"""

# Common table expressions for the SQL side: raw edges, simple edges e, vertices v, both directions a.
PARTS = f"""raw AS (SELECT * FROM ({PARTS_RAW}) WHERE dst IS NOT NULL), v AS (SELECT src AS id FROM raw UNION SELECT dst FROM raw),
 e AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, arg_max(weight, _row_id) AS weight FROM raw GROUP BY 1, 2),
 a AS (SELECT src AS id, dst AS nbr FROM e WHERE src <> dst UNION ALL SELECT dst, src FROM e WHERE src <> dst),
 deg AS (SELECT id, sum(k) AS degree FROM (SELECT src AS id, count(*) AS k FROM e GROUP BY 1 UNION ALL SELECT dst, count(*) FROM e GROUP BY 1) GROUP BY 1)"""
PAGES = f"""raw AS (SELECT * FROM ({PAGES_RAW}) WHERE dst IS NOT NULL), v AS (SELECT src AS id FROM raw UNION SELECT dst FROM raw),
 e AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM raw), nn AS (SELECT count(*) AS n FROM v),
 a AS (SELECT src AS id, dst AS nbr FROM e WHERE src <> dst UNION ALL SELECT dst, src FROM e WHERE src <> dst),
 deg AS (SELECT id, count(*) AS degree FROM a GROUP BY 1)"""
USERS = f"""raw AS (SELECT * FROM ({USERS_RAW}) WHERE dst IS NOT NULL), v AS (SELECT src AS id FROM raw UNION SELECT dst FROM raw), nn AS (SELECT count(*) AS n FROM v),
 e AS (SELECT DISTINCT src, dst FROM raw),
 deg AS (SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1)"""


def parts(spark: SparkSession, sf: str) -> gg.Graph:
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    e = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.col("l_quantity").alias("weight"),
        (F.col("l_orderkey") * 1000 + F.row_number().over(w)).alias(ROW_ID))
    # Stored: vertices and edges would each run the window again.
    return gg.from_edges(cut(e.filter("dst IS NOT NULL")))


# Customers and suppliers of a nation in the order of their balance, and its suppliers by key: paths and rings.
TERRITORY = """raw AS (SELECT id AS src, lead(id) OVER (PARTITION BY nation ORDER BY balance, id) AS dst FROM
  (SELECT 'c' || c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey, s_acctbal FROM supplier)
  UNION ALL SELECT 's' || s_suppkey, 's' || lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) FROM supplier),
 e AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM raw WHERE dst IS NOT NULL),
 a AS (SELECT src AS id, dst AS nbr FROM e UNION ALL SELECT dst, src FROM e)"""


def territory(spark: SparkSession, sf: str) -> gg.Graph:
    customers = table(spark, sf, "customer").selectExpr("concat('c', c_custkey) AS id", "c_nationkey AS nation", "c_acctbal AS balance")
    suppliers = table(spark, sf, "supplier").selectExpr("concat('s', s_suppkey) AS id", "s_nationkey AS nation", "s_acctbal AS balance", "s_suppkey AS key")
    ranked = customers.unionByName(suppliers.drop("key")).selectExpr("id AS src", "lead(id) OVER (PARTITION BY nation ORDER BY balance, id) AS dst")
    ring = suppliers.selectExpr("id AS src", "lead(id) OVER (PARTITION BY nation ORDER BY key) AS dst")
    return gg.from_edges(cut(ranked.unionByName(ring).filter("dst IS NOT NULL")))


def users(spark: SparkSession, sf: str) -> gg.Graph:
    w = W.partitionBy("event_type", F.date_trunc("hour", F.col("ts"))).orderBy("ts", "event_id")
    e = table(spark, sf, "events").select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst"), F.col("event_id").alias(ROW_ID))
    return gg.from_edges(cut(e.filter("dst IS NOT NULL")), directed=True)


def pages(spark: SparkSession, sf: str) -> gg.Graph:
    e = table(spark, sf, "pages").select(
        F.concat(F.lit("p"), F.col("page_id")).alias("src"),
        F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("dst"))
    return gg.from_edges(e)


def sparse(spark, sf) -> gg.Graph:
    return gg.simple(pages(spark, sf))


def dense(spark, sf) -> gg.Graph:
    return gg.simple(parts(spark, sf))


def flow(spark, sf) -> gg.Graph:
    return gg.simple(users(spark, sf))


# --- sources and sinks -------------------------------------------------------------------------

EDGE_SQL = f"WITH {USERS} SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, count(*) AS n FROM raw GROUP BY 1, 2"


def _count(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("s3_read_edges_csv", EDGE_SQL)
def s3(spark, sf):
    path = scratch(spark, "edges.csv")
    users(spark, sf).edges.select("src", "dst").write.option("header", True).csv(path)
    return _count(io.read_edges_csv(spark, path))


@query("s4_detect_edge_columns", f"WITH {PARTS} SELECT src, dst, round(sum(weight), 2) AS w FROM raw GROUP BY 1, 2")
def s4(spark, sf):
    renamed = parts(spark, sf).edges.selectExpr(f"{ROW_ID} AS line", "weight AS Cost", "dst AS Target", "src AS Node1")
    e = io.detect_edge_columns(renamed)
    return e.selectExpr("CAST(src AS LONG) AS src", "CAST(dst AS LONG) AS dst", "weight").groupBy("src", "dst").agg(F.round(F.sum("weight"), 2).alias("w"))


@query("s5_read_edges_text", EDGE_SQL)
def s5(spark, sf):
    path = scratch(spark, "edges.txt")
    lines = users(spark, sf).edges.selectExpr("concat(src, '\\t', dst) AS value")
    lines.unionByName(spark.range(2).selectExpr("concat('# comment ', id) AS value")).write.text(path)
    return _count(io.read_edges_text(spark, path))


@query("s6_read_node_link_json", f"WITH {PAGES} SELECT count(*) AS links, (SELECT count(*) FROM v) AS nodes, CAST(sum(length(src) + length(dst)) AS BIGINT) AS chars, count(*) * 1.0::DOUBLE AS weight FROM e")
def s6(spark, sf):
    path = scratch(spark, "graph.json")
    io.write_node_link_json(sparse(spark, sf), path)
    g = io.read_node_link_json(spark, path)
    return g.edges.agg(F.count("*").alias("links"), F.sum(F.length("src") + F.length("dst")).alias("chars"), F.sum("weight").alias("weight")).join(
        F.broadcast(g.vertices.agg(F.count("*").alias("nodes"))))


@query("s7_read_graph_xml", EDGE_SQL)
def s7(spark, sf):
    path = scratch(spark, "graph.graphml")
    users(spark, sf).edges.selectExpr("CAST(src AS STRING) AS _source", "CAST(dst AS STRING) AS _target").write.format("xml").option("rootTag", "graph").option("rowTag", "edge").save(path)
    return _count(io.read_graph_xml(spark, path, directed=True).edges)


@query("s8_read_graph", f"WITH {PAGES} SELECT count(*) AS edges, (SELECT count(*) FROM v) AS nodes FROM raw")
def s8(spark, sf):
    path = scratch(spark, "links.csv")
    pages(spark, sf).edges.selectExpr("src AS source", "dst AS target").write.option("header", True).csv(path)
    g = io.read_graph(spark, path)
    return g.edges.agg(F.count("*").alias("edges")).join(F.broadcast(g.vertices.agg(F.count("*").alias("nodes"))))


@query("s14_write_edges", EDGE_SQL)
def s14(spark, sf):
    path = scratch(spark, "edges.edgelist")
    io.write_edges(users(spark, sf), path, "edgelist")
    return _count(io.read_edges_text(spark, path))


@query("s15_write_nodes", f"WITH {USERS} SELECT id AS node_id, in_degree, out_degree FROM deg")
def s15(spark, sf):
    path = scratch(spark, "nodes.csv")
    io.write_nodes(gg.degrees(users(spark, sf)).select("id", "in_degree", "out_degree"), path)
    return spark.read.option("header", True).schema("node_id long, in_degree long, out_degree long").csv(path)


@query("s16_write_node_link_json", f"WITH {PARTS} SELECT count(*) AS links, round(sum(weight), 2) AS weight FROM e")
def s16(spark, sf):
    path = scratch(spark, "parts.json")
    io.write_node_link_json(dense(spark, sf), path)
    return io.read_node_link_json(spark, path).edges.agg(F.count("*").alias("links"), F.round(F.sum("weight"), 2).alias("weight"))


@query("s19_edge_file_counts", f"WITH {USERS} SELECT count(*) AS edges, (SELECT n FROM nn) AS nodes FROM raw")
def s19(spark, sf):
    path = scratch(spark, "counts.csv")
    users(spark, sf).edges.select("src", "dst").write.option("header", True).csv(path)
    return io.edge_file_counts(spark, path)


# --- structure and quality ---------------------------------------------------------------------

@query("g1_degrees", f"WITH {USERS} SELECT * FROM deg")
def g1(spark, sf):
    return gg.degrees(users(spark, sf))


@query("g2_graph_stats", f"""WITH {PARTS} SELECT count(*) AS nodes, CAST(sum(degree) / 2 AS BIGINT) AS edges, round(sum(degree) * 1.0 / (count(*) * (count(*) - 1)), 6) AS density, round(avg(degree), 6) AS avg_degree,
 CAST(max(degree) AS BIGINT) AS max_degree, CAST(min(degree) AS BIGINT) AS min_degree, round(stddev_pop(degree), 6) AS degree_std FROM deg""")
def g2(spark, sf):
    return gg.graph_stats(parts(spark, sf)).selectExpr("nodes", "edges", "round(density, 6) AS density", "round(avg_degree, 6) AS avg_degree", "max_degree", "min_degree", "round(degree_std, 6) AS degree_std")


# Components through a keyed recursion that keeps the smallest label per vertex.
COMPONENTS_SQL = f"""WITH RECURSIVE {PAGES}, cc(id, component) USING KEY (id) AS (SELECT id, id FROM v UNION
 SELECT a.nbr, min(cc.component) FROM cc JOIN a ON a.id = cc.id JOIN recurring.cc AS old ON old.id = a.nbr WHERE cc.component < old.component GROUP BY 1)"""


@query("g3_connected_components", COMPONENTS_SQL + " SELECT id, component FROM cc")
def g3(spark, sf):
    return gg.connected_components(pages(spark, sf))


@query("g3_component_summary", COMPONENTS_SQL + " SELECT count(*) AS num_components, max(n) AS largest_component, count(*) = 1 AS is_connected FROM (SELECT count(*) AS n FROM cc GROUP BY component)")
def g3s(spark, sf):
    return gg.component_summary(gg.connected_components(pages(spark, sf)))


@query("g4_strong_components", f"""WITH RECURSIVE {USERS}, reach AS (SELECT id AS s, id AS t FROM v UNION SELECT s, dst FROM reach JOIN e ON src = t)
 SELECT a.s AS id, min(a.t) AS component FROM reach a JOIN reach b ON a.s = b.t AND a.t = b.s GROUP BY 1""")
def g4(spark, sf):
    return gg.strong_components(users(spark, sf))


@query("g5_quality_issues", f"WITH {PARTS} SELECT 0 AS isolated_nodes, count(*) FILTER (src = dst) AS self_loops, count(*) - (SELECT count(*) FROM e) AS duplicate_edges FROM raw")
def g5(spark, sf):
    return gg.quality_issues(parts(spark, sf))


@query("g6_validate_graph", f"""WITH {PARTS}, s AS (SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM e) AS m, (SELECT count(*) FROM raw WHERE src = dst) AS l, (SELECT max(degree) FROM deg) AS mx, (SELECT avg(degree) FROM deg) AS av)
 SELECT 'no_nodes' AS "check", n * 1.0::DOUBLE AS value, n = 0 AS warning FROM s UNION ALL SELECT 'no_edges', m, m = 0 FROM s UNION ALL SELECT 'isolated_nodes', 0, false FROM s UNION ALL SELECT 'self_loops', l, l > 0 FROM s UNION ALL SELECT 'hub', mx, mx > 10 * av FROM s""")
def g6(spark, sf):
    return gg.validate_graph(parts(spark, sf))


@query("g7_remove_self_loops", f"WITH {PARTS} SELECT count(*) AS edges FROM raw WHERE src <> dst")
def g7(spark, sf):
    return gcl.remove_self_loops(parts(spark, sf)).edges.agg(F.count("*").alias("edges"))


@query("g8_remove_duplicate_edges", f"WITH {PARTS} SELECT src, dst, weight FROM e")
def g8(spark, sf):
    return gcl.remove_duplicate_edges(parts(spark, sf)).edges.select("src", "dst", "weight")


@query("g9_remove_low_degree", f"WITH {PARTS}, low AS (SELECT id FROM deg WHERE degree < 40) SELECT src, dst FROM e WHERE src NOT IN (SELECT id FROM low) AND dst NOT IN (SELECT id FROM low)")
def g9(spark, sf):
    g = dense(spark, sf)
    return gcl.drop_nodes(g, gcl.low_degree_nodes(g, 40)).edges.select("src", "dst")


@query("g10_remove_isolated", f"WITH {PARTS} SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT id FROM v)")
def g10(spark, sf):
    g = parts(spark, sf)
    ids = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return gcl.isolated_nodes(gg.from_edges(g.edges, False, ids))


@query("g11_filter_components", COMPONENTS_SQL + """, s AS (SELECT component, count(*) AS n FROM cc GROUP BY 1) SELECT id FROM cc JOIN s USING (component) WHERE n >= 8 OR component = (SELECT component FROM s ORDER BY n DESC, component LIMIT 1)""")
def g11(spark, sf):
    g = sparse(spark, sf)
    return gcl.drop_nodes(g, gcl.small_component_nodes(g, 8)).vertices


@query("g12_remove_by_degree", f"WITH {PARTS} SELECT id, CASE WHEN degree < 35 THEN 'low' ELSE 'high' END AS side FROM deg WHERE (degree < 35 OR degree > 60) AND id NOT IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')")
def g12(spark, sf):
    keep = table(spark, sf, "part").filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("id"))
    return gcl.degree_band_nodes(parts(spark, sf), 35, 60, keep)


@query("g13_degree_anomalies", f"WITH {PARTS} SELECT id, CAST(degree AS BIGINT) AS degree FROM deg WHERE degree > (SELECT quantile_cont(degree, 0.75) + 1.5 * (quantile_cont(degree, 0.75) - quantile_cont(degree, 0.25)) FROM deg)")
def g13(spark, sf):
    return gcl.degree_anomalies(parts(spark, sf))


@query("g14_important_nodes")
def g14(spark, sf):
    return gcl.important_nodes(sparse(spark, sf))


# An edge is a bridge exactly when one end cannot reach the other without it.
BRIDGES_SQL = """ reach AS (SELECT src, dst, src AS spot FROM e WHERE src <> dst
  UNION SELECT r.src, r.dst, a.nbr FROM reach r JOIN a ON a.id = r.spot AND NOT (a.id = r.src AND a.nbr = r.dst) AND NOT (a.id = r.dst AND a.nbr = r.src))
 SELECT src, dst FROM reach GROUP BY 1, 2 HAVING NOT bool_or(spot = dst)"""
# A vertex is a cut vertex exactly when one of its neighbours cannot reach another without it.
CUTS_SQL = """ reach AS (SELECT id, min(nbr) AS spot FROM a GROUP BY 1 UNION SELECT r.id, a.nbr FROM reach r JOIN a ON a.id = r.spot AND a.nbr <> r.id)
 SELECT DISTINCT a.id FROM a ANTI JOIN reach r ON r.id = a.id AND r.spot = a.nbr"""


@query("g15_bridges", f"WITH RECURSIVE {PAGES}, {BRIDGES_SQL}")
def g15(spark, sf):
    return gb.bridges(sparse(spark, sf))


@query("g15_territory_bridges", f"WITH RECURSIVE {TERRITORY}, {BRIDGES_SQL}")
def g15t(spark, sf):
    return gb.bridges(territory(spark, sf))


@query("g15_pendant_bridges", f"WITH {PAGES} SELECT src, dst FROM e WHERE src <> dst AND (src IN (SELECT id FROM deg WHERE degree = 1) OR dst IN (SELECT id FROM deg WHERE degree = 1))")
def g15p(spark, sf):
    g = sparse(spark, sf)
    leaf = cut(gg.degrees(g).filter("degree = 1").select("id"))
    b = cut(gb.bridges(g))
    at = lambda side: b.join(leaf.withColumnRenamed("id", side), side, "left_semi").select("src", "dst")
    return at("src").union(at("dst")).distinct()


CLEAN_SQL = f"""WITH {PARTS}, k AS (SELECT * FROM e WHERE src <> dst), d AS (SELECT id, count(*) AS degree FROM a GROUP BY 1), low AS (SELECT v.id FROM v LEFT JOIN d USING (id) WHERE coalesce(degree, 0) < 40),
 kept AS (SELECT * FROM k WHERE src NOT IN (SELECT id FROM low) AND dst NOT IN (SELECT id FROM low)), left_over AS (SELECT src AS id FROM kept UNION SELECT dst FROM kept)"""


@query("g16_clean_graph", CLEAN_SQL + """ SELECT (SELECT count(*) FROM v) AS original_nodes, (SELECT count(*) FROM raw) AS original_edges, (SELECT count(*) FROM raw WHERE src = dst) AS self_loops_removed,
 (SELECT count(*) FROM raw WHERE src <> dst) - (SELECT count(*) FROM k) AS duplicate_edges_removed, (SELECT count(*) FROM low) AS low_degree_nodes_removed,
 (SELECT count(*) FROM v) - (SELECT count(*) FROM low) - (SELECT count(*) FROM left_over) AS isolated_nodes_removed, 0 AS disconnected_components_removed, (SELECT count(*) FROM left_over) AS final_nodes, (SELECT count(*) FROM kept) AS final_edges""")
def g16(spark, sf):
    return gcl.clean_graph(parts(spark, sf), min_degree=40).stats_table()


@query("g17_clean_graph_advanced")
def g17(spark, sf):
    return gcl.clean_graph_advanced(pages(spark, sf), min_degree=2, min_component_size=8).stats_table()


@query("g18_subgraph", f"WITH {PARTS} SELECT src, dst FROM e WHERE src IN (SELECT p_partkey FROM part WHERE p_size > 25) AND dst IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def g18(spark, sf):
    ids = table(spark, sf, "part").filter("p_size > 25").select(F.col("p_partkey").alias("id"))
    return gg.subgraph(dense(spark, sf), ids).edges.select("src", "dst")


@query("g18_limit_nodes", f"""WITH {PARTS}, f AS (SELECT id, min(pos) AS pos FROM (SELECT src AS id, _row_id * 2 AS pos FROM raw UNION ALL SELECT dst, _row_id * 2 + 1 FROM raw) GROUP BY 1 ORDER BY pos, id LIMIT 500)
 SELECT src, dst, count(*) AS n FROM raw WHERE src IN (SELECT id FROM f) AND dst IN (SELECT id FROM f) GROUP BY 1, 2""")
def g18l(spark, sf):
    return gg.limit_nodes(parts(spark, sf), 500).edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


# --- local measures ----------------------------------------------------------------------------

@query("g20_degree_centrality", f"WITH {PARTS} SELECT id, round(degree / ((SELECT count(*) FROM v) - 1.0), 6) AS degree_centrality FROM deg")
def g20(spark, sf):
    return gr.degree_centrality(parts(spark, sf)).selectExpr("id", "round(degree_centrality, 6) AS degree_centrality")


PR_SQL = f"""WITH RECURSIVE {USERS}, o AS (SELECT src AS id, count(*) AS k FROM e GROUP BY 1), pr(i, id, x) AS (SELECT 0, id, 1.0::DOUBLE / n FROM v, nn UNION ALL
 SELECT i, id, 0.15 / n + 0.85 * (s + sum(lost) OVER () / n) FROM (SELECT p.i + 1 AS i, p.id, coalesce(q.s, 0) AS s, CASE WHEN o.k IS NULL THEN p.x ELSE 0 END AS lost
 FROM pr p LEFT JOIN o ON o.id = p.id LEFT JOIN (SELECT e.dst AS id, sum(r.x / o.k) AS s FROM pr r JOIN e ON e.src = r.id JOIN o ON o.id = r.id GROUP BY 1) q ON q.id = p.id WHERE p.i < 80), nn)"""


@query("g21_pagerank", PR_SQL + " SELECT id, round(x, 6) AS pagerank FROM pr WHERE i = 80")
def g21(spark, sf):
    return gr.pagerank(flow(spark, sf), tol=1e-10).selectExpr("id", "round(pagerank, 6) AS pagerank")


TRI_SQL = f"""WITH {PARTS}, t AS (SELECT x.src AS i, x.dst AS j, y.dst AS k FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst WHERE x.src < x.dst AND y.src < y.dst),
 tc AS (SELECT id, count(*) AS t FROM (SELECT i AS id FROM t UNION ALL SELECT j FROM t UNION ALL SELECT k FROM t) GROUP BY 1), kk AS (SELECT id, count(*) AS k FROM a GROUP BY 1),
 cl AS (SELECT v.id, coalesce(t, 0) AS triangles, coalesce(k, 0) AS k, CASE WHEN k > 1 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END AS clustering FROM v LEFT JOIN tc USING (id) LEFT JOIN kk USING (id))"""


@query("g22_triangles", TRI_SQL + " SELECT id, triangles FROM cl")
def g22(spark, sf):
    return gmo.triangles(dense(spark, sf))


@query("g23_clustering", TRI_SQL + " SELECT id, round(clustering, 6) AS clustering FROM cl")
def g23(spark, sf):
    return gmo.clustering(dense(spark, sf)).selectExpr("id", "round(clustering, 6) AS clustering")


@query("g23_clustering_summary", TRI_SQL + " SELECT round(avg(clustering), 6) AS average_clustering, round(sum(triangles) / sum(k * (k - 1) / 2), 6) AS transitivity FROM cl")
def g23s(spark, sf):
    return gmo.clustering_summary(dense(spark, sf)).selectExpr("round(average_clustering, 6) AS average_clustering", "round(transitivity, 6) AS transitivity")


@query("g24_common_neighbors", f"WITH {PARTS}, p AS (SELECT x.id AS src, y.id AS dst, count(*) AS c FROM a x JOIN a y ON x.nbr = y.nbr GROUP BY 1, 2) SELECT e.src, e.dst, coalesce(c, 0) AS common FROM e LEFT JOIN p USING (src, dst) WHERE src <> dst")
def g24(spark, sf):
    return gmo.common_neighbors(dense(spark, sf))


@query("g25_square_count", f"""WITH {PARTS}, p AS (SELECT x.id AS s, y.id AS t, count(*) AS c FROM a x JOIN a y ON x.nbr = y.nbr AND x.id < y.id GROUP BY 1, 2)
 SELECT v.id, CAST(coalesce(n, 0) AS BIGINT) AS square_count FROM v LEFT JOIN (SELECT x.nbr AS id, sum(c - 1) AS n FROM a x JOIN a y ON x.nbr = y.nbr AND x.id < y.id JOIN p ON p.s = x.id AND p.t = y.id GROUP BY 1) USING (id)""")
def g25(spark, sf):
    return gmo.square_count(dense(spark, sf))


@query("g26_wedge_count", f"WITH {PARTS} SELECT id, CAST(degree * (degree - 1) // 2 AS BIGINT) AS wedge_count FROM deg")
def g26(spark, sf):
    return gmo.wedge_count(parts(spark, sf))


@query("g27_neighbor_degree", f"""WITH {USERS} SELECT v.id, round(coalesce(x, 0), 6) AS avg_neighbor_degree, coalesce(k, 0) AS num_neighbors FROM v LEFT JOIN
 (SELECT src AS id, avg(degree) AS x, count(*) AS k FROM e JOIN deg ON deg.id = dst GROUP BY 1) USING (id)""")
def g27(spark, sf):
    return gmo.neighbor_degree(flow(spark, sf)).selectExpr("id", "round(avg_neighbor_degree, 6) AS avg_neighbor_degree", "num_neighbors")


@query("g28_in_degree_ratio", f"WITH {USERS} SELECT id, round(in_degree * 1.0 / degree, 6) AS in_degree_ratio FROM deg")
def g28(spark, sf):
    return gmo.in_degree_ratio(users(spark, sf)).selectExpr("id", "round(in_degree_ratio, 6) AS in_degree_ratio")


# --- paths -------------------------------------------------------------------------------------

# Distances by rounds; a pair appears once, at its first round.
DIST_SQL = f"""WITH RECURSIVE {PAGES}, dist(s, t, d) USING KEY (s, t) AS (SELECT id, id, 0 FROM v UNION
 SELECT x.s, a.nbr, min(x.d + 1) FROM dist x JOIN a ON a.id = x.t LEFT JOIN recurring.dist o ON o.s = x.s AND o.t = a.nbr WHERE o.d IS NULL GROUP BY 1, 2)"""


@query("g29_shortest_path_stats", DIST_SQL + """, r AS (SELECT s, max(d) AS e, sum(d) AS t, count(*) AS c FROM dist GROUP BY 1), z AS (SELECT min(c) = (SELECT n FROM nn) AS connected, sum(t) AS t, max(e) AS dia, min(e) AS rad FROM r)
 SELECT connected, round(CASE WHEN connected THEN t * 1.0 / (n * (n - 1)) ELSE 0 END, 6) AS average_path_length, CASE WHEN connected THEN dia ELSE 0 END AS diameter, CASE WHEN connected THEN rad ELSE 0 END AS radius FROM z, nn""")
def g29(spark, sf):
    return gp.shortest_path_stats(sparse(spark, sf)).selectExpr("connected", "round(average_path_length, 6) AS average_path_length", "diameter", "radius")


# The same on a connected graph: the user graph read without direction.
CONNECTED_SQL = f"""WITH RECURSIVE {USERS}, a AS (SELECT src AS id, dst AS nbr FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst),
 l(s, t, d) AS (SELECT id, id, 0 FROM v UNION SELECT l.s, a.nbr, l.d + 1 FROM l JOIN a ON a.id = l.t WHERE l.d < 6),
 dist AS (SELECT s, t, min(d) AS d FROM l GROUP BY 1, 2), r AS (SELECT s, max(d) AS e, sum(d) AS t, count(*) AS c FROM dist GROUP BY 1)
 SELECT min(c) = (SELECT n FROM nn) AS connected, round(sum(t) * 1.0 / ((SELECT n FROM nn) * ((SELECT n FROM nn) - 1)), 6) AS average_path_length, max(e) AS diameter, min(e) AS radius FROM r"""


@query("g29_connected_path_stats", CONNECTED_SQL)
def g29c(spark, sf):
    g = flow(spark, sf)
    s = gp.shortest_path_stats(gg.simple(gg.Graph(g.vertices, g.edges, False)))
    return s.selectExpr("connected", "round(average_path_length, 6) AS average_path_length", "diameter", "radius")


@query("g29_eccentricity", DIST_SQL + " SELECT t AS id, max(d) AS eccentricity FROM dist GROUP BY 1")
def g29e(spark, sf):
    return gp.eccentricity(sparse(spark, sf))


@query("g30_closeness", DIST_SQL + " SELECT v.id, round(coalesce(c, 0), 6) AS closeness FROM v LEFT JOIN (SELECT t AS id, count(*) * 1.0 / sum(d) * count(*) / ((SELECT n FROM nn) - 1) AS c FROM dist WHERE d > 0 GROUP BY 1) USING (id)")
def g30(spark, sf):
    return gp.closeness(sparse(spark, sf)).selectExpr("id", "round(closeness, 6) AS closeness")


# Path counts level by level, then pair dependencies through every middle vertex.
BETWEEN_SQL = f"""WITH RECURSIVE {USERS}, l(s, t, d, sigma) AS (SELECT id, id, 0, 1.0::DOUBLE FROM v UNION ALL SELECT * FROM (
 SELECT l.s, e.dst, l.d + 1 AS d, sum(l.sigma) AS sigma FROM l JOIN e ON e.src = l.t AND e.src <> e.dst WHERE l.d < 4 GROUP BY 1, 2, 3)),
 f AS (SELECT s, t, min(d) AS d, arg_min(sigma, d) AS sigma FROM l GROUP BY 1, 2),
 b AS (SELECT x.t AS id, sum(x.sigma * y.sigma / z.sigma) AS b FROM f x JOIN f y ON x.t = y.s JOIN f z ON z.s = x.s AND z.t = y.t AND z.d = x.d + y.d WHERE x.d > 0 AND y.d > 0 AND x.s <> y.t GROUP BY 1)
 SELECT v.id, round(coalesce(b, 0) / ((n - 1.0) * (n - 2)), 6) AS betweenness FROM v CROSS JOIN nn LEFT JOIN b USING (id)"""


@query("g31_betweenness", BETWEEN_SQL)
def g31(spark, sf):
    return gp.betweenness(flow(spark, sf)).selectExpr("id", "round(betweenness, 6) AS betweenness")


@query("g32_articulation_points", f"WITH RECURSIVE {PAGES}, {CUTS_SQL}")
def g32(spark, sf):
    return gb.articulation_points(sparse(spark, sf))


@query("g32_territory_points", f"WITH RECURSIVE {TERRITORY}, {CUTS_SQL}")
def g32t(spark, sf):
    return gb.articulation_points(territory(spark, sf))


EIG_SQL = f"""WITH RECURSIVE {PARTS}, b AS (SELECT * FROM a UNION ALL SELECT src, dst FROM e WHERE src = dst), x(i, id, x) AS (SELECT 0, id, 1.0::DOUBLE FROM v UNION ALL SELECT i, id, y / max(y) OVER () FROM (
 SELECT p.i + 1 AS i, p.id, p.x + coalesce(s.s, 0) AS y FROM x p LEFT JOIN (SELECT b.nbr AS id, sum(q.x) AS s FROM x q JOIN b ON b.id = q.id GROUP BY 1) s USING (id) WHERE p.i < 120))"""


@query("g33_eigenvector", EIG_SQL + " SELECT id, round(x / sqrt((SELECT sum(x * x) FROM x WHERE i = 120)), 6) AS eigenvector FROM x WHERE i = 120")
def g33(spark, sf):
    return gr.eigenvector_centrality(dense(spark, sf), tol=1e-13).selectExpr("id", "round(eigenvector, 6) AS eigenvector")


KATZ_SQL = f"""WITH RECURSIVE {PARTS}, b AS (SELECT * FROM a UNION ALL SELECT src, dst FROM e WHERE src = dst), x(i, id, x) AS (SELECT 0, id, 0.0::DOUBLE FROM v UNION ALL
 SELECT p.i + 1, p.id, 1 + 0.01 * coalesce(s.s, 0) FROM x p LEFT JOIN (SELECT b.nbr AS id, sum(q.x) AS s FROM x q JOIN b ON b.id = q.id GROUP BY 1) s USING (id) WHERE p.i < 60)"""


@query("g34_katz", KATZ_SQL + " SELECT id, round(x / sqrt((SELECT sum(x * x) FROM x WHERE i = 60)), 6) AS katz FROM x WHERE i = 60")
def g34(spark, sf):
    return gr.katz_centrality(dense(spark, sf), alpha=0.01, tol=1e-12).selectExpr("id", "round(katz, 6) AS katz")


@query("g35_local_efficiency")
def g35(spark, sf):
    return gp.local_efficiency(dense(spark, sf))


@query("g36_core_number")
def g36(spark, sf):
    g = gcl.remove_self_loops(dense(spark, sf))
    return gr.core_number(g)


@query("g37_degree_distribution_stats", f"""WITH {PARTS}, r AS (SELECT degree::DOUBLE AS degree, row_number() OVER (ORDER BY degree) AS i FROM deg), m AS (SELECT avg(degree) AS m, stddev_pop(degree) AS s, count(*) AS n, sum(degree) AS t FROM r)
 SELECT round(m, 6) AS degree_mean, round(s, 6) AS degree_std, round((SELECT avg(power((degree - m) / s, 3)) FROM r), 5) AS degree_skewness, round(2 * (SELECT sum(i * degree) FROM r) / (n * t) - (n + 1.0) / n, 6) AS degree_gini FROM m""")
def g37(spark, sf):
    return gm.degree_distribution_stats(parts(spark, sf)).selectExpr("round(degree_mean, 6) AS degree_mean", "round(degree_std, 6) AS degree_std", "round(degree_skewness, 5) AS degree_skewness", "round(degree_gini, 6) AS degree_gini")


@query("g38_centralization", f"WITH {PARTS} SELECT round((count(*) * max(degree) - sum(degree)) / ((count(*) - 1.0) * (count(*) - 2)), 6) AS centralization FROM deg")
def g38(spark, sf):
    return gm.centralization(gg.degrees(parts(spark, sf)), "degree").selectExpr("round(centralization, 6) AS centralization")


@query("g39_degree_assortativity", f"WITH {PARTS}, p AS (SELECT x.degree AS a, y.degree AS b FROM e JOIN deg x ON x.id = src JOIN deg y ON y.id = dst) SELECT round(corr(a, b), 6) AS degree_assortativity FROM (SELECT a, b FROM p UNION ALL SELECT b, a FROM p)")
def g39(spark, sf):
    return gm.degree_assortativity(dense(spark, sf)).selectExpr("round(degree_assortativity, 6) AS degree_assortativity")


@query("g40_rich_club", f"""WITH {PARTS}, p AS (SELECT least(x.degree, y.degree) AS m FROM e JOIN deg x ON x.id = src JOIN deg y ON y.id = dst WHERE src <> dst), ks AS (SELECT DISTINCT degree AS k FROM deg),
 c AS (SELECT k, (SELECT count(*) FROM deg WHERE degree > k) AS n, (SELECT count(*) FROM p WHERE m > k) AS e FROM ks) SELECT CAST(k AS BIGINT) AS k, round(2.0 * e / (n * (n - 1)), 6) AS rich_club FROM c WHERE n > 1""")
def g40(spark, sf):
    return gm.rich_club(dense(spark, sf)).selectExpr("k", "round(rich_club, 6) AS rich_club")


@query("g41_small_world")
def g41(spark, sf):
    return gm.small_world(sparse(spark, sf))


# --- communities, spectrum, embeddings ---------------------------------------------------------

@query("g42_louvain")
def g42(spark, sf):
    return gc.louvain(dense(spark, sf))


# Each nation with its suppliers is a star; a ring joins the nations so weakly that merging two never gains.
STARS = """hub AS (SELECT -(s_nationkey + 1) AS id FROM supplier GROUP BY 1), ring AS (SELECT id, lead(id) OVER (ORDER BY id) AS nxt FROM hub),
 e AS (SELECT -(s_nationkey + 1) AS src, s_suppkey AS dst, 1.0 AS w FROM supplier
  UNION ALL SELECT id, nxt, 0.1 / (SELECT count(*) FROM supplier) FROM ring WHERE nxt IS NOT NULL),
 pt AS (SELECT s_suppkey AS id, -(s_nationkey + 1) AS c FROM supplier UNION ALL SELECT id, id FROM hub)"""


def stars(spark: SparkSession, sf: str) -> gg.Graph:
    s = table(spark, sf, "supplier").selectExpr("-(s_nationkey + 1) AS src", "s_suppkey AS dst")
    hub = s.selectExpr("src AS id").distinct()
    ring = hub.select(F.col("id").alias("src"), F.lead("id").over(W.orderBy("id")).alias("dst")).filter("dst IS NOT NULL")
    far = ring.crossJoin(F.broadcast(s.agg((0.1 / F.count("*")).alias("weight"))))
    e = s.withColumn("weight", F.lit(1.0)).unionByName(far)
    return gg.from_edges(e.select(F.col("src").cast("long"), F.col("dst").cast("long"), "weight", F.xxhash64("src", "dst").alias(ROW_ID)))


@query("g42_louvain_stars", f"""WITH {STARS}, tot AS (SELECT sum(w) AS m FROM e),
 i AS (SELECT a.c, sum(w) AS l FROM e JOIN pt a ON src = a.id JOIN pt b ON dst = b.id WHERE a.c = b.c GROUP BY 1),
 d AS (SELECT c, sum(w) AS k FROM (SELECT src AS id, w FROM e UNION ALL SELECT dst, w FROM e) JOIN pt USING (id) GROUP BY 1),
 q AS (SELECT sum(l / m - (k / (2 * m)) * (k / (2 * m))) AS modularity FROM i JOIN d USING (c), tot)
 SELECT CAST(id AS BIGINT) AS id, CAST(c AS BIGINT) AS community, round(modularity, 9) AS modularity FROM pt, q""")
def g42s(spark, sf):
    g = stars(spark, sf)
    part = cut(gc.louvain(g, tolerance=0))
    return part.crossJoin(F.broadcast(gc.modularity(g, part))).selectExpr("id", "community", "round(modularity, 9) AS modularity")


# Contract of both community searches: at least the modularity of single vertices.
@query("g42_louvain_quality", f"WITH {PAGES} SELECT count(*) AS nodes, true AS better_than_single FROM v")
def g42q(spark, sf):
    g = sparse(spark, sf)
    part = cut(gc.louvain(g))
    single = gc.modularity(g, g.vertices.selectExpr("id", "id AS community")).withColumnRenamed("modularity", "single")
    return part.agg(F.count("*").alias("nodes")).join(F.broadcast(gc.modularity(g, part))).join(F.broadcast(single)).selectExpr("nodes", "modularity > single AS better_than_single")


@query("g43_greedy_communities", f"WITH {PAGES} SELECT count(*) AS nodes, true AS better_than_single FROM v")
def g43(spark, sf):
    g = sparse(spark, sf)
    part = cut(gc.greedy_communities(g))
    single = gc.modularity(g, g.vertices.selectExpr("id", "id AS community")).withColumnRenamed("modularity", "single")
    return part.agg(F.count("*").alias("nodes")).join(F.broadcast(gc.modularity(g, part))).join(F.broadcast(single)).selectExpr("nodes", "modularity > single AS better_than_single")


@query("g43_community_labels")
def g43l(spark, sf):
    return gc.community_labels(gc.greedy_communities(sparse(spark, sf)))


# A known partition for the checkable measures: parts by brand.
BRAND_SQL = f"WITH {PARTS}, pt AS (SELECT p_partkey AS id, p_brand AS c FROM part)"


def brands(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey AS id", "p_brand AS community")


@query("g44_modularity", BRAND_SQL + """, l AS (SELECT x.c AS a, y.c AS b, weight AS w FROM e JOIN pt x ON x.id = src JOIN pt y ON y.id = dst), s AS (SELECT c, sum(l) AS l, sum(d) AS d FROM (SELECT a AS c, CASE WHEN a = b THEN w ELSE 0 END AS l, w AS d FROM l UNION ALL SELECT b, 0, w FROM l) GROUP BY 1)
 SELECT round(2 * sum(l) / sum(d) - sum(d * d) / (sum(d) * sum(d)), 6) AS modularity FROM s""")
def g44(spark, sf):
    return gc.modularity(dense(spark, sf), brands(spark, sf)).selectExpr("round(modularity, 6) AS modularity")


INSIDE_SQL = BRAND_SQL + ", i AS (SELECT a.id, count(*) AS nb, count(*) FILTER (x.c = y.c) AS own FROM a JOIN pt x ON x.id = a.id JOIN pt y ON y.id = a.nbr GROUP BY 1)"


@query("g45_community_features", INSIDE_SQL + """, z AS (SELECT c, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(id)) - 1 AS r FROM pt GROUP BY 1)
 SELECT pt.id, r AS community_id, n AS community_size, round(coalesce(own, 0) * 1.0 / greatest(1, coalesce(nb, 0)), 6) AS internal_ratio FROM pt JOIN z USING (c) LEFT JOIN i USING (id)""")
def g45(spark, sf):
    return gc.community_features(dense(spark, sf), brands(spark, sf)).selectExpr("id", "community_id", "community_size", "round(internal_ratio, 6) AS internal_ratio")


# Eigenvalues are checked by their residuals: both sides report whether every |Lx - lambda x| is small.
@query("g46_laplacian_eigenvectors", f"WITH {USERS} SELECT n AS nodes, true AS zero_first, true AS residual_small FROM nn")
def g46(spark, sf):
    g = flow(spark, sf)
    g = gg.simple(gg.Graph(g.vertices, g.edges, False))
    vec, lam = gr.laplacian_eigenvectors(g, 3)
    vec = cut(vec)
    names = [n for n in vec.columns if n != "id"]
    adj = gp.adjacency(g).select("id", "nbr").distinct()
    came = adj.join(vec.withColumnRenamed("id", "nbr"), "nbr").groupBy("id").agg(F.count("*").alias("k"), *[F.sum(v).alias(f"s_{v}") for v in names])
    res = vec.join(came, "id", "left").agg(F.count("*").alias("nodes"), *[
        F.sqrt(F.sum(F.expr(f"pow(coalesce(k, 0) * {v} - coalesce(s_{v}, 0D) - {lam[i]!r}D * {v}, 2)"))).alias(f"r{i}") for i, v in enumerate(names)])
    return res.selectExpr("nodes", f"{str(abs(lam[0]) < 1e-6).lower()} AS zero_first", f"greatest({', '.join(f'r{i}' for i in range(len(names)))}) < 0.05D * {max(1.0, lam[-1])!r}D AS residual_small")


@query("g47_node2vec")
def g47(spark, sf):
    return gf.node2vec(flow(spark, sf), walks=10).selectExpr("id", "size(embedding) AS dims")


@query("g47_random_walks", f"WITH {USERS} SELECT count(*) * 5 AS walks, true AS all_edges FROM v")
def g47w(spark, sf):
    g = flow(spark, sf)
    w = cut(gf.random_walks(g, 10, 5))
    steps = w.selectExpr("explode(arrays_zip(slice(path, 1, size(path) - 1), slice(path, 2, size(path) - 1))) AS s").selectExpr("CAST(s.`0` AS LONG) AS src", "CAST(s.`1` AS LONG) AS dst")
    off = steps.join(g.edges.select("src", "dst"), ["src", "dst"], "left_anti").agg(F.count("*").alias("off"))
    return w.agg(F.count("*").alias("walks")).join(F.broadcast(off)).selectExpr("walks", "off = 0 AS all_edges")


# --- feature tables and labels -----------------------------------------------------------------

@query("g48_node_features")
def g48(spark, sf):
    return gf.node_features(flow(spark, sf))


@query("g49_node_features_advanced")
def g49(spark, sf):
    return gf.node_features_advanced(sparse(spark, sf), ("centrality", "structural", "community", "motif"))


@query("g50_label_degree", f"""WITH {PARTS} SELECT id, CASE WHEN degree <= (SELECT quantile_cont(degree, 0.33) FROM deg) THEN 'Low_Degree' WHEN degree <= (SELECT quantile_cont(degree, 0.67) FROM deg) THEN 'Medium_Degree' ELSE 'High_Degree' END AS label FROM deg""")
def g50(spark, sf):
    return gf.label_degree(parts(spark, sf))


@query("g50_label_flow_role", f"""WITH {USERS} SELECT id, CASE WHEN in_degree = 0 AND out_degree > 0 THEN 'Source' WHEN out_degree = 0 AND in_degree > 0 THEN 'Sink' WHEN in_degree > 2 * out_degree THEN 'Receiver' WHEN out_degree > 2 * in_degree THEN 'Sender' ELSE 'Balanced' END AS label FROM deg""")
def g50d(spark, sf):
    return gf.label_degree(users(spark, sf))


@query("g51_label_centrality", f"WITH b AS ({BETWEEN_SQL.replace('round(coalesce(b, 0) / ((n - 1.0) * (n - 2)), 6)', 'round(coalesce(b, 0) / ((n - 1.0) * (n - 2)), 9)')}) SELECT id, CASE WHEN betweenness <= (SELECT quantile_cont(betweenness, 0.5) FROM b) THEN 'Peripheral' ELSE 'Central' END AS label FROM b")
def g51(spark, sf):
    b = gp.betweenness(flow(spark, sf)).selectExpr("id", "round(betweenness, 9) AS betweenness")
    return gf.label_centrality(b)


@query("g52_label_centrality3")
def g52(spark, sf):
    g = sparse(spark, sf)
    paths = gp.path_measures(g)
    return gf.label_centrality3(gp.betweenness(g, measures=paths), gp.closeness(g, measures=paths))


@query("g53_label_community_role", INSIDE_SQL + """ SELECT v.id, CASE WHEN coalesce(nb, 0) = 0 THEN 'Isolated' WHEN (nb - own) * 1.0 / nb > 0.5 THEN 'Bridge' WHEN own * 1.0 / nb > 0.8 THEN 'Core' ELSE 'Peripheral' END AS label FROM v LEFT JOIN i USING (id)""")
def g53(spark, sf):
    return gc.label_community_role(dense(spark, sf), brands(spark, sf))


@query("g54_label_structural_role", TRI_SQL + """ SELECT id, CASE WHEN degree = 0 THEN 'Isolated' WHEN degree = 1 THEN 'Pendant' WHEN clustering > 0.7 THEN 'Clustered' WHEN degree > (SELECT quantile_cont(degree, 0.9) FROM deg) THEN 'Hub' ELSE 'Regular' END AS label FROM cl JOIN deg USING (id)""")
def g54(spark, sf):
    return gf.label_structural_role(dense(spark, sf))


@query("g55_graph_metrics")
def g55(spark, sf):
    return gf.graph_metrics(flow(spark, sf))


@query("g55_graph_metrics_advanced")
def g55a(spark, sf):
    return gf.graph_metrics_advanced(sparse(spark, sf))


@query("g57_graph_analytics_summary")
def g57(spark, sf):
    g = flow(spark, sf)
    return gf.graph_analytics_summary(gg.simple(gg.Graph(g.vertices, g.edges, False)))
