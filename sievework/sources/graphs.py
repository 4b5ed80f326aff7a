"""Graph file sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.columns import ROW_ID, c
from sievework.operators.graph import Graph, from_edges

# Column names read as edge ends or weights, compared in lower case.
SOURCE_NAMES = ["source", "src", "from", "node1", "u", "start"]
TARGET_NAMES = ["target", "dst", "to", "node2", "v", "end"]
WEIGHT_NAMES = ["weight", "w", "cost", "distance", "strength"]


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def _as_edges(df: DataFrame, src: str, dst: str, weight: str | None) -> DataFrame:
    w = F.expr(f"try_cast(`{weight}` AS DOUBLE)") if weight else F.lit(None).cast("double")
    row = c(ROW_ID) if ROW_ID in df.columns else F.monotonically_increasing_id()
    return df.select(c(src).cast("string").alias("src"), c(dst).cast("string").alias("dst"), w.alias("weight"), row.alias(ROW_ID)).filter(
        "src IS NOT NULL AND dst IS NOT NULL")


def read_edges_csv(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """First two columns are the ends, the third the weight when asked for."""
    df = _csv(spark, path)
    if len(df.columns) < 2:
        raise ValueError("an edge table needs at least two columns")
    weight = df.columns[2] if weighted and len(df.columns) > 2 else None
    return _as_edges(df, df.columns[0], df.columns[1], weight)


def detect_edge_columns(df: DataFrame) -> DataFrame:
    """Edges by well-known column names, otherwise by position."""
    cols = [n for n in df.columns if n != ROW_ID]
    if len(cols) < 2:
        raise ValueError("an edge table needs at least two columns")
    pick = lambda names: next((n for n in cols if n.lower() in names), None)
    src, dst, weight = pick(SOURCE_NAMES), pick(TARGET_NAMES), pick(WEIGHT_NAMES)
    if src is None or dst is None:
        src, dst, weight = cols[0], cols[1], cols[2] if len(cols) > 2 else None
    return _as_edges(df, src, dst, weight)


def read_edges_text(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """Whitespace-separated lines; comments and short lines are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter(~F.ltrim("value").startswith("#")).select(parts.alias("p"), F.monotonically_increasing_id().alias(ROW_ID))
    weight = "try_cast(get(p, 2) AS DOUBLE)" if weighted else "CAST(NULL AS DOUBLE)"
    return lines.filter(F.size("p") >= 2).selectExpr("p[0] AS src", "p[1] AS dst", f"{weight} AS weight", ROW_ID)


def read_node_link_json(spark: SparkSession, path: str, directed: bool = False) -> Graph:
    """Node-link JSON, either one document or the JSON lines written by `write_node_link_json`.

    A missing weight counts as one.
    """
    lines = spark.read.json(path)
    if "links" not in lines.columns and "source" not in lines.columns:
        lines = spark.read.option("multiLine", True).json(path)
    if "links" in lines.columns:
        links = lines.select(F.explode("links").alias("l")).select("l.*")
        nodes = lines.select(F.explode("nodes").alias("n")).select("n.*") if "nodes" in lines.columns else None
    else:
        links = lines.filter("source IS NOT NULL")
        nodes = lines.filter("source IS NULL")
    weights = [F.col(n).cast("double") for n in ("weight", "value") if n in links.columns]
    edges = links.select(
        F.col("source").cast("string").alias("src"), F.col("target").cast("string").alias("dst"),
        F.coalesce(*weights, F.lit(1.0)).alias("weight"), F.monotonically_increasing_id().alias(ROW_ID))
    vertices = None
    if nodes is not None:
        names = [F.col(n).cast("string") for n in ("id", "name") if n in nodes.columns]
        vertices = nodes.select(F.coalesce(*names).alias("id")).filter("id IS NOT NULL") if names else None
    return from_edges(edges, directed, vertices)


def read_graph_xml(spark: SparkSession, path: str, directed: bool | None = None) -> Graph:
    """GraphML or GEXF edges and nodes. `directed` overrides the file's edge default."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("_source", "_target", "_weight")])
    edges = spark.read.format("xml").option("rowTag", "edge").schema(schema).load(path)
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id string").load(path)
    if directed is None:
        head = spark.read.format("xml").option("rowTag", "graph").schema("_edgedefault string, _defaultedgetype string").load(path)
        kinds = head.selectExpr("coalesce(_edgedefault, _defaultedgetype) AS k").head(1)
        directed = bool(kinds) and kinds[0].k == "directed"
    e = edges.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), F.col("_weight").try_cast("double").alias("weight"), F.monotonically_increasing_id().alias(ROW_ID))
    return from_edges(e.filter("src IS NOT NULL AND dst IS NOT NULL"), directed, nodes.select(F.col("_id").alias("id")).filter("id IS NOT NULL"))


def read_graph(spark: SparkSession, path: str, directed: bool = False, weighted: bool = False) -> Graph:
    """Choose the reader by file extension; unknown files are tried as edge list, then as CSV."""
    name = path.rstrip("/").lower()
    if name.endswith((".graphml", ".gexf", ".xml")):
        return read_graph_xml(spark, path, directed or None)
    if name.endswith(".json"):
        return read_node_link_json(spark, path, directed)
    if name.endswith(".csv"):
        return from_edges(detect_edge_columns(_csv(spark, path)), directed)
    if name.endswith((".txt", ".edgelist", ".edges")):
        return from_edges(read_edges_text(spark, path, weighted), directed)
    edges = read_edges_text(spark, path, weighted)
    if not edges.isEmpty():
        return from_edges(edges, directed)
    try:
        return from_edges(detect_edge_columns(_csv(spark, path)), directed)
    except ValueError as err:
        raise ValueError(f"unsupported graph file: {path}") from err


def write_edges(g: Graph, path: str, fmt: str = "csv") -> None:
    if fmt == "csv":
        g.edges.selectExpr("src AS source", "dst AS target", "weight").write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "edgelist":
        g.edges.selectExpr("concat_ws(' ', src, dst, weight) AS value").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unsupported edge format: {fmt}")


def write_nodes(nodes: DataFrame, path: str) -> None:
    """Vertex table with its attribute columns."""
    rest = [n for n in nodes.columns if n != "id"]
    nodes.select(F.col("id").alias("node_id"), *[c(n) for n in rest]).write.mode("overwrite").option("header", True).csv(path)


def write_node_link_json(g: Graph, path: str) -> None:
    """Nodes and links as JSON lines, so that no single document has to hold the graph."""
    nodes = g.vertices.select(F.to_json(F.struct("id")).alias("value"))
    links = g.edges.select(F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "weight")).alias("value"))
    nodes.unionByName(links).write.mode("overwrite").text(path)


def edge_file_counts(spark: SparkSession, path: str) -> DataFrame:
    """Edge and vertex counts of an edge file, one row."""
    g = read_graph(spark, path)
    return g.edges.agg(F.count("*").alias("edges")).join(F.broadcast(g.vertices.agg(F.count("*").alias("nodes"))))  # one row each
