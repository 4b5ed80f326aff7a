"""Queries over tables: sources, profiling, rules, duplicates, imputation, outliers, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.catalog.registry import query, scratch, table
from sievework.functions.columns import (
    ROW_ID,
    c,
    clip_to_range,
    extract_numeric,
)
from sievework.operators import dedup, encode, impute, outliers, profile, rules, synth
from sievework.sources import tables as io

# Orders with planted gaps. No row is dropped; the predicates only blank single cells.
GAPS_SQL = """(SELECT o_orderkey AS _row_id,
 CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_totalprice END AS price,
 CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END AS status,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS odate,
 o_orderpriority AS priority, o_custkey AS cust FROM orders)"""


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    blank = lambda n, step: F.when(k % step != 0, F.col(n))
    return table(spark, sf, "orders").select(
        k.alias(ROW_ID), blank("o_totalprice", 23).alias("price"), blank("o_orderstatus", 17).alias("status"),
        blank("o_orderdate", 7).alias("odate"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("cust"))


def rnd(cols: list[str], places: int = 4):
    return [F.round(c(n), places).alias(n) for n in cols]


# --- sources and sinks -------------------------------------------------------------------------

@query("s1_read_table", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, row_number() OVER (ORDER BY c_custkey) - 1 AS _row_id FROM customer")
def s1(spark, sf):
    path = scratch(spark, "customer.csv")
    io.write_table(table(spark, sf, "customer").repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey"), path)
    df = io.read_table(spark, path)
    return df.withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("s2_load_report", """SELECT * FROM (SELECT count(*) AS total_rows, 6 AS total_columns FROM orders),
 (VALUES ('o_orderkey',0),('o_custkey',1),('o_orderstatus',2),('o_totalprice',3),('o_orderdate',4),('o_orderpriority',5)) t(column_name, position)""")
def s2(spark, sf):
    return profile.load_report(table(spark, sf, "orders"))


@query("s10_read_image_labels", "SELECT 'doc' || doc_id AS name, CAST(quality AS VARCHAR) AS label FROM labels")
def s10(spark, sf):
    path = scratch(spark, "labels.csv")
    src = table(spark, sf, "labels").select(F.concat(F.lit("doc"), F.col("doc_id")).alias("image"), "quality", "toxic")
    src.write.option("header", True).csv(path)
    return io.read_image_labels(spark, path, "quality").drop(ROW_ID)


@query("s12_write_table", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer GROUP BY 1")
def s12(spark, sf):
    path = scratch(spark, "customer.parquet")
    io.write_table(table(spark, sf, "customer"), path, "parquet")
    return spark.read.parquet(path).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("bal"))


@query("s13_write_report", f"""SELECT 'price' AS column_name, count(*) FILTER (price IS NULL) AS total_missing, round(count(*) FILTER (price IS NULL) * 100.0 / count(*), 2) AS missing_percentage FROM {GAPS_SQL}
 UNION ALL SELECT 'status', count(*) FILTER (status IS NULL), round(count(*) FILTER (status IS NULL) * 100.0 / count(*), 2) FROM {GAPS_SQL}
 UNION ALL SELECT 'odate', count(*) FILTER (odate IS NULL), round(count(*) FILTER (odate IS NULL) * 100.0 / count(*), 2) FROM {GAPS_SQL}""")
def s13(spark, sf):
    path = scratch(spark, "report.json")
    io.write_report(profile.missing_report(gaps(spark, sf)), path)
    return spark.read.schema("column_name string, total_missing long, missing_percentage double").json(path)


@query("s17_write_stats_row", "SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_customers FROM orders")
def s17(spark, sf):
    path = scratch(spark, "stats.csv")
    stats = table(spark, sf, "orders").agg(F.count("*").alias("n_rows"), F.countDistinct("o_custkey").alias("n_customers"))
    io.write_stats_row(stats, path)
    return spark.read.option("header", True).schema("n_rows long, n_customers long").csv(path)


# --- profiling ---------------------------------------------------------------------------------

@query("p1_categorize_columns", f"""SELECT 'price' AS column_name, 'numeric' AS role, count(price) AS non_null FROM {GAPS_SQL}
 UNION ALL SELECT 'status', 'categorical', count(status) FROM {GAPS_SQL} UNION ALL SELECT 'odate', 'datetime', count(odate) FROM {GAPS_SQL}
 UNION ALL SELECT 'priority', 'categorical', count(priority) FROM {GAPS_SQL} UNION ALL SELECT 'cust', 'numeric', count(cust) FROM {GAPS_SQL}""")
def p1(spark, sf):
    return profile.roles_table(gaps(spark, sf))


@query("p2_categorical_domains", f"""SELECT DISTINCT 'status' AS column_name, status AS value FROM {GAPS_SQL} WHERE status IS NOT NULL
 UNION ALL SELECT DISTINCT 'priority', priority FROM {GAPS_SQL} WHERE priority IS NOT NULL""")
def p2(spark, sf):
    return profile.categorical_domains(gaps(spark, sf))


def _profile_sql(col: str, expr: str) -> str:
    return f"""SELECT '{col}' AS column_name, count(*) AS n_rows, count(*) - count({expr}) AS n_missing,
 count(DISTINCT {expr}) AS n_distinct, round((count(*) - count({expr})) * 100.0 / count(*), 2) AS missing_pct,
 round(min({expr}), 4) AS min, round(max({expr}), 4) AS max, round(avg({expr}), 4) AS mean, round(stddev_samp({expr}), 4) AS std,
 round((avg({expr}*{expr}*{expr}) - 3*avg({expr})*avg({expr}*{expr}) + 2*power(avg({expr}),3)) / power(stddev_pop({expr}),3), 4) AS skewness,
 round(quantile_cont({expr}, 0.05), 4) AS p05, round(quantile_cont({expr}, 0.5), 4) AS p50, round(quantile_cont({expr}, 0.95), 4) AS p95,
 CAST(sum(CASE WHEN {expr} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zeros, CAST(sum(CASE WHEN {expr} < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative FROM lineitem"""


@query("p3_profile", " UNION ALL ".join(_profile_sql(n, n) for n in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def p3(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    wide = profile.profile(profile.require_rows(df))
    return wide.select("column_name", "n_rows", "n_missing", "n_distinct", "missing_pct", *rnd(["min", "max", "mean", "std", "skewness", "p05", "p50", "p95"]), "n_zeros", "n_negative")


@query("p3_top_values", """SELECT column_name, value, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS INTEGER) AS rank FROM (
 SELECT 'o_orderpriority' AS column_name, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2
 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), count(*) FROM orders GROUP BY 2)) WHERE rank <= 3""")
def p3t(spark, sf):
    return profile.top_values(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus", "o_custkey"], 3)


@query("p3_profile_text", """SELECT column_name, n_rows, n_distinct, min_length, max_length, round(mean_length, 4) AS mean_length FROM (
 SELECT 'text' AS column_name, count(*) AS n_rows, count(DISTINCT text) AS n_distinct, CAST(min(length(text)) AS INTEGER) AS min_length, CAST(max(length(text)) AS INTEGER) AS max_length, avg(length(text)) AS mean_length FROM documents
 UNION ALL SELECT 'lang', count(*), count(DISTINCT lang), CAST(min(length(lang)) AS INTEGER), CAST(max(length(lang)) AS INTEGER), avg(length(lang)) FROM documents)""")
def p3x(spark, sf):
    wide = profile.profile(table(spark, sf, "documents").select("text", "lang"))
    return wide.select("column_name", "n_rows", "n_distinct", "min_length", "max_length", F.round("mean_length", 4).alias("mean_length"))


@query("p4_missing_report", f"""SELECT column_name, n AS total_missing, round(n * 100.0 / t, 2) AS missing_percentage FROM (
 SELECT 'price' AS column_name, count(*) FILTER (price IS NULL) AS n, count(*) AS t FROM {GAPS_SQL} UNION ALL
 SELECT 'status', count(*) FILTER (status IS NULL), count(*) FROM {GAPS_SQL} UNION ALL SELECT 'odate', count(*) FILTER (odate IS NULL), count(*) FROM {GAPS_SQL}) WHERE n > 0""")
def p4(spark, sf):
    return profile.missing_report(gaps(spark, sf))


@query("p4_missing_rows", f"""SELECT _row_id, 'price' AS column_name FROM {GAPS_SQL} WHERE price IS NULL UNION ALL
 SELECT _row_id, 'status' FROM {GAPS_SQL} WHERE status IS NULL UNION ALL SELECT _row_id, 'odate' FROM {GAPS_SQL} WHERE odate IS NULL""")
def p4r(spark, sf):
    return profile.missing_rows(gaps(spark, sf))


def _texts(spark, sf):
    """Orders as untyped text, the way a header-only reader would deliver them."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias(ROW_ID),
        F.when(F.col("o_orderstatus") == "F", " TRUE ").otherwise("0").alias("closed"),
        F.concat(F.format_string("%.2f", "o_totalprice"), F.lit(" USD")).alias("price"),
        F.when(F.col("o_custkey") % 19 == 0, "n/a").otherwise(F.concat(F.lit("c"), F.col("o_custkey"))).alias("cust"),
        F.col("o_orderkey").cast("string").alias("okey"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("odate"),
        F.col("o_orderpriority").alias("priority"),
    )


@query("p5_infer_boolean", """SELECT 'closed' AS column_name, true AS is_boolean UNION ALL SELECT 'okey', bool_and(lower(trim(CAST(o_orderkey AS VARCHAR))) IN ('true','false','1','0')) FROM orders
 UNION ALL SELECT 'priority', bool_and(lower(trim(o_orderpriority)) IN ('true','false','1','0')) FROM orders""")
def p5(spark, sf):
    return profile.infer_boolean(_texts(spark, sf), ["closed", "okey", "priority"])


@query("p6_extract_numeric", r"""SELECT page_id, TRY_CAST(nullif(regexp_extract(trim(url), '[-+]?(?:\d*\.\d+|\d+)', 0), '') AS DOUBLE) AS num FROM pages""")
def p6(spark, sf):
    return table(spark, sf, "pages").select("page_id", extract_numeric(F.col("url")).alias("num"))


@query("p7_infer_numeric_kind", r"""SELECT column_name, n_rows, n_distinct, CASE WHEN n_distinct * 1.0 / n_rows > 0.2 THEN CASE WHEN integral THEN 'int' ELSE 'float' END ELSE 'object' END AS kind FROM (
 SELECT column_name, count(*) AS n_rows, count(DISTINCT v) AS n_distinct, bool_and(v IS NOT NULL AND v = floor(v)) AS integral FROM (
 SELECT 'price' AS column_name, o_totalprice AS v FROM orders UNION ALL SELECT 'okey', CAST(o_orderkey AS DOUBLE) FROM orders
 UNION ALL SELECT 'cust', CASE WHEN o_custkey % 19 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END FROM orders
 UNION ALL SELECT 'priority', CAST(regexp_extract(o_orderpriority, '\d+', 0) AS DOUBLE) FROM orders) GROUP BY 1)""")
def p7(spark, sf):
    return profile.infer_numeric_kind(_texts(spark, sf), ["price", "okey", "cust", "priority"])


@query("p8_infer_datetime", """SELECT 'odate' AS column_name, bool_and(TRY_CAST(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) IS NOT NULL) AS is_datetime FROM orders
 UNION ALL SELECT 'priority', bool_and(TRY_CAST(o_orderpriority AS TIMESTAMP) IS NOT NULL) FROM orders""")
def p8(spark, sf):
    return profile.infer_datetime(_texts(spark, sf), ["odate", "priority"])


@query("p9_validate_types", """SELECT 'closed' AS column_name, 'boolean' AS inferred_type, CAST(0 AS BIGINT) AS invalid_entries_count UNION ALL SELECT 'price', 'float', 0
 UNION ALL SELECT 'cust', CASE WHEN count(DISTINCT o_custkey) FILTER (o_custkey % 19 <> 0) * 1.0 / count(*) > 0.2 THEN 'int' ELSE 'object' END, count(*) FILTER (o_custkey % 19 = 0) FROM orders
 UNION ALL SELECT 'okey', 'int', 0 UNION ALL SELECT 'odate', 'datetime', 0 UNION ALL SELECT 'priority', 'object', 0""")
def p9(spark, sf):
    return profile.validate_types(_texts(spark, sf)).report


@query("p9_invalid_rows", "SELECT o_orderkey AS _row_id, 'cust' AS column_name FROM orders WHERE o_custkey % 19 = 0")
def p9r(spark, sf):
    return profile.validate_types(_texts(spark, sf)).invalid_rows


@query("p9_converted", """SELECT o_orderkey AS _row_id, o_orderstatus = 'F' AS closed, o_totalprice AS price, CASE WHEN o_custkey % 19 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS cust,
 o_orderkey AS okey, o_orderdate AS odate, CAST(regexp_extract(o_orderpriority, '[0-9]+', 0) AS DOUBLE) AS priority FROM orders""")
def p9c(spark, sf):
    return profile.validate_types(_texts(spark, sf)).df


@query("p11_cleaning_summary", """SELECT orig, rare, kept, orig - kept AS removed, round((orig - kept) * 100.0 / orig, 2) AS removed_pct, round(rare * 100.0 / orig, 2) AS rare_pct FROM (
 SELECT count(*) AS orig, count(*) FILTER (o_totalprice > 400000) AS rare, count(*) FILTER (o_totalprice <= 400000) AS kept FROM orders)""")
def p11(spark, sf):
    row = table(spark, sf, "orders").agg(F.count("*").alias("orig"), F.count_if(F.col("o_totalprice") > 400000).alias("rare"), F.count_if(F.col("o_totalprice") <= 400000).alias("kept"))
    return profile.removal_summary(row, "orig", "kept", ["rare"])


@query("p12_value_distribution", """SELECT label, n, round(max(n) OVER () * 1.0 / min(n) OVER (), 6) AS imbalance_ratio, max(n) OVER () * 1.0 / min(n) OVER () > 10 AS imbalanced,
 round((sum(n) OVER () - sum(CASE WHEN lower(label) IN ('unknown','nan') THEN n ELSE 0 END) OVER ()) * 100.0 / sum(n) OVER (), 4) AS match_rate
 FROM (SELECT coalesce(CAST(quality AS VARCHAR), 'Unknown') AS label, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)""")
def p12(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return profile.value_distribution(d, "quality")


@query("p13_describe", " UNION ALL ".join(f"""SELECT '{n}' AS column_name, count({n}) AS count, round(avg({n}),4) AS mean, round(stddev_samp({n}),4) AS std, round(min({n}),4) AS min,
 round(quantile_cont({n},0.25),4) AS p25, round(quantile_cont({n},0.5),4) AS p50, round(quantile_cont({n},0.75),4) AS p75, round(max({n}),4) AS max FROM events""" for n in ("value",)))
def p13(spark, sf):
    d = profile.describe(table(spark, sf, "events"), ["value"])
    return d.select("column_name", "count", *rnd(["mean", "std", "min", "p25", "p50", "p75", "max"]))


# --- rules -------------------------------------------------------------------------------------

@query("f1_range_rule", f"SELECT _row_id, price FROM {GAPS_SQL} WHERE price IS NULL OR price BETWEEN 50000 AND 300000")
def f1(spark, sf):
    return rules.apply_rules(gaps(spark, sf), {"price": ["50000", "300000"]}).select(ROW_ID, "price")


@query("f2_category_rule", f"SELECT _row_id, status FROM {GAPS_SQL} WHERE status IS NULL OR status IN ('F','O')")
def f2(spark, sf):
    return rules.apply_rules(gaps(spark, sf), {"status": ["F", "O", ""]}).select(ROW_ID, "status")


@query("f3_date_rule", f"SELECT _row_id, odate FROM {GAPS_SQL} WHERE odate IS NULL OR odate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'")
def f3(spark, sf):
    return rules.apply_rules(gaps(spark, sf), {"odate": ["1996-01-01", "1997-12-31"]}).select(ROW_ID, "odate")


RULES = {"price": ["50000", ""], "status": ["F", "O"], "absent": ["1", "2"], "odate": ["1995-01-01", "1998-06-30"], "cust": ["", ""]}
RULES_SQL = "(price IS NULL OR price >= 50000)", "(status IS NULL OR status IN ('F','O'))", "(odate IS NULL OR odate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-06-30')"


@query("f4_apply_rules", f"SELECT * FROM {GAPS_SQL} WHERE {' AND '.join(RULES_SQL)}")
def f4(spark, sf):
    return rules.apply_rules(gaps(spark, sf), RULES)


@query("f4_rule_removals", f"""WITH r AS (SELECT CASE WHEN NOT {RULES_SQL[0]} THEN 'price' WHEN NOT {RULES_SQL[1]} THEN 'status' WHEN NOT {RULES_SQL[2]} THEN 'odate' END AS rule FROM {GAPS_SQL})
 SELECT rule, count(*) AS removed FROM r WHERE rule IS NOT NULL GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM r WHERE rule IS NOT NULL""")
def f4r(spark, sf):
    return rules.rule_removals(gaps(spark, sf), RULES)


@query("f5_drop_null_target", f"SELECT count(*) AS n, round(sum(price), 2) AS total FROM {GAPS_SQL} WHERE price IS NOT NULL")
def f5(spark, sf):
    return rules.drop_null_target(gaps(spark, sf), "price").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query("f6_drop_rare_classes", "SELECT o_orderkey, o_custkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n >= 10")
def f6(spark, sf):
    return rules.drop_rare_classes(table(spark, sf, "orders"), "o_custkey", 10).select("o_orderkey", "o_custkey")


@query("f7_require_columns", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def f7(spark, sf):
    return rules.require_columns(table(spark, sf, "customer"), ["c_nationkey"]).groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("f8_select_columns", "SELECT p_partkey, p_brand FROM part")
def f8(spark, sf):
    return rules.drop_column(rules.select_columns(table(spark, sf, "part"), ["p_partkey", "p_brand", "p_size"]), "p_size")


# --- duplicates and set operations -------------------------------------------------------------

def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias(ROW_ID), "text", "lang")


@query("d1_dedup_rows", "SELECT doc_id AS _row_id, lang, md5(text) AS h FROM (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def d1(spark, sf):
    return dedup.dedup_rows(_docs(spark, sf)).select(ROW_ID, "lang", F.md5("text").alias("h"))


@query("d2_duplicate_rows", "SELECT doc_id AS _row_id FROM (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS rn FROM documents) WHERE rn > 1")
def d2(spark, sf):
    return dedup.duplicate_rows(_docs(spark, sf))


@query("d2_duplicate_count", "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_count FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)")
def d2c(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return dedup.duplicate_count(df.withColumn(ROW_ID, F.monotonically_increasing_id()))


@query("d3_append_rows", "SELECT c_custkey AS key, c_name AS name, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def d3(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    b = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return dedup.append_rows(a, b)


@query("d4_zip_columns", "SELECT doc_id AS _row_id, n_chars, quality FROM documents JOIN labels USING (doc_id)")
def d4(spark, sf):
    x = table(spark, sf, "documents").select(F.col("doc_id").alias(ROW_ID), "n_chars")
    return dedup.zip_columns(x, table(spark, sf, "labels").select(F.col("doc_id").alias(ROW_ID), "quality"))


@query("d5_label_union", "SELECT c_nationkey AS label FROM customer UNION SELECT s_nationkey FROM supplier")
def d5(spark, sf):
    return dedup.label_union(table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")), "k")


# --- imputation --------------------------------------------------------------------------------

@query("i1_fill_mean", f"SELECT _row_id, round(coalesce(price, (SELECT avg(price) FROM {GAPS_SQL})), 4) AS price FROM {GAPS_SQL}")
def i1(spark, sf):
    return impute.fill_mean(gaps(spark, sf), ["price"]).select(ROW_ID, *rnd(["price"]))


@query("i2_fill_median", f"SELECT _row_id, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM {GAPS_SQL})), 4) AS price FROM {GAPS_SQL}")
def i2(spark, sf):
    return impute.fill_median(gaps(spark, sf), ["price"]).select(ROW_ID, *rnd(["price"]))


SKEW_SQL = "(SELECT event_id, CASE WHEN event_id % 31 = 0 THEN NULL ELSE value END AS value FROM events)"


@query("i3_fill_by_skew", f"""WITH s AS (SELECT avg(value) AS m, quantile_cont(value, 0.5) AS med, (count(*) - count(value)) * 100.0 / count(*) AS miss,
 (avg(value*value*value) - 3*avg(value)*avg(value*value) + 2*power(avg(value),3)) / power(stddev_pop(value),3) AS sk FROM {SKEW_SQL})
 SELECT event_id, round(coalesce(value, CASE WHEN miss < 5 THEN CASE WHEN abs(sk) > 0.5 THEN med ELSE m END END), 4) AS value FROM {SKEW_SQL}, s""")
def i3(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 31 != 0, F.col("value")).alias("value"))
    return impute.fill_by_skew(e, ["value"]).select("event_id", *rnd(["value"]))


@query("i4_fill_mode", f"SELECT _row_id, coalesce(status, (SELECT status FROM {GAPS_SQL} WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, status LIMIT 1)) AS status FROM {GAPS_SQL}")
def i4(spark, sf):
    return impute.fill_mode(gaps(spark, sf), ["status"]).select(ROW_ID, "status")


@query("i5_fill_forward_backward", f"""SELECT _row_id, coalesce(last_value(odate IGNORE NULLS) OVER (ORDER BY _row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(odate IGNORE NULLS) OVER (ORDER BY _row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS odate FROM {GAPS_SQL}""")
def i5(spark, sf):
    return impute.fill_forward_backward(gaps(spark, sf), ["odate"]).select(ROW_ID, "odate")


# Customers and suppliers with planted gaps in three numeric columns.
KNN_SQL = """(SELECT c_custkey AS _row_id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS a,
 CASE WHEN c_custkey % 11 = 3 THEN NULL ELSE m END AS b, CASE WHEN c_custkey % 13 = 5 THEN NULL ELSE CAST(n AS DOUBLE) END AS d
 FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS n, max(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


def knn_input(spark, sf):
    k = F.col("c_custkey")
    spend = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("n"), F.max("o_totalprice").alias("m"))
    return table(spark, sf, "customer").join(spend, F.col("o_custkey") == k).select(
        k.alias(ROW_ID), F.when(k % 9 != 0, F.col("c_acctbal")).alias("a"),
        F.when(k % 11 != 3, F.col("m")).alias("b"), F.when(k % 13 != 5, F.col("n")).alias("d"))


def _knn_sql(k: int) -> str:
    def one(t, o1, o2):
        return f"""g{t} AS (SELECT q._row_id, avg(v) AS v FROM (SELECT q._row_id, d.z{t} AS v, row_number() OVER (PARTITION BY q._row_id ORDER BY
 2.0 / (CASE WHEN q.z{o1} IS NOT NULL AND d.z{o1} IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN q.z{o2} IS NOT NULL AND d.z{o2} IS NOT NULL THEN 1 ELSE 0 END)
 * (coalesce((q.z{o1} - d.z{o1}) * (q.z{o1} - d.z{o1}), 0) + coalesce((q.z{o2} - d.z{o2}) * (q.z{o2} - d.z{o2}), 0)), d.z{t}) AS rn
 FROM z q JOIN z d ON q.z{t} IS NULL AND d.z{t} IS NOT NULL AND ((q.z{o1} IS NOT NULL AND d.z{o1} IS NOT NULL) OR (q.z{o2} IS NOT NULL AND d.z{o2} IS NOT NULL))) q WHERE rn <= {k} GROUP BY 1)"""
    return f"""WITH t AS (SELECT * FROM {KNN_SQL}), s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(d) AS md, stddev_pop(d) AS sd FROM t),
 z AS (SELECT _row_id, (a - ma) / sa AS za, (b - mb) / sb AS zb, (d - md) / sd AS zd FROM t, s),
 {one('a', 'b', 'd')}, {one('b', 'a', 'd')}, {one('d', 'a', 'b')}
 SELECT t._row_id, round(coalesce(a, ga.v * sa + ma, ma), 4) AS a, round(coalesce(b, gb.v * sb + mb, mb), 4) AS b, round(coalesce(d, gd.v * sd + md, md), 2) AS d
 FROM t CROSS JOIN s LEFT JOIN ga USING (_row_id) LEFT JOIN gb USING (_row_id) LEFT JOIN gd USING (_row_id)"""


@query("i6_fill_knn", _knn_sql(5))
def i6(spark, sf):
    out = impute.fill_knn(knn_input(spark, sf), ["a", "b", "d"], 5)
    return out.select(ROW_ID, *rnd(["a", "b"]), F.round("d", 2).alias("d"))


@query("i7_fill_knn_all", _knn_sql(7))
def i7(spark, sf):
    out = impute.fill_knn_all(knn_input(spark, sf), ["a", "b", "d"], [], 7)
    return out.select(ROW_ID, *rnd(["a", "b"]), F.round("d", 2).alias("d"))


@query("i8_impute", f"""WITH t AS (SELECT * FROM {GAPS_SQL}), s AS (SELECT avg(price) AS m, quantile_cont(price, 0.5) AS med, (avg(price*price*price) - 3*avg(price)*avg(price*price) + 2*power(avg(price),3)) / power(stddev_pop(price),3) AS sk FROM t)
 SELECT _row_id, round(coalesce(price, CASE WHEN abs(sk) > 0.5 THEN med ELSE m END), 4) AS price,
 coalesce(status, (SELECT status FROM t WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, status LIMIT 1)) AS status,
 coalesce(last_value(odate IGNORE NULLS) OVER (ORDER BY _row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(odate IGNORE NULLS) OVER (ORDER BY _row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS odate FROM t, s""")
def i8(spark, sf):
    types = {"price": "float", "status": "object", "odate": "datetime", "priority": "object", "cust": "int"}
    return impute.impute(gaps(spark, sf), types).select(ROW_ID, *rnd(["price"]), "status", "odate")


# --- outliers, scaling, encoding ---------------------------------------------------------------

@query("o1_standardize", "SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS o_totalprice FROM orders")
def o1(spark, sf):
    return outliers.standardize(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]).select("o_orderkey", *rnd(["o_totalprice"], 6))


def _points(spark, sf):
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(k.alias(ROW_ID), "l_quantity", "l_extendedprice", "l_discount", "l_tax")


# Two standardised columns have the principal axes (1,1) and (1,-1): the larger share belongs to
# the sign of their correlation, so the scores are known in closed form up to sign.
@query("o2_pca", """WITH s AS (SELECT avg(l_quantity) AS ma, stddev_pop(l_quantity) AS sa, avg(l_extendedprice) AS mb, stddev_pop(l_extendedprice) AS sb, corr(l_quantity, l_extendedprice) AS r FROM lineitem)
 SELECT l_orderkey * 8 + l_linenumber AS _row_id, round(abs((l_quantity - ma) / sa + sign(r) * (l_extendedprice - mb) / sb) / sqrt(2), 5) AS pc1, round(abs((l_quantity - ma) / sa - sign(r) * (l_extendedprice - mb) / sb) / sqrt(2), 5) AS pc2 FROM lineitem, s""")
def o2(spark, sf):
    p = outliers.pca(_points(spark, sf), ["l_quantity", "l_extendedprice"], 2)
    return p.select(ROW_ID, F.round(F.abs("pc1"), 5).alias("pc1"), F.round(F.abs("pc2"), 5).alias("pc2"))


def _cust_points(spark, sf):
    spend = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return spend.select(F.col("o_custkey").alias(ROW_ID), (F.col("n") * 1.0).alias("x"), (F.col("total") / 100000.0).alias("y"))


CUST_SQL = "p AS (SELECT o_custkey AS id, count(*) * 1.0::DOUBLE AS x, sum(o_totalprice) / 100000.0 AS y FROM orders GROUP BY 1)"
DBSCAN_SQL = f"""{CUST_SQL}, near AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.x = b.x AND (a.y - b.y) * (a.y - b.y) <= 0.25),
 core AS (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) >= 5)"""


@query("o3_dbscan_noise", f"WITH {DBSCAN_SQL} SELECT id AS _row_id FROM p WHERE id NOT IN (SELECT id FROM core) AND id NOT IN (SELECT a FROM near JOIN core ON b = core.id)")
def o3n(spark, sf):
    return outliers.noise_points(_cust_points(spark, sf), ["x", "y"], 0.5, 5)


# Clusters of the oracle: with x integer-spaced by more than eps, core points chain along y.
@query("o3_dbscan_labels", f"""WITH {DBSCAN_SQL}, cp AS (SELECT p.*, CASE WHEN y - lag(y) OVER (PARTITION BY x ORDER BY y) <= 0.5 THEN 0 ELSE 1 END AS brk FROM p JOIN core USING (id)),
 grp AS (SELECT *, sum(brk) OVER (PARTITION BY x ORDER BY y, id) AS g FROM cp), seed AS (SELECT x, g, min(id) AS s FROM grp GROUP BY 1, 2),
 num AS (SELECT x, g, row_number() OVER (ORDER BY s) - 1 AS cluster FROM seed), lab AS (SELECT grp.id, cluster FROM grp JOIN num USING (x, g)),
 bord AS (SELECT a AS id, min(cluster) AS cluster FROM near JOIN lab ON b = lab.id WHERE a NOT IN (SELECT id FROM core) GROUP BY 1)
 SELECT p.id AS _row_id, coalesce(lab.cluster, bord.cluster, -1) AS cluster FROM p LEFT JOIN lab USING (id) LEFT JOIN bord USING (id)""")
def o3(spark, sf):
    return outliers.dbscan_labels(_cust_points(spark, sf), ["x", "y"], 0.5, 5)


@query("o4_remove_outliers")
def o4(spark, sf):
    df = table(spark, sf, "customer").select(F.col("c_custkey").alias(ROW_ID), "c_acctbal", "c_nationkey", "c_mktsegment")
    kept, noise = outliers.remove_outliers(df, {"c_acctbal": "float", "c_nationkey": "int", "c_mktsegment": "object"}, eps=0.1)
    return outliers.outlier_report(df, noise).join(F.broadcast(kept.agg(F.count("*").alias("rows_kept"))))


# Two columns again, so the projected distance equals the standardised distance.
@query("o4_outlier_rows", """WITH s AS (SELECT avg(c_acctbal) AS ma, stddev_pop(c_acctbal) AS sa, avg(c_nationkey) AS mb, stddev_pop(c_nationkey) AS sb FROM customer),
 p AS (SELECT c_custkey AS id, (c_acctbal - ma) / sa AS x, (c_nationkey - mb) / sb AS y FROM customer, s),
 near AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.01), core AS (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) >= 5)
 SELECT id AS _row_id FROM p WHERE id NOT IN (SELECT id FROM core) AND id NOT IN (SELECT a FROM near JOIN core ON b = core.id)""")
def o4r(spark, sf):
    df = table(spark, sf, "customer").select(F.col("c_custkey").alias(ROW_ID), "c_acctbal", "c_nationkey")
    return outliers.remove_outliers(df, {"c_acctbal": "float", "c_nationkey": "int"}, eps=0.1)[1]


@query("o5_label_encode", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand FROM part")
def o5(spark, sf):
    return encode.label_encode(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand")


@query("o6_label_decode", "SELECT p_partkey, p_brand FROM part")
def o6(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_brand")
    codes = encode.label_codes(df, "p_brand")
    return encode.label_decode(encode.label_encode(df, "p_brand", codes), "p_brand", codes)


@query("o7_inverse_standardize", "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders")
def o7(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    stat = outliers.scale_stats(df, ["o_totalprice"])["o_totalprice"]
    z = outliers.standardize(df, ["o_totalprice"])
    return z.select("o_orderkey", F.round(outliers.inverse_standardize(F.col("o_totalprice"), stat), 4).alias("o_totalprice"))


@query("o8_feature_roles", """SELECT 'o_custkey' AS column_name, 'numeric' AS role, count(*) AS n FROM orders UNION ALL SELECT 'o_orderstatus', 'categorical', count(*) FROM orders
 UNION ALL SELECT 'o_totalprice', 'numeric', count(*) FROM orders UNION ALL SELECT 'o_orderdate', 'other', count(*) FROM orders UNION ALL SELECT 'o_orderpriority', 'categorical', count(*) FROM orders""")
def o8(spark, sf):
    df = table(spark, sf, "orders").drop("o_orderkey")
    roles = encode.feature_roles(df)
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(r).alias("role")) for n, r in roles.items()]))
    return df.agg(F.count("*").alias("n")).select(names.alias("x"), "n").select("x.column_name", "x.role", "n")


@query("o9_transform", """SELECT o_orderkey AS _row_id, round((o_custkey - avg(o_custkey) OVER ()) / stddev_pop(o_custkey) OVER (), 6) AS o_custkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) AS o_totalprice,
 dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS o_orderstatus, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM orders""")
def o9(spark, sf):
    df = table(spark, sf, "orders").withColumnRenamed("o_orderkey", ROW_ID).drop("o_orderdate")
    p = encode.transform(df, "o_orderpriority", "classification").df
    return p.select(ROW_ID, *rnd(["o_custkey", "o_totalprice"], 6), "o_orderstatus", "o_orderpriority")


@query("o10_baseline_prepare", f"""WITH t AS (SELECT _row_id, coalesce(price, (SELECT avg(price) FROM {GAPS_SQL} WHERE status IS NOT NULL)) AS price, CAST(cust AS DOUBLE) AS cust, dense_rank() OVER (ORDER BY priority) - 1 AS pri, dense_rank() OVER (ORDER BY status) - 1 AS status FROM {GAPS_SQL} WHERE status IS NOT NULL)
 SELECT _row_id, round((price - avg(price) OVER ()) / stddev_pop(price) OVER (), 5) AS price, round((cust - avg(cust) OVER ()) / stddev_pop(cust) OVER (), 5) AS cust, round((pri - avg(pri) OVER ()) / stddev_pop(pri) OVER (), 5) AS priority, status FROM t""")
def o10(spark, sf):
    p = encode.baseline_prepare(gaps(spark, sf).drop("odate"), "status", "classification").df
    return p.select(ROW_ID, *rnd(["price", "cust", "priority"], 5), "status")


@query("o11_clip_to_range", "SELECT p_partkey, CAST(least(greatest(p_size, 10), 40) AS INTEGER) AS p_size, least(greatest(p_retailprice, 950.5), 1500.25) AS price FROM part")
def o11(spark, sf):
    return table(spark, sf, "part").select("p_partkey", clip_to_range(F.col("p_size"), 10, 40, "int").alias("p_size"), clip_to_range(F.col("p_retailprice"), 950.5, 1500.25, "double").alias("price"))


@query("o12_iqr_upper_bound", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT quantile_cont(o_totalprice, 0.75) + 0.5 * (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) FROM orders)")
def o12(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return df.filter(F.col("o_totalprice") > outliers.iqr_upper_bound(df, "o_totalprice", 0.5))


# --- synthesis ---------------------------------------------------------------------------------

def _synth_input(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias(ROW_ID), "c_acctbal", "c_nationkey", "c_mktsegment")


# The contract of the drawn rows: count, bounds and categories inside the observed ones.
@query("y1_synthesize", """SELECT CAST(floor(count(*) * 0.2) AS BIGINT) AS new_rows, true AS in_bounds, CAST(0 AS BIGINT) AS foreign_categories FROM customer""")
def y1(spark, sf):
    src = _synth_input(spark, sf)
    new = synth.synthetic_rows(src, 0.2, 42)
    b = src.agg(F.min("c_acctbal").alias("a0"), F.max("c_acctbal").alias("a1"), F.min("c_nationkey").alias("n0"), F.max("c_nationkey").alias("n1"))
    inside = F.col("c_acctbal").between(F.col("a0"), F.col("a1")) & F.col("c_nationkey").between(F.col("n0"), F.col("n1"))
    known = src.select(F.col("c_mktsegment").alias("seg")).distinct()
    return new.join(F.broadcast(b)).join(known, F.col("c_mktsegment") == F.col("seg"), "left").agg(
        F.count("*").alias("new_rows"), F.min(inside).alias("in_bounds"), F.sum(F.col("seg").isNull().cast("long")).alias("foreign_categories"))


@query("y1_augmented_rows")
def y1a(spark, sf):
    return synth.synthesize(_synth_input(spark, sf), 0.2, 42)


@query("y2_synthesis_report", """SELECT 'before' AS side, 'c_acctbal' AS column_name, count(*) AS n_rows, count(DISTINCT c_acctbal) AS n_unique, min(c_acctbal) AS min, max(c_acctbal) AS max, NULL AS first_values FROM customer
 UNION ALL SELECT 'before', 'c_mktsegment', count(*), count(DISTINCT c_mktsegment), NULL, NULL, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT c_mktsegment AS v FROM customer ORDER BY 1 LIMIT 5)) FROM customer
 UNION ALL SELECT 'after', 's_acctbal', count(*), count(DISTINCT s_acctbal), min(s_acctbal), max(s_acctbal), NULL FROM supplier""")
def y2(spark, sf):
    return synth.synthesis_report(table(spark, sf, "customer").select("c_acctbal", "c_mktsegment"), table(spark, sf, "supplier").select("s_acctbal"))


@query("y3_synthesis_roles", """SELECT 'c_custkey' AS column_name, 'numeric' AS role, count(*) AS n FROM customer UNION ALL SELECT 'c_name', 'categorical', count(*) FROM customer UNION ALL SELECT 'c_nationkey', 'numeric', count(*) FROM customer
 UNION ALL SELECT 'c_acctbal', 'numeric', count(*) FROM customer UNION ALL SELECT 'c_mktsegment', 'categorical', count(*) FROM customer""")
def y3(spark, sf):
    df = table(spark, sf, "customer")
    roles = synth.synthesis_roles(df)
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(r).alias("role")) for n, r in roles.items()]))
    return df.agg(F.count("*").alias("n")).select(names.alias("x"), "n").select("x.column_name", "x.role", "n")
