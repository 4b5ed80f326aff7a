"""Queries for splits, models, metrics and the end-to-end jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.catalog import graphs as cg
from sievework.catalog import images as ci
from sievework.catalog.registry import query, table
from sievework.catalog.tables import GAPS_SQL, RULES, RULES_SQL, gaps
from sievework.functions.columns import ROW_ID
from sievework.operators import metrics, train
from sievework.operators import graph_clean as gcl
from sievework.plans import graphs as pg
from sievework.plans import images as pi
from sievework.plans import tables as pt
from sievework.session import cut

# A predictions table from orders: the class is the status, the prediction follows price and key.
PRED_SQL = """(SELECT o_orderkey AS _row_id, o_orderstatus AS label, CASE WHEN o_orderkey % 5 = 0 THEN 'P' WHEN o_totalprice > 250000 THEN 'O' ELSE o_orderstatus END AS prediction, o_totalprice AS y, o_totalprice * 0.9 + (o_orderkey % 100) * 300 AS yhat FROM orders)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    guess = F.when(k % 5 == 0, "P").when(F.col("o_totalprice") > 250000, "O").otherwise(F.col("o_orderstatus"))
    return table(spark, sf, "orders").select(
        k.alias(ROW_ID), F.col("o_orderstatus").alias("label"), guess.alias("prediction"), F.col("o_totalprice").alias("y"),
        (F.col("o_totalprice") * 0.9 + (k % 100) * 300).alias("yhat"))


def vectors(spark: SparkSession, sf: str, binary: bool = False) -> DataFrame:
    """Embedding values as features; the label is the class, or whether it lies in the upper half."""
    e = table(spark, sf, "embeddings")
    label = F.expr("CAST(label >= 5 AS DOUBLE)") if binary else F.col("label").cast("double")
    flat = e.select(F.col("vec_id").alias(ROW_ID), label.alias("label"), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
    return train.assemble(flat, [f"x{i}" for i in range(64)], "label")


def spending(spark: SparkSession, sf: str) -> DataFrame:
    """Line items for regression: the price from quantity, discount and tax."""
    l = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias(ROW_ID), "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return train.assemble(l, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")


def doc_table(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias(ROW_ID), "lang", "source", "n_chars", F.length("text").alias("length"))
    return d.join(table(spark, sf, "labels").withColumnRenamed("doc_id", ROW_ID), ROW_ID)


@query("m1_split", "SELECT count(*) AS n, CAST(ceil(count(*) * 0.2) AS BIGINT) AS n_test, 0 AS overlap FROM orders")
def m1(spark, sf):
    a, b = train.split(table(spark, sf, "orders").withColumnRenamed("o_orderkey", ROW_ID), 0.2, 42)
    both = a.select(ROW_ID).join(b.select(ROW_ID), ROW_ID, "left_semi").agg(F.count("*").alias("overlap"))
    n = a.select(F.lit(0).alias("t")).unionByName(b.select(F.lit(1).alias("t"))).agg(F.count("*").alias("n"), F.sum("t").alias("n_test"))
    return n.join(F.broadcast(both))


@query("m2_stratified_split", "SELECT o_orderstatus, CAST(ceil(count(*) * 0.25) AS BIGINT) AS n_test FROM orders GROUP BY 1")
def m2(spark, sf):
    _, b = train.stratified_split(table(spark, sf, "orders").withColumnRenamed("o_orderkey", ROW_ID), "o_orderstatus", 0.25, 42)
    return b.groupBy("o_orderstatus").agg(F.count("*").alias("n_test"))


# Without regularisation the simple regression has a closed form.
@query("m3_linear_regression", "SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def m3(spark, sf):
    l = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias(ROW_ID), "l_quantity", "l_extendedprice")
    data = train.assemble(l, ["l_quantity"], "l_extendedprice")
    model = train.make_regressor("linear_regression").fit(data)
    return data.agg(F.count("*").alias("n")).select(F.round(F.lit(float(model.coefficients[0])), 3).alias("slope"), F.round(F.lit(float(model.intercept)), 2).alias("intercept"))


def _regression(model):
    def run(spark, sf):
        a, b = train.split(spending(spark, sf), 0.2, 42)
        return train.evaluate_models(a, b, [model], "prediction", **({"trees": 20} if model == "random_forest" else {}))

    return run


def _classification(model, **kw):
    def run(spark, sf):
        a, b = train.stratified_split(cut(vectors(spark, sf)), "label", 0.25, 42)
        return train.evaluate_models(a, b, [model], "classification", **kw)

    return run


query("m4_decision_tree_regression")(_regression("decision_tree"))
query("m4_decision_tree_classification")(_classification("decision_tree"))
query("m5_random_forest_regression")(_regression("random_forest"))
query("m5_random_forest_classification")(_classification("random_forest", trees=50))
query("m6_gradient_boosting_regression")(_regression("gradient_boosting"))
query("m7_logistic_regression")(_classification("logistic_regression"))
query("m9_svr")(_regression("svm"))
query("m11_mlp")(_classification("mlp"))


@query("m6_gradient_boosting_classification")
def m6(spark, sf):
    a, b = train.stratified_split(cut(vectors(spark, sf, binary=True)), "label", 0.25, 42)
    return train.evaluate_models(a, b, ["gradient_boosting"], "classification")


@query("m8_svm")
def m8(spark, sf):
    a, b = train.stratified_split(cut(vectors(spark, sf, binary=True)), "label", 0.25, 42)
    return train.evaluate_models(a, b, ["svm"], "classification")


KNN_MODEL_SQL = """WITH d AS (SELECT c_custkey AS id, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS x, (s - avg(s) OVER ()) / stddev_pop(s) OVER () AS y, n_regionkey AS lab FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey),
 r AS (SELECT q.id, t.lab, row_number() OVER (PARTITION BY q.id ORDER BY (q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y), t.lab) AS rn FROM d q JOIN d t ON q.id % 4 = 0 AND t.id % 4 <> 0),
 v AS (SELECT id, lab, count(*) AS k FROM r WHERE rn <= 5 GROUP BY 1, 2)"""


@query("m10_knn", KNN_MODEL_SQL + " SELECT id AS _row_id, CAST(lab AS DOUBLE) AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k DESC, lab) AS o FROM v) WHERE o = 1")
def m10(spark, sf):
    """All customers take part: every fourth is a query, the others are donors."""
    spend = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    d = table(spark, sf, "customer").join(spend, F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    from sievework.operators.outliers import standardize

    rows = standardize(d.select(F.col("c_custkey").alias(ROW_ID), "c_acctbal", "s", F.col("n_regionkey").alias("lab")), ["c_acctbal", "s"])
    data = cut(train.assemble(rows, ["c_acctbal", "s"], "lab"))
    return train.knn_predict(data.filter(f"{ROW_ID} % 4 <> 0"), data.filter(f"{ROW_ID} % 4 = 0"), 5, "classification").select(ROW_ID, "prediction")


@query("m12_select_k_best")
def m12(spark, sf):
    data = vectors(spark, sf)
    model = train.select_k_best(data, 20)
    return model.transform(data).select(ROW_ID, "label", F.size(train.vector_to_array("selected")).alias("n_selected"))


@query("m13_cross_validate")
def m13(spark, sf):
    return train.cross_validate(cut(vectors(spark, sf)), "decision_tree", 5)


@query("m14_regression_metrics", f"""SELECT count(*) AS n, round(avg(e * e) / 1e6, 4) AS mse_m, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(avg(abs(e) / abs(y)) * 100, 4) AS mape, round(1 - avg(e * e) / var_pop(y), 6) AS r2, round(1 - var_pop(e) / var_pop(y), 6) AS explained_variance FROM (SELECT y, y - yhat AS e FROM {PRED_SQL})""")
def m14(spark, sf):
    m = metrics.regression_metrics(predictions(spark, sf), "y", "yhat")
    return m.selectExpr("n", "round(mse / 1e6D, 4) AS mse_m", "round(rmse, 4) AS rmse", "round(mae, 4) AS mae", "round(mape, 4) AS mape", "round(r2, 6) AS r2", "round(explained_variance, 6) AS explained_variance")


REPORT_SQL = f"""WITH p AS (SELECT label, prediction, count(*) AS n FROM {PRED_SQL} GROUP BY 1, 2), k AS (SELECT label AS c FROM p UNION SELECT prediction FROM p),
 s AS (SELECT c, (SELECT coalesce(sum(n), 0) FROM p WHERE label = c AND prediction = c) AS t, (SELECT coalesce(sum(n), 0) FROM p WHERE prediction = c) AS pp, (SELECT coalesce(sum(n), 0) FROM p WHERE label = c) AS sup FROM k),
 r AS (SELECT c AS class, CASE WHEN pp > 0 THEN t * 1.0::DOUBLE / pp ELSE 0 END AS precision, CASE WHEN sup > 0 THEN t * 1.0::DOUBLE / sup ELSE 0 END AS recall, CAST(sup AS BIGINT) AS support, CASE WHEN pp + sup > 0 THEN 2.0::DOUBLE * t / (pp + sup) ELSE 0 END AS f1 FROM s)"""


@query("m15_classification_report", REPORT_SQL + " SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r")
def m15(spark, sf):
    r = metrics.classification_report(predictions(spark, sf))
    return r.selectExpr("class", "round(precision, 6) AS precision", "round(recall, 6) AS recall", "round(f1, 6) AS f1", "support")


@query("m15_classification_metrics", REPORT_SQL + " SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS support FROM r")
def m15m(spark, sf):
    return metrics.classification_metrics(predictions(spark, sf)).selectExpr("round(accuracy, 6) AS accuracy", "round(macro_f1, 6) AS macro_f1", "round(weighted_f1, 6) AS weighted_f1", "support")


@query("m16_confusion_matrix", f"""SELECT l.label, count(*) FILTER (prediction = 'F') AS "pred_F", count(*) FILTER (prediction = 'O') AS "pred_O", count(*) FILTER (prediction = 'P') AS "pred_P" FROM {PRED_SQL} l GROUP BY 1""")
def m16(spark, sf):
    return metrics.confusion_matrix(predictions(spark, sf), ["F", "O", "P"])


@query("m17_mean_f1", REPORT_SQL + " SELECT round(avg(f1), 6) AS mean_f1 FROM r")
def m17(spark, sf):
    return metrics.mean_f1(metrics.classification_report(predictions(spark, sf))).selectExpr("round(mean_f1, 6) AS mean_f1")


@query("m18_roc_auc", """WITH t AS (SELECT quality AS l, n_chars AS s FROM labels JOIN documents USING (doc_id)), g AS (SELECT s, count(*) FILTER (l = 1) AS p, count(*) FILTER (l <> 1) AS n FROM t GROUP BY 1),
 w AS (SELECT p, n, sum(n) OVER (ORDER BY s) - n AS b FROM g) SELECT round(sum(p * (b + n / 2.0)) / (sum(p) * sum(n)), 6) AS roc_auc FROM w""")
def m18(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(F.col("quality").alias("label"), F.col("n_chars").alias("score"))
    return metrics.roc_auc(d).selectExpr("round(roc_auc, 6) AS roc_auc")


@query("m19_model_kind", "SELECT count(DISTINCT quality) AS n_classes, CASE WHEN count(DISTINCT quality) = 2 THEN 'binary' ELSE 'multiclass' END AS kind FROM labels")
def m19(spark, sf):
    return metrics.model_kind(table(spark, sf, "labels"), "quality")


@query("m20_residual_summary", f"""WITH r AS (SELECT y - yhat AS e FROM {PRED_SQL}), q AS (SELECT quantile_cont(e, 0.25) AS a, quantile_cont(e, 0.5) AS b, quantile_cont(e, 0.75) AS c FROM r)
 SELECT count(*) AS n, round(avg(e), 4) AS mean, round(stddev_pop(e), 4) AS std, round(any_value(a), 4) AS q25, round(any_value(b), 4) AS q50, round(any_value(c), 4) AS q75, round(any_value(c + 1.5 * (c - a)), 4) AS upper_fence FROM r, q""")
def m20(spark, sf):
    s = metrics.residual_summary(predictions(spark, sf), "y", "yhat")
    return s.selectExpr("n", *[f"round({n}, 4) AS {n}" for n in ("mean", "std", "q25", "q50", "q75", "upper_fence")])


@query("m20_residual_histogram", f"""WITH r AS (SELECT y - yhat AS e FROM {PRED_SQL}), z AS (SELECT min(e) AS lo, (max(e) - min(e)) / 30 AS w FROM r), b AS (SELECT CAST(least(29, floor((e - lo) / w)) AS INTEGER) AS bin, count(*) AS n FROM r, z GROUP BY 1)
 SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(30) t(i) LEFT JOIN b ON b.bin = i""")
def m20h(spark, sf):
    return metrics.histogram(metrics.residuals(predictions(spark, sf), "y", "yhat"), "residual", 30).select("bin", "n")


# Two runs per priority: share of finished orders in the earlier and in the later years.
RUNS_SQL = """a AS (SELECT o_orderpriority AS model, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS accuracy FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1),
 b AS (SELECT o_orderpriority AS model, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS accuracy FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1),
 c AS (SELECT model, a.accuracy AS original_accuracy, b.accuracy AS cleaned_accuracy, b.accuracy - a.accuracy AS accuracy_improvement, CASE WHEN a.accuracy > 0 THEN (b.accuracy - a.accuracy) / a.accuracy * 100 ELSE 0 END AS accuracy_improvement_pct FROM a JOIN b USING (model))"""


def runs(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    share = lambda df: df.groupBy(F.col("o_orderpriority").alias("model")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("accuracy"))
    early = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    return metrics.compare_runs(share(o.filter(early)), share(o.filter(~early)))


@query("m21_compare_runs", f"WITH {RUNS_SQL} SELECT model, round(original_accuracy, 6) AS original_accuracy, round(cleaned_accuracy, 6) AS cleaned_accuracy, round(accuracy_improvement, 6) AS accuracy_improvement, round(accuracy_improvement_pct, 4) AS accuracy_improvement_pct FROM c")
def m21(spark, sf):
    return runs(spark, sf).selectExpr("model", "round(original_accuracy, 6) AS original_accuracy", "round(cleaned_accuracy, 6) AS cleaned_accuracy", "round(accuracy_improvement, 6) AS accuracy_improvement", "round(accuracy_improvement_pct, 4) AS accuracy_improvement_pct")


@query("m22_best_model", f"WITH {RUNS_SQL} SELECT round(avg(accuracy_improvement), 6) AS mean_improvement, arg_max(model, accuracy_improvement) AS best_model, arg_min(model, accuracy_improvement) AS worst_model FROM c")
def m22(spark, sf):
    return metrics.best_model(runs(spark, sf)).selectExpr("round(mean_improvement, 6) AS mean_improvement", "best_model", "worst_model")


@query("m23_run_model")
def m23(spark, sf):
    return pt.run_model(doc_table(spark, sf).drop("toxic"), "decision_tree", "quality", "classification")


# The numeric columns of the job are two, so distances on their components equal distances on the
# standardised columns, and the noise rows can be checked by pairs.
Z1_SQL = f"""WITH t AS (SELECT * FROM {GAPS_SQL} WHERE {' AND '.join(RULES_SQL)}),
 s AS (SELECT avg(price) AS m, quantile_cont(price, 0.5) AS med, (count(*) - count(price)) * 100.0 / count(*) AS miss, (avg(price*price*price) - 3*avg(price)*avg(price*price) + 2*power(avg(price),3)) / power(stddev_pop(price),3) AS sk FROM t),
 f AS (SELECT _row_id, coalesce(price, CASE WHEN miss < 5 AND abs(sk) > 0.5 THEN med ELSE m END) AS price, coalesce(status, (SELECT status FROM t WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, status LIMIT 1)) AS status,
 coalesce(last_value(odate IGNORE NULLS) OVER (ORDER BY _row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(odate IGNORE NULLS) OVER (ORDER BY _row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS odate,
 CAST(regexp_extract(priority, '[0-9]+', 0) AS DOUBLE) AS priority, cust FROM t, s),
 u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY price, status, odate, priority, cust ORDER BY _row_id) = 1),
 p AS (SELECT _row_id AS id, (price - avg(price) OVER ()) / stddev_pop(price) OVER () AS x, (cust - avg(cust) OVER ()) / stddev_pop(cust) OVER () AS y FROM u),
 near AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.25), core AS (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) >= 5)
 SELECT _row_id, round(price, 4) AS price, status, odate, priority, cust FROM u WHERE _row_id IN (SELECT id FROM core) OR _row_id IN (SELECT a FROM near JOIN core ON b = core.id)"""


@query("z1_clean_table", Z1_SQL)
def z1(spark, sf):
    return pt.clean_table(gaps(spark, sf), RULES).df.withColumn("price", F.round("price", 4))


@query("z1_report")
def z1r(spark, sf):
    return pt.clean_table(gaps(spark, sf), RULES).report


@query("z2_process_graph")
def z2(spark, sf):
    return pg.process_graph(cg.parts(spark, sf), min_degree=40).stats


@query("z3_process_graph_advanced")
def z3(spark, sf):
    return pg.process_graph_advanced(cg.pages(spark, sf), min_degree=2, preserve_important=False).stats


@query("z4_process_images")
def z4(spark, sf):
    return pi.process_images(ci.tiles(spark, sf), True, **ci.LIMITS).improvement


@query("g56_compare_graphs")
def g56(spark, sf):
    g = cg.flow(spark, sf)
    cleaned = gcl.clean_graph(g, min_degree=2).graph
    return pg.compare_graphs(g, cleaned, models=["logistic_regression"])


@query("v20_compare_image_sets")
def v20(spark, sf):
    t = ci.texts(spark, sf)
    return pi.compare_image_sets(t, t.filter("file_size >= 200"), models=["logistic_regression"])
