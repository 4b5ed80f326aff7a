import math
import random

import pytest
from pyspark.sql import functions as F

from sievework.functions.columns import ROW_ID
from sievework.operators import dedup, encode, impute, metrics, outliers, profile, rules, synth, train
from sievework.operators.knn import nearest
from sievework.operators.ordering import exact_quantiles, ordered_index, take_per_group


def test_dedup_keeps_first_and_separates_fields(spark):
    df = spark.createDataFrame([(0, "ab", "c"), (1, "a", "bc"), (2, "ab", "c"), (3, None, "x"), (4, "", "x")], f"{ROW_ID} long, a string, b string")
    assert sorted(r[0] for r in dedup.dedup_rows(df).collect()) == [0, 1, 3, 4]
    assert [r[0] for r in dedup.duplicate_rows(df).collect()] == [2]


def test_hot_duplicate_group(spark):
    df = spark.range(3000).selectExpr(f"id AS {ROW_ID}", "IF(id % 3 = 0, 'same', CAST(id AS STRING)) AS a")
    assert dedup.dedup_rows(df).count() == 2001


def test_rules_never_drop_nulls(spark):
    df = spark.createDataFrame([(0, None, None), (1, 5.0, "a"), (2, 50.0, "b")], f"{ROW_ID} long, x double, k string")
    kept = rules.apply_rules(df, {"x": ["0", "10"], "k": ["a", "c"], "zz": ["1", "2"]})
    assert sorted(r[0] for r in kept.collect()) == [0, 1]
    assert rules.load_rules("/nonexistent.json") == {}


def test_validate_types(spark):
    rows = [(i, "TRUE" if i % 2 else "0", f"{i}kg" if i else "x", f"2024-01-{i + 1:02d}", f"g{i % 2}") for i in range(20)]
    got = profile.validate_types(spark.createDataFrame(rows, f"{ROW_ID} long, flag string, qty string, seen string, grp string"))
    assert got.types == {"flag": "boolean", "qty": "int", "seen": "datetime", "grp": "object"}
    assert [(r[0], r[1]) for r in got.invalid_rows.collect()] == [(0, "qty")]


def test_quantiles_bracket_matches_direct(spark):
    rng = random.Random(1)
    vals = [rng.gauss(0, 1) for _ in range(4000)] + [0.25] * 2000
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    probs = [0.01, 0.25, 0.5, 0.9]
    a = exact_quantiles(df, {"v": probs})["v"]
    b = exact_quantiles(df, {"v": probs}, direct_limit=50)["v"]
    assert a == pytest.approx(b)


def test_ordered_index_and_take(spark):
    df = spark.range(500).selectExpr(f"id AS {ROW_ID}", "(id * 37) % 500 AS v", "IF(id < 300, 'hot', 'cold') AS g")
    got = ordered_index(df, [F.col("v")]).collect()
    assert all(r.v == r.idx for r in got)
    taken = take_per_group(df, ["g"], F.ceil(F.col("_size") * 0.25), F.col(ROW_ID), 3, buckets=8)
    assert {r.g: r.n for r in taken.filter("_taken").groupBy("g").agg(F.count("*").alias("n")).collect()} == {"hot": 75, "cold": 50}
    assert taken.count() == 500


def test_forward_backward_fill(spark):
    vals = [None, None, 3, None, 5, None, None, 8, None]
    df = spark.createDataFrame(list(enumerate(vals)), f"{ROW_ID} long, v int").repartition(3)
    out = {r[0]: r[1] for r in impute.fill_forward_backward(df, ["v"]).collect()}
    assert [out[i] for i in range(9)] == [3, 3, 3, 3, 5, 5, 5, 8, 8]


def _brute(queries, donors, k):
    out = {}
    for q, x in queries:
        cand = []
        for y, v in donors:
            both = [(a - b) ** 2 for a, b in zip(x, y) if a is not None and b is not None]
            if both:
                cand.append((len(x) / len(both) * sum(both), v))
        out[q] = [v for _, v in sorted(cand)[:k]]
    return out


@pytest.mark.parametrize("d,gap", [(1, 0.0), (2, 0.2), (3, 0.0), (3, 0.3)])
def test_nearest_is_exact_on_skewed_points(spark, d, gap):
    rng = random.Random(d * 10 + int(gap * 10))

    def point():
        base = [rng.choice([0.0, rng.gauss(0, 1), rng.gauss(100, 0.01)]) for _ in range(d)]
        return [None if rng.random() < gap else v for v in base]

    donors = [(point(), rng.random()) for _ in range(300)] + [([0.0] * d, rng.random()) for _ in range(150)]
    queries = [(i, point()) for i in range(60)]
    names = [f"x{i}" for i in range(d)]
    cols = ", ".join(f"{n} double" for n in names)
    q = spark.createDataFrame([(i, *x) for i, x in queries], f"query_id long, {cols}")
    dn = spark.createDataFrame([(*x, v) for x, v in donors], f"{cols}, value double")
    got = {}
    for r in nearest(q, dn, names, 5).collect():
        got.setdefault(r.query_id, []).extend([r.value] * int(r.weight))
    want = _brute(queries, donors, 5)
    for i, vals in want.items():
        assert sorted(got.get(i, [])) == pytest.approx(sorted(vals)), i


def _brute_dbscan(pts, eps, m):
    near = {i: [j for j in range(len(pts)) if math.dist(pts[i], pts[j]) <= eps] for i in range(len(pts))}
    core = {i for i in near if len(near[i]) >= m}
    label, c = {}, 0
    for i in range(len(pts)):
        if i in core and i not in label:
            stack = [i]
            while stack:
                a = stack.pop()
                if a in label:
                    continue
                label[a] = c
                stack += [b for b in near[a] if b in core and b not in label]
            c += 1
    for i in range(len(pts)):
        if i not in core:
            label[i] = min((label[j] for j in near[i] if j in core), default=-1)
    return label


def test_dbscan_against_brute_force(spark):
    rng = random.Random(5)
    pts = [(rng.gauss(0, 0.4), rng.gauss(0, 0.4)) for _ in range(150)] + [(rng.uniform(-6, 6), rng.uniform(-6, 6)) for _ in range(120)]
    pts += [(3.0, 3.0)] * 60 + [(3.52, 3.0)] * 30
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], f"{ROW_ID} long, x double, y double")
    got = {r[0]: r[1] for r in outliers.dbscan_labels(df, ["x", "y"]).collect()}
    want = _brute_dbscan(pts, 0.5, 5)
    assert got == want
    assert {r[0] for r in outliers.noise_points(df, ["x", "y"]).collect()} == {i for i, c in want.items() if c == -1}


def test_encode_round_trip(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, None), (3, "c")], f"{ROW_ID} long, k string")
    codes = encode.label_codes(df, "k")
    coded = encode.label_encode(df, "k", codes)
    assert {r[0]: r[1] for r in coded.collect()} == {0: 1, 1: 0, 2: None, 3: 2}
    assert {r[0]: r[1] for r in encode.label_decode(coded, "k", codes).collect()} == {0: "b", 1: "a", 2: None, 3: "c"}


def test_metrics_on_empty_denominators(spark):
    pred = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "b")], "label string, prediction string")
    r = {x["class"]: x for x in metrics.classification_report(pred).collect()}
    assert r["a"].precision == 1.0 and r["a"].recall == 0.5
    assert r["b"].precision == 0.0 and r["b"].recall == 0.0 and r["c"].f1 == 0.0
    one = spark.createDataFrame([(1, 0.5), (1, 0.7)], "label int, score double")
    assert metrics.roc_auc(one).first()[0] is None


def test_synthesis_contract(spark):
    df = spark.range(400).selectExpr(f"id AS {ROW_ID}", "CAST(id % 50 AS INT) AS n", "id * 1.5D AS x", "IF(id % 3 = 0, 'u', 'v') AS k")
    out = synth.synthesize(df, 0.25, 7)
    new = out.filter(f"{ROW_ID} >= 400")
    assert out.count() == 500 and new.count() == 100
    row = new.agg(F.min("n"), F.max("n"), F.min("x"), F.max("x"), F.collect_set("k")).first()
    assert row[0] >= 0 and row[1] <= 49 and row[2] >= 0 and row[3] <= 598.5 and set(row[4]) <= {"u", "v"}
    assert sorted(map(str, out.collect())) == sorted(map(str, synth.synthesize(df, 0.25, 7).collect()))


def test_split_is_independent_of_partitioning(spark):
    df = spark.range(101).withColumnRenamed("id", ROW_ID)
    a = {r[0] for r in train.split(df.repartition(2), 0.2)[1].collect()}
    b = {r[0] for r in train.split(df.repartition(7), 0.2)[1].collect()}
    assert a == b and len(a) == 21


def labelled_vectors(spark, n, classes):
    """Mostly class 0; the feature tells the class."""
    df = spark.range(n).selectExpr(f"id AS {ROW_ID}", f"IF(id % 4 < 2, 0, id % {classes}) AS y")
    return train.assemble(df.selectExpr("*", f"y * 10.0D + {ROW_ID} % 3 AS a", "1.0D AS same"), ["a", "same"], "y")


def test_folds_spread_every_class(spark):
    tagged = train.stratified_folds(labelled_vectors(spark, 203, 7), 5)
    per = {}
    for r in tagged.groupBy("label", "_fold").count().collect():
        per.setdefault(r["label"], {})[r["_fold"]] = r["count"]
    assert sum(sum(x.values()) for x in per.values()) == 203
    for counts in per.values():
        got = [counts.get(f, 0) for f in range(5)]
        assert max(got) - min(got) <= 1


def test_scaling_learns_from_the_training_side(spark):
    data = labelled_vectors(spark, 40, 3)
    a, b = train.scale_by_train(data.filter(f"{ROW_ID} < 30"), data.filter(f"{ROW_ID} >= 30"))
    raw = [r["features"][0] for r in data.filter(f"{ROW_ID} < 30").orderBy(ROW_ID).collect()]
    mean = sum(raw) / 30
    spread = (sum((x - mean) ** 2 for x in raw) / 29) ** 0.5
    assert [r["features"][0] for r in a.orderBy(ROW_ID).collect()] == pytest.approx([(x - mean) / spread for x in raw])
    first = data.filter(f"{ROW_ID} = 30").first()["features"][0]
    assert b.orderBy(ROW_ID).first()["features"][0] == pytest.approx((first - mean) / spread)
    assert {r["features"][1] for r in a.union(b).collect()} == {0.0}


def test_area_only_for_two_classes(spark):
    for classes, told in ((2, True), (3, False)):
        data = labelled_vectors(spark, 60, classes)
        _, pred = train.fit_predict(data, data, "decision_tree", "classification")
        assert ("score" in pred.columns) == told
        area = train.evaluate_models(data, data, ["decision_tree"], "classification").first()["roc_auc"]
        assert (area == 1.0) if told else area is None


def test_area_with_nearly_all_scores_in_one_spot(spark):
    rng = random.Random(5)
    rows = [(rng.random() < 0.4, rng.choice([1e-9 * rng.randrange(300), 0.0, 1e6 * rng.random()] if i % 100 == 0 else [1e-9 * rng.randrange(300)])) for i in range(1500)]
    df = spark.createDataFrame([(int(a), float(s)) for a, s in rows] + [(1, None)], "label int, score double")
    pos, neg = [s for a, s in rows if a], [s for a, s in rows if not a]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    for size in (50, 1_000_000):
        assert metrics.roc_auc(df, per_range=size).first()[0] == pytest.approx(want)


def test_fourier_map_is_one_product_a_batch(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    rows = [(i, 1.0, Vectors.dense([i * 0.5, -i, 3.0])) for i in range(40)]
    mapped = train.fourier_features(spark.createDataFrame(rows, ["_row_id", "label", "features"]), 3, out=20)
    assert "ArrowEvalPython" in mapped._jdf.queryExecution().toString()
    rng = np.random.default_rng(42)
    w, b = rng.normal(scale=np.sqrt(2 / 3), size=(20, 3)), rng.uniform(0, 2 * np.pi, size=20)
    for r in mapped.collect():
        assert np.allclose(r.features.toArray(), np.cos(w @ rows[r["_row_id"]][2].toArray() + b) * np.sqrt(0.1), atol=1e-12)


def test_enhanced_images_leave_in_frames_of_their_own_size(spark, monkeypatch):
    from sievework.operators import images as im

    monkeypatch.setattr(im, "OUT_BYTES", 1000)
    row = lambda i: (f"{i}.png", 10, 10, 3, bytes(300), 300, False, False, False, False, False, False)
    frames = [*im._frames(row(i) for i in range(10))]
    assert [len(f) for f in frames] == [4, 4, 2] and [p for f in frames for p in f["path"]] == [f"{i}.png" for i in range(10)]
    assert [*im._frames(iter([]))] == []
    tiny = spark.createDataFrame([(f"{i}.png", 100, 2, 2, 1, bytearray(4)) for i in range(50)], "path string, file_size long, height int, width int, channels int, data binary")
    big = im.enhance_images(tiny, False, False, False, (20, 20))
    assert big.selectExpr("count(*)", "sum(length(data))").first()[:] == (50, 50 * 1200)


def test_nearest_fill_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(i, float(i) if i % 5 else None, float(i * i) if i % 7 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "_row_id long, a double, b double")
    out = {r._row_id: (r.a, r.b) for r in impute.fill_knn(df.mapInArrow(count, df.schema), ["a", "b"], 3).collect()}
    assert seen.value == 60
    assert len(out) == 60 and all(x is not None for r in out.values() for x in r) and out[1] == (1.0, 1.0)
