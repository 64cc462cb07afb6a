import numpy as np
import pytest
from pyspark.sql import functions as F

from wattlens import constants as K
from wattlens.operators import forest, iforest, metrics, models


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(7)
    rows = [(f"p{i:03d}", *map(float, rng.normal(0, 1, 3))) for i in range(300)] + [("far", 12.0, -11.0, 10.0)]
    return spark.createDataFrame(rows, "customer_id string, avg_consumption double, std_consumption double, cv_consumption double")


def test_forest_is_repeatable_and_finds_the_outlier(points):
    features = ["avg_consumption", "std_consumption", "cv_consumption"]

    def run(df):
        out = models.anomaly_score(df, features, trees=60, seed=3)
        return {r.customer_id: (r.ai_anomaly_score, r.isolation_forest_flag) for r in out.collect()}
    first, again = run(points), run(points.repartition(5).orderBy(F.rand(2)))
    assert first.keys() == again.keys()
    assert all(first[k] == pytest.approx(again[k]) for k in first)
    assert max(first, key=lambda k: first[k][0]) == "far" and first["far"] == (100.0, 1)
    assert min(v[0] for v in first.values()) == 0.0


def test_path_length():
    assert list(iforest.path_length([1, 2])) == [0.0, 1.0]
    harmonic = np.log(255) + np.euler_gamma
    assert iforest.path_length(256) == pytest.approx(2 * harmonic - 2 * 255 / 256)


def test_sample_is_bounded(points):
    nodes = iforest.grow_forest(points.select("customer_id", F.array("avg_consumption").alias("x")), "customer_id", 4, 1).toPandas()
    roots = nodes[nodes["node"] == 0]
    assert len(roots) == 4 and set(roots["size"]) == {256} and nodes["depth"].max() <= 8


def test_feature_frame_fills_what_is_missing(spark):
    df = spark.createDataFrame([("a", 1.0, None, float("inf")), ("b", None, None, 3.0)], "customer_id string, x double, y double, z double")
    got = {r.customer_id: r.x for r in models.feature_vector(df, ["x", "y", "z", "w"]).collect()}
    assert got == {"a": [1.0, 0.0, 3.0, 0.0], "b": [1.0, 0.0, 3.0, 0.0]}


def test_expected_consumption(spark):
    rng = np.random.default_rng(1)
    rows = [(f"c{i}", float(b), float(b), float(b * (0.1 if i == 0 else 1))) for i, b in enumerate(rng.uniform(5, 50, 80))]
    df = spark.createDataFrame(rows, "customer_id string, previous_90_mean double, first_90_mean double, last_30_mean double")
    out = {r.customer_id: r for r in models.expected_consumption(df, trees=20).collect()}
    assert out["c0"].expected_deviation_pct > 0.3 and all(r.expected_deviation_pct >= 0 for r in out.values())
    assert models.expected_error(df, trees=10).first().expected_consumption_mae >= 0
    assert models.expected_error(df.limit(50), trees=10).count() == 0


def test_expected_forest_is_fitted_in_parts(spark):
    rng = np.random.default_rng(2)
    rows = [(f"c{i}", float(b), float(b)) for i, b in enumerate(rng.uniform(5, 50, 60))]
    df = spark.createDataFrame(rows, "customer_id string, first_90_mean double, last_30_mean double")
    model = models.fit_expected(df, trees=23)
    forests = [s for s in model.stages if hasattr(s, "getNumTrees")]
    assert [f.getNumTrees for f in forests] == [10, 10, 3]
    out = model.transform(models.feature_frame(df, K.EXPECTED_FEATURES)).collect()
    assert all(r.prediction == pytest.approx((10 * r._part_0 + 10 * r._part_1 + 3 * r._part_2) / 23) for r in out)
    assert not [c for c in models.expected_consumption(df, model).columns if c.startswith("_part_")]


def test_trees_are_those_of_plain_recursion():
    """One tree against a plain version, with nodes counted in several slices."""
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=500), rng.integers(0, 4, 500), np.ones(500)])
    y = np.round(x[:, 0] * 3 + x[:, 1], 1) + rng.normal(size=500)
    cuts = [forest.cut_points(v) for v in x.T]
    assert [len(c) for c in cuts] == [31, 3, 0] and list(cuts[1]) == [0.5, 1.5, 2.5]
    bins = np.stack([np.searchsorted(c, v).astype(np.uint8) for c, v in zip(cuts, x.T)])
    weight = np.random.default_rng(11).poisson(1.0, 500)

    def best(rows, depth):
        w, mean = weight[rows].sum(), np.average(y[rows], weights=weight[rows])
        options = []
        for f, points in enumerate(cuts if depth < 9 else []):
            for cut in points:
                a, b = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if min(weight[a].sum(), weight[b].sum()) >= 3:
                    gain = sum(weight[r].sum() / w * (np.average(y[r], weights=weight[r]) - mean) ** 2 for r in (a, b))
                    options.append((gain, a, b))
        gain, a, b = max(options, key=lambda o: o[0], default=(0, None, None))
        return [(w, round(mean, 9))] + (best(a, depth + 1) + best(b, depth + 1) if gain > 1e-9 else [])

    expected = best(np.flatnonzero(weight), 0)
    for cells in (forest.CELLS, 64):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(forest, "CELLS", cells)
            nodes = forest.grow_tree(bins, cuts, y, np.random.default_rng(11), 9, 3)
        assert sorted(zip(nodes["weight"], np.round(nodes["prediction"], 9))) == sorted(expected)
        leaf = forest.leaves(nodes, bins)
        assert (nodes["feature"][leaf] == -1).all() and np.bincount(leaf, weight)[leaf] == pytest.approx(nodes["weight"][leaf])


def test_expected_forest_is_applied_where_it_is_grown(spark, monkeypatch):
    """Rows whose ids repeat or are missing get the model's prediction, and no tree depends on the partitions."""
    rng = np.random.default_rng(3)
    rows = [(None if i % 7 == 0 else f"c{i % 50}", float(b), float(b) + float(e), None if i % 9 == 0 else float(b))
            for i, (b, e) in enumerate(zip(rng.uniform(5, 50, 300), rng.normal(size=300)))]
    df = spark.createDataFrame(rows, "customer_id string, first_90_mean double, last_30_mean double, previous_90_mean double")
    model = models.fit_expected(df, trees=12)
    with monkeypatch.context() as patch:
        patch.setattr(models, "fit_expected", None)  # whose model holds all nodes in the driver
        direct = models.expected_consumption(df, trees=12)
    names = ["customer_id", "first_90_mean", "last_30_mean", "expected_last_30_consumption", "expected_deviation_pct"]
    key = lambda r: tuple((v is None, v) for v in r)
    a = sorted((tuple(r) for r in direct.select(names).collect()), key=key)
    b = sorted((tuple(r) for r in models.expected_consumption(df.repartition(3), model).select(names).collect()), key=key)
    assert len(a) == 300 and [r[:3] for r in a] == [r[:3] for r in b]
    assert [r[3:] for r in a] == [pytest.approx(r[3:]) for r in b]
    assert direct.columns == models.expected_consumption(df, model).columns
    again = models.fit_expected(df.repartition(5), trees=12)
    first, second = (m.transform(models.feature_frame(df, K.EXPECTED_FEATURES)).agg(F.sum("prediction")).first()[0]
                     for m in (model, again))
    assert first == pytest.approx(second, rel=1e-12)


def test_classifier_needs_two_classes(spark, tmp_path):
    rows = [(f"c{i}", float(i % 2), float(i % 2) * 10 + i % 5) for i in range(80)]
    df = spark.createDataFrame(rows, "customer_id string, fraud_label double, avg_consumption double")
    out = models.fraud_probability(df, ["avg_consumption"], trees=15).collect()
    assert all((r.fraud_probability > 50) == (r.fraud_label == 1) for r in out)
    one = models.fraud_probability(df.withColumn("fraud_label", F.lit(1.0)), ["avg_consumption"], trees=5)
    assert one.filter("fraud_probability is not null").count() == 0
    few = models.fraud_probability(df.limit(20), ["avg_consumption"], trees=5)
    assert few.filter("fraud_probability is not null").count() == 0
    quality = models.classifier_metrics(df, ["avg_consumption"], trees=15).first()
    assert quality.fraud_classifier_roc_auc == 1.0 and quality.precision_at_top_10_percent == 1.0
    model = models.fit_classifier(df, ["avg_consumption"], trees=5)
    models.save_model(model, str(tmp_path / "model"))
    importance = models.feature_importance(model, ["avg_consumption"], spark).collect()
    assert sum(r.importance for r in importance) == pytest.approx(1.0)


def test_split_keeps_the_share_of_every_class(spark):
    df = spark.createDataFrame([(f"c{i}", 1.0 if i < 8 else 0.0) for i in range(48)], "customer_id string, fraud_label double")
    out = models.stratified_split(df, "fraud_label").groupBy("fraud_label").agg(F.count_if("is_holdout").alias("n")).collect()
    assert {r.fraud_label: r.n for r in out} == {1.0: 2, 0.0: 10}


def test_quality_figures(spark):
    rng = np.random.default_rng(9)
    y, p = rng.integers(0, 2, 200), np.round(rng.uniform(0, 1, 200), 1)
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "id int, y int, p double")
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert metrics.roc_auc(df, "y", "p").first().roc_auc == pytest.approx(np.mean(pairs))
    recall, area = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        now = y[p >= t].sum() / y.sum()
        area += (now - recall) * y[p >= t].mean()
        recall = now
    assert metrics.average_precision(df, "y", "p").first().average_precision == pytest.approx(area)
    assert metrics.r2(df.limit(2), "y", "p").first().r2 is None
    assert metrics.r2(df.withColumn("y", F.lit(1)), "y", "p").first().r2 is None
    assert metrics.roc_auc(df.filter("y = 1"), "y", "p").first().roc_auc is None
    top = metrics.topk_metrics(df.limit(3), "y", "p", "id").first()
    assert top.precision_at_top_10_percent in (0.0, 1.0)


def test_inputs_are_all_known_columns():
    assert len(K.MODEL_FEATURES) == 37 and len(K.EXPECTED_FEATURES) == 11 and len(K.UNIT_FEATURES) == 17
