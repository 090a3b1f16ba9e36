"""Properties of the evaluation, encoding and fold operators."""

import itertools
import random

from pyspark.sql import functions as F

from riskflow.operators import folds, metrics, stability, woe


def _pairwise_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_auc_equals_pairwise_count_with_ties(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "label int, prob double")
    got = metrics.rank_metrics(df, buckets=16).collect()[0].auc_roc
    assert abs(got - _pairwise_auc(rows)) < 1e-12


def test_tied_scores_auc_half(spark):
    df = spark.createDataFrame([(1, 0.3), (0, 0.3)], "label int, prob double")
    assert metrics.rank_metrics(df).collect()[0].auc_roc == 0.5


def test_confusion_counts_sum_to_n(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(rnd.randint(0, 1), rnd.random()) for _ in range(200)], "label int, prob double")
    r = metrics.confusion_at(df, threshold=0.4).collect()[0]
    assert r.TP + r.FP + r.TN + r.FN == 200


def test_psi_same_population_is_zero(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(rnd.random(),) for _ in range(500)], "x double")
    assert abs(stability.psi(df, df, "x").collect()[0].psi) < 1e-12


def test_folds_disjoint_and_balanced(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 7 == 0).cast("int"))
    f = folds.stratified_folds(df, "id", "label", k=5)
    assert f.count() == 1000 and f.select("id").distinct().count() == 1000
    counts = {(r.label, r.fold): r.n for r in f.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}
    for lab in (0, 1):
        c = [counts[(lab, k)] for k in range(5)]
        assert max(c) - min(c) <= 1


def test_woe_unseen_is_zero_and_iv_nonnegative(spark):
    train = spark.createDataFrame([("a", 1), ("a", 0), ("b", 0), ("b", 0), (None, 1)], "c string, y int")
    m = woe.woe_fit(train, "y", ["c"])
    assert all(r.iv >= 0 for r in woe.information_value(m).collect())
    test = spark.createDataFrame([("z",), ("a",)], "c string")
    got = {r.c: r.c_WOE for r in woe.woe_transform(test, m, ["c"]).collect()}
    assert got["z"] == 0.0 and got["a"] != 0.0


def test_risk_band_edges_and_score_truncation(spark):
    from riskflow.operators import decide
    df = spark.createDataFrame([(0.0999,), (0.10,), (0.25,), (0.50,), (0.0843,)], "p double")
    rows = decide.risk_band(df, "p").collect()
    assert [r.risk_label for r in rows[:4]] == ["Low Risk", "Medium Risk", "High Risk", "Very High Risk"]
    assert rows[4].risk_score == 915


def test_exact_quantiles_match_numpy_with_ties_and_small_buckets(spark):
    import numpy as np
    from riskflow.operators.prefix import exact_quantiles
    rnd = random.Random(11)
    vals = [(g, float(rnd.randint(0, 40))) for g in ("a", "b") for _ in range(257)]
    df = spark.createDataFrame(vals, "g string, x double")
    levels = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {r.g: r.q for r in exact_quantiles(df, "x", levels, ["g"], buckets=4).collect()}
    for g in ("a", "b"):
        ref = np.percentile([x for gg, x in vals if gg == g], [q * 100 for q in levels])
        assert np.allclose(got[g], ref, rtol=0, atol=1e-12)


def test_rank_metrics_independent_of_bucket_count(spark):
    rnd = random.Random(13)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "label int, prob double")
    a = metrics.rank_metrics(df, buckets=2).collect()[0]
    b = metrics.rank_metrics(df, buckets=64).collect()[0]
    assert abs(a.auc_roc - b.auc_roc) < 1e-12 and abs(a.ks_stat - b.ks_stat) < 1e-12 and abs(a.auc_pr - b.auc_pr) < 1e-12
    assert abs(a.auc_roc - _pairwise_auc(rows)) < 1e-12


def test_roc_points_drop_collinear(spark):
    # Scores 0.9, 0.8, 0.7 each with one positive: the middle point is collinear and dropped.
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.1)], "label int, prob double")
    pts = sorted((r.fpr, r.tpr) for r in metrics.roc_points(df).collect())
    assert pts == [(0.0, 0.0), (0.0, 1 / 3), (0.0, 1.0), (1.0, 1.0)]


def test_woe_estimator_in_pipeline(spark):
    from pyspark.ml import Pipeline
    train = spark.createDataFrame([("a", 1), ("a", 0), ("b", 0), ("b", 0), (None, 1)], "c string, label int")
    model = Pipeline(stages=[woe.WoEEncoder(inputCols=["c"], labelCol="label")]).fit(train)
    out = {r.c: r.c_WOE for r in model.transform(train).collect()}
    direct = {r.c: r.c_WOE for r in woe.woe_transform(train, woe.woe_fit(train, "label", ["c"]), ["c"]).collect()}
    assert out == direct
