"""Contracts: CSV by name, ungrouped reports, NULL groups, required columns, name fallback, bucket ids."""

import pytest
from pyspark.sql import functions as F

from riskflow.operators import metrics, profile, thresholds, validate, woe
from riskflow.sources import io


def scored(spark, n=2000):
    return spark.range(n).select(
        (F.pmod(F.xxhash64("id"), F.lit(100003)) / 100003).alias("prob"), (F.col("id") % 3 == 0).cast("int").alias("label"),
        F.when(F.col("id") % 2 == 0, F.lit("a")).alias("g"))


def test_csv_is_read_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("b,extra,a\n2.5,x,1\n,y,7\n")
    rows = io.read_csv(spark, str(tmp_path / "t.csv"), "a int, b double").collect()
    assert [tuple(r) for r in rows] == [(1, 2.5), (7, None)]
    with pytest.raises(ValueError):
        io.read_csv(spark, str(tmp_path / "t.csv"), "a int, c string")


def test_ungrouped_full_metrics(spark):
    df = scored(spark)
    one = metrics.full_metrics(df, "label", "prob").collect()
    same = metrics.full_metrics(df.withColumn("g", F.lit("x")), "label", "prob", groups=["g"]).collect()
    assert len(one) == 1 and one[0].auc_roc == pytest.approx(same[0].auc_roc) and one[0].TP == same[0].TP


def test_null_group_is_kept(spark):
    got = {r.g: r.n_rows for r in metrics.rank_metrics(scored(spark), "label", "prob", ["g"]).collect()}
    assert got == {"a": 1000, None: 1000}
    assert {r.g for r in profile.percentiles(scored(spark), "prob", [0.5], ["g"]).collect()} >= {"a"}


def test_metrics_do_not_rest_on_exchange_reuse(spark):
    df = scored(spark, 300_000)
    first = metrics.rank_metrics(df, "label", "prob").first()
    old = spark.conf.get("spark.sql.exchange.reuse")
    try:
        spark.conf.set("spark.sql.exchange.reuse", "false")
        second = metrics.rank_metrics(df, "label", "prob").first()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", old)
    assert first.auc_roc == pytest.approx(second.auc_roc, abs=1e-12) and first.n_rows == second.n_rows == 300_000


def test_absent_required_column_is_a_violation(spark):
    df = spark.createDataFrame([(1,)], "SK_ID_CURR int")
    row = validate.with_violations(df, validate.application_contract()).first()
    assert not row.is_valid and "required:AMT_INCOME_TOTAL" in row.violations


def test_feature_names_fall_back_only_without_any(spark):
    imp = spark.createDataFrame([("b",), ("zz",)], "feature string")
    reg = spark.createDataFrame([(["a", "b"],)], "feature_names array<string>")
    none = spark.createDataFrame([(None,)], "feature_names array<string>")
    assert [r.feature for r in io.feature_names(reg, imp).collect()] == ["a", "b"]
    assert [r.feature for r in io.feature_names(none, imp).collect()] == ["b", "zz"]


def test_sweep_keeps_null_groups_and_scans_once(spark):
    df = scored(spark)
    sweep = thresholds.threshold_sweep(df, "label", "prob", ["g"])
    assert "Join" not in sweep._jdf.queryExecution().executedPlan().toString()
    rows = {(r.g, r.threshold): r for r in sweep.collect()}
    assert len(rows) == 2 * 98
    data = [(r.g, r.prob, r.label) for r in df.collect()]
    for g, cut in (("a", 0.25), (None, 0.5)):
        mine = [(p, y) for h, p, y in data if h == g]
        r = rows[g, cut]
        assert (r.TP, r.FP) == (sum(p >= cut and y == 1 for p, y in mine), sum(p >= cut and y == 0 for p, y in mine))
        assert r.TP + r.FN + r.FP + r.TN == 1000
    optima = {r.g: r for r in thresholds.threshold_optima(sweep, ["g"]).collect()}
    for g in ("a", None):
        mine = sorted((r for (h, _), r in rows.items() if h == g), key=lambda r: r.threshold)
        assert optima[g].t_f1 == max(mine, key=lambda r: r.f1).threshold
        assert optima[g].t_biz_cost == min(mine, key=lambda r: r.biz_cost).threshold
    cuts = spark.createDataFrame([("a", "x", 0.25), (None, "x", 0.5)], "g string, cut string, threshold double")
    report = {r.g: r for r in metrics.report_at_cuts(df, cuts, "label", "prob", ["g"]).collect()}
    assert set(report) == {"a", None} and report[None].TP == rows[None, 0.5].TP and report["a"].FP == rows["a", 0.25].FP


def test_woe_map_is_fitted_once(spark):
    df = scored(spark).withColumn("h", F.col("g"))
    plan = woe.woe_transform(df, woe.woe_fit(df, "label", ["g", "h"]), ["g", "h"])
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert plan.filter("g_WOE is null or g_WOE <> h_WOE").count() == 0 and plan.count() == 2000
