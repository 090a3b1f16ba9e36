"""A NULL group is a group, a NULL label is no label: every grouped operator, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.operators import calibration as C
from riskflow.operators import folds as FO
from riskflow.operators import metrics as M
from riskflow.operators import profile as P
from riskflow.operators import stability as ST
from riskflow.operators import thresholds as TH
from riskflow.operators import validate as V


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(600):
        s = round(float(rng.random()), 2)
        rows.append(((None, "x")[i % 2], None if i % 5 == 0 else int(rng.random() < s), s, None if i % 11 == 0 else float(rng.normal())))
    return spark.createDataFrame(rows, "g string, label int, prob double, v double"), rows


def groups(rows):
    return {g: [r for r in rows if r[0] == g] for g in (None, "x")}


def both(op):
    """Result of the operator by group, with NULL as key."""
    return {r.g: r for r in op.collect()}


def test_percentiles_boxes_and_imputation(data):
    df, rows = data
    per, box = both(P.percentiles(df, "v", [0.25, 0.5], ["g"])), both(P.box_stats(df, "v", ["g"]))
    filled = P.impute_median(df, "v", ["g"]).collect()
    assert len(filled) == 600 and all(r.v_IMPUTED is not None for r in filled)
    for g, own in groups(rows).items():
        v = [r[3] for r in own if r[3] is not None]
        assert per[g].p25 == pytest.approx(np.quantile(v, 0.25)) and per[g].p50 == pytest.approx(np.median(v)) and per[g].max == max(v)
        assert box[g].n == len(v) and box[g].median == pytest.approx(np.median(v))
        assert all(r.v_IMPUTED == pytest.approx(np.median(v)) for r in filled if r.g == g and r.v is None)
    whole = [r[3] for r in rows if r[3] is not None]
    assert P.percentiles(df, "v", [0.5]).first().p50 == pytest.approx(np.median(whole)) == P.box_stats(df, "v").first().median
    assert all(r.v_IMPUTED == pytest.approx(np.median(whole)) for r in P.impute_median(df, "v").collect() if r.v is None)


def test_calibration_and_density(data):
    df, rows = data
    for g, own in groups(rows).items():
        here = F.col("g").eqNullSafe(F.lit(g))
        one, alone = C.calibration_bins(df, groups=["g"], n_bins=7), C.calibration_bins(df.filter(here), n_bins=7)
        got, want = (np.array(sorted(map(tuple, x.collect()))) for x in (one.filter(here).drop("g"), alone))
        assert len(got) == 7 and np.allclose(got, want)
        one, alone = C.density_by_class(df, "v", bins=5, groups=["g"]), C.density_by_class(df.filter(here), "v", bins=5)
        got, want = ({(r.label, r.bin): (r.n, r.density) for r in x.collect()} for x in (one.filter(here), alone))
        assert got.keys() == want.keys() and np.allclose([got[k] for k in got], [want[k] for k in got])
        assert sum(n for n, _ in got.values()) == sum(r[3] is not None for r in own)


def test_psi_of_a_null_group_is_that_of_its_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.random(2000)
    make = lambda v: spark.createDataFrame([(g, float(a)) for g in (None, "x", "y") for a in (v if g != "y" else x)], "g string, v double")
    got = both(ST.psi(make(x), make(x ** 2), "v", ["g"]))
    assert got[None].psi == pytest.approx(got["x"].psi) and got[None].status == "critical" and got["y"].status == "stable"
    edges = np.quantile(x, np.linspace(0, 1, 11))
    e, a = (np.maximum(np.histogram(v, edges)[0] / len(v), 1e-4) for v in (x, x ** 2))
    assert got["x"].psi == pytest.approx(float(((e - a) * np.log(e / a)).sum()))
    alone = ST.psi(make(x).filter("g = 'x'").drop("g"), make(x ** 2).filter("g = 'x'").drop("g"), "v").first()
    assert alone.psi == pytest.approx(got["x"].psi)


def test_drift_report_reads_each_population_once(spark, tmp_path):
    rng = np.random.default_rng(8)
    a, b = (spark.createDataFrame([(float(x), float(y) if y > 0.1 else None) for x, y in rng.random((500, 2)) * k], "p double, q double") for k in (1.0, 1.3))
    a.write.parquet(str(tmp_path / "a"))
    b.write.parquet(str(tmp_path / "b"))
    base, live = spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b"))
    table = ST.unpivot_features(base, ["p", "q"]).unionByName(ST.unpivot_features(live, ["p", "q"]))
    assert table._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    report = ST.drift_report(base, live, ["p", "q"])
    # All that follows is read from the written table, not from the populations.
    assert "FileScan" not in report._jdf.queryExecution().executedPlan().toString()
    got = {r.feature: r for r in report.collect()}
    for f in ("p", "q"):
        for name, df in (("mean_train", base), ("mean_live", live)):
            assert got[f][name] == pytest.approx(df.agg(F.avg(f)).first()[0])
        one = ST.psi(base, live, f).first()
        assert got[f].psi == pytest.approx(one.psi) and got[f].status == one.status


def test_rows_without_a_label_count_nowhere(data):
    df, _ = data
    known = df.filter("label IS NOT NULL")
    key = lambda rows: sorted(map(str, rows))
    for op in (lambda d: M.rank_metrics(d, groups=["g"]), M.roc_points, M.pr_points, TH.threshold_sweep, lambda d: P.mann_whitney(d, "prob", "label"),
               lambda d: M.full_metrics(d, groups=["g"])):
        assert key(op(df).collect()) == key(op(known).collect())
    shared, own = [(0.2, 1), (0.2, 0), (0.2, None), (0.6, 1), (0.6, None), (0.9, 0)], [(0.25, None), (0.7, None)]
    few = df.sparkSession.createDataFrame([(y, s) for s, y in shared + own], "label int, prob double")
    r = M.full_metrics(few).first()
    assert (r.n_rows, r.n_pos, r.TP + r.FP + r.TN + r.FN) == (4, 2, 4)


def test_ungrouped_operators_join_nothing(data):
    df, _ = data
    for out in (P.percentiles(df, "v", [0.5]), P.box_stats(df, "v"), P.impute_median(df, "v"), C.calibration_bins(df), C.density_by_class(df, "v"),
                ST.psi(df, df, "v"), M.rank_metrics(df), M.full_metrics(df)):
        assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    rows = P.impute_median(df, "v")
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]


def test_rules_on_absent_columns(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    rules = [V.required("a"), V.gt("b", 0)]
    assert V.rule_counts(df, [V.gt("b", 0)]).count() == 0
    assert [tuple(r) for r in V.rule_counts(df, rules).collect()] == [("required:a", 2)]
    assert V.with_violations(df, rules).filter("is_valid").count() == 0


def test_folds_read_no_text(spark, tmp_path):
    rows = [(i if i % 9 else None, i % 3, "text " * 5, float(i)) for i in range(200)]
    spark.createDataFrame(rows, "id long, label int, text string, x double").write.parquet(str(tmp_path / "t"))
    out = FO.stratified_folds(spark.read.parquet(str(tmp_path / "t")), "id", "label", 4)
    plan = out.select("id", "fold")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema") >= 1 and "text:string" not in plan
    counts = {(r.label, r.fold): r.n for r in out.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 12
