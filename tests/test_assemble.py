"""E-06 on a hand-made credit fixture: one applicant with history, one without."""

from pyspark.sql import functions as F

from riskflow.operators.assemble import build_feature_table
from riskflow.sources.schemas import CREDIT_SOURCES


def _df(spark, name, rows):
    schema = CREDIT_SOURCES[name]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def test_feature_table(spark):
    t = {
        "application_train": _df(spark, "application_train", [
            {"SK_ID_CURR": 1, "TARGET": 1, "AMT_INCOME_TOTAL": 100.0, "AMT_CREDIT": 300.0, "DAYS_BIRTH": -10000,
             "DAYS_EMPLOYED": 365243, "CODE_GENDER": "M"},
            {"SK_ID_CURR": 2, "TARGET": 0, "AMT_INCOME_TOTAL": 200.0, "AMT_CREDIT": 100.0, "DAYS_BIRTH": -12000,
             "DAYS_EMPLOYED": -100, "CODE_GENDER": "F"}]),
        "application_test": _df(spark, "application_test", [
            {"SK_ID_CURR": 3, "AMT_INCOME_TOTAL": 50.0, "AMT_CREDIT": 80.0, "DAYS_BIRTH": -9000, "DAYS_EMPLOYED": -50,
             "CODE_GENDER": "XNA"}]),
        "bureau": _df(spark, "bureau", [{"SK_ID_BUREAU": 10, "SK_ID_CURR": 1, "CREDIT_ACTIVE": "Active",
                                         "AMT_CREDIT_SUM": 1000.0, "DAYS_CREDIT": -300}]),
        "bureau_balance": _df(spark, "bureau_balance", [{"SK_ID_BUREAU": 10, "MONTHS_BALANCE": -1, "STATUS": "2"},
                                                        {"SK_ID_BUREAU": 10, "MONTHS_BALANCE": -2, "STATUS": "X"}]),
        "previous_application": _df(spark, "previous_application", [{"SK_ID_PREV": 5, "SK_ID_CURR": 1,
                                                                     "NAME_CONTRACT_STATUS": "Approved"}]),
        "POS_CASH_balance": _df(spark, "POS_CASH_balance", [{"SK_ID_PREV": 5, "SK_ID_CURR": 1, "SK_DPD": 3}]),
        "credit_card_balance": _df(spark, "credit_card_balance", [{"SK_ID_PREV": 6, "SK_ID_CURR": 2, "AMT_BALANCE": 50.0,
                                                                   "AMT_CREDIT_LIMIT_ACTUAL": 40.0}]),
        "installments_payments": _df(spark, "installments_payments", [
            {"SK_ID_PREV": 5, "SK_ID_CURR": 1, "AMT_PAYMENT": 9.0, "AMT_INSTALMENT": 10.0, "DAYS_INSTALMENT": -10.0,
             "DAYS_ENTRY_PAYMENT": -5.0}]),
    }
    out = build_feature_table(t)
    rows = {r.SK_ID_CURR: r for r in out.collect()}
    assert set(rows) == {1, 2, 3} and "CODE_GENDER" not in out.columns and "CODE_GENDER_WOE" in out.columns
    r1, r2, r3 = rows[1], rows[2], rows[3]
    assert r1.FLAG_DAYS_EMPLOYED_ANOM == 1 and r1.DAYS_EMPLOYED is None
    assert r1.bureau_total_loans == 1 and r1.bureau_bb_dpd2_sum == 1 and r1.prev_approved_count == 1
    assert r1.pos_dpd_ever_flag == 1 and r1.inst_late_flag_sum == 1 and r1.inst_underpaid_sum == 1
    assert r2.bureau_total_loans is None and r2.cc_over_limit_sum == 1  # N12: no history -> NULL, no fill
    assert r3.split == "test" and r3.CODE_GENDER_WOE == 0.0  # unseen category
    assert out.filter(F.col("split") == "train").count() == 2
    # All features of the published list: everything but the key, the target and the split.
    features = [c for c in out.columns if c not in ("SK_ID_CURR", "TARGET", "split")]
    assert len(set(features)) == len(features) >= 271
    assert {"OWN_CAR_AGE", "APARTMENTS_AVG", "NONLIVINGAREA_MEDI", "TOTALAREA_MODE", "EMERGENCYSTATE_MODE_WOE"} <= set(features)
    # The categories are encoded within the row: the only joins are those of the five blocks.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") <= 7 and "_cat_" not in plan


def test_usage_flow_on_credit_fixture(spark):
    """The README flow: assemble -> folds -> cross-validated OOF -> metrics and cuts."""
    import random

    from riskflow.operators import folds, metrics, thresholds, train
    rnd = random.Random(8)
    apps, bureau = [], []
    for i in range(60):
        inc = 50.0 + rnd.random() * 100
        credit = inc * (1 + rnd.random() * 6)
        apps.append({"SK_ID_CURR": i, "TARGET": 1 if credit / inc > 5 or rnd.random() < 0.1 else 0,
                     "AMT_INCOME_TOTAL": inc, "AMT_CREDIT": credit, "DAYS_BIRTH": -9000 - i, "DAYS_EMPLOYED": -100})
        for j in range(rnd.randint(0, 3)):
            bureau.append({"SK_ID_BUREAU": i * 10 + j, "SK_ID_CURR": i, "CREDIT_ACTIVE": "Active",
                           "AMT_CREDIT_SUM": credit, "DAYS_CREDIT": -10 * j})
    t = {name: _df(spark, name, []) for name in CREDIT_SOURCES}
    t["application_train"] = _df(spark, "application_train", apps)
    t["bureau"] = _df(spark, "bureau", bureau)
    feats = build_feature_table(t)
    labelled = folds.stratified_folds(feats.filter("split = 'train'"), "SK_ID_CURR", "TARGET", k=3, seed=42)
    cols = ["CREDIT_TO_INCOME", "AGE_YEARS", "bureau_total_loans"]
    oof, _ = train.cross_validate(labelled, train.ModelSpec("lr", "logistic", {"C": 1.0, "maxIter": 50}), cols,
                                  "SK_ID_CURR", "TARGET", "fold", 3)
    m = metrics.full_metrics(oof, "label", "prob", 0.5, ["model"]).collect()[0]
    assert m.n_rows == 60 and m.auc_roc > 0.5
    opt = thresholds.threshold_optima(thresholds.threshold_sweep(oof, "label", "prob", ["model"]), ["model"]).collect()
    assert len(opt) == 1
