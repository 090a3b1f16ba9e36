"""Request-contract and decision cases mirroring the reference's API tests (as data, not HTTP)."""

from riskflow.operators import decide, validate

SCHEMA = ("id int, AMT_INCOME_TOTAL double, AMT_CREDIT double, AMT_ANNUITY double, DAYS_BIRTH int, "
          "DAYS_EMPLOYED int, EXT_SOURCE_2 double, CODE_GENDER string, FLAG_OWN_CAR string, AMT_GOODS_PRICE double")


def _violations(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = validate.with_violations(df, validate.application_contract())
    return {r.id: (r.is_valid, list(r.violations)) for r in out.collect()}


def test_minimal_record_is_accepted(spark):
    got = _violations(spark, [(1, 135000.0, 406597.5, 24700.5, -14235, -2160, None, None, None, None)])
    assert got[1] == (True, [])


def test_negative_cases_are_quarantined_with_reasons(spark):
    rows = [
        (1, None, 406597.5, 24700.5, -14235, -2160, None, None, None, None),   # missing required field
        (2, -5.0, 406597.5, 24700.5, -14235, -2160, None, None, None, None),   # negative income
        (3, 135000.0, 406597.5, 24700.5, -14235, -2160, None, "Q", None, None),  # bad enum
        (4, 135000.0, 406597.5, 24700.5, -14235, -2160, 1.5, None, None, None),  # score out of [0, 1]
        (5, 135000.0, 406597.5, 24700.5, -14235, 10, None, None, None, None),    # positive employment days
        (6, 135000.0, 406597.5, 24700.5, -14235, -2160, None, None, "X", None),  # pattern ^[YN]$
        (7, 135000.0, 100000.0, 24700.5, -14235, -2160, None, None, None, 500000.0),  # credit < 0.5 goods
    ]
    got = _violations(spark, rows)
    assert got[1] == (False, ["required:AMT_INCOME_TOTAL"])
    assert got[2] == (False, ["AMT_INCOME_TOTAL>0"])
    assert got[3] == (False, ["CODE_GENDER allowed"])
    assert got[4] == (False, ["EXT_SOURCE_2 in [0,1]"])
    assert got[5] == (False, ["DAYS_EMPLOYED<=0"])
    assert got[6] == (False, ["FLAG_OWN_CAR pattern"])
    assert got[7] == (False, ["credit>=0.5*goods"])


def test_golden_low_risk_path(spark):
    df = spark.createDataFrame([(0.08,)], "default_probability double")
    r = decide.risk_band(df).collect()[0]
    assert (r.risk_label, r.risk_score, r.recommended_action) == ("Low Risk", 920, "Approve")


def test_fallback_row_for_failed_score(spark):
    df = spark.createDataFrame([(None,)], "default_probability double")
    r = decide.with_fallback(df).collect()[0]
    assert (r.default_probability, r.risk_label, r.risk_score, r.recommended_action, r.is_fallback) == \
        (0.5, "High Risk", 500, "Manual review required", True)


def test_response_record_shape(spark):
    df = spark.createDataFrame([(1, 0.0843211), (2, None)], "id long, default_probability double")
    r = {x.id: x for x in decide.respond(df, id_col="id").collect()}
    assert (r[1].risk_label, r[1].risk_score, r[1].top_risk_factors) == ("Low Risk", 915, [])
    assert r[2].is_fallback and r[2].risk_score == 500 and len(r[1].prediction_id) == 64
