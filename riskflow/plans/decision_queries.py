"""Decisioning, portfolio and validation query keys (S-04 .. S-12, R-01 .. R-05, Q-01 .. Q-06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow.operators import decide as D
from riskflow.operators import thresholds as T
from riskflow.operators import validate as V
from riskflow.plans import analogues as an
from riskflow.plans.registry import finish, register, rounded_all

# Deterministic probability for the applicant analogue; NULL where the credit amount is missing
# (a scoring failure, handled by the fallback rule).
_PROB = ("CASE WHEN AMT_CREDIT IS NULL THEN NULL ELSE least(abs(AMT_INCOME_TOTAL) / 20000 "
         "+ CAST(-DAYS_ID_PUBLISH AS DOUBLE) / 6500, CAST(1 AS DOUBLE)) END")
_APPS = f"apps AS (SELECT *, {_PROB} AS default_probability FROM ({an.SQL_APPLICATION}) AS a)"


def scored_apps(spark, sf_dir):
    return an.application(spark, sf_dir).withColumn("default_probability", F.expr(_PROB))


def banded(spark, sf_dir):
    """S-06: bands with the fallback row for failed scores."""
    return D.with_fallback(scored_apps(spark, sf_dir))


_BAND_SQL = """
CASE WHEN p IS NULL THEN 'High Risk' WHEN p < 0.10 THEN 'Low Risk' WHEN p < 0.25 THEN 'Medium Risk'
     WHEN p < 0.50 THEN 'High Risk' ELSE 'Very High Risk' END AS risk_label,
CASE WHEN p IS NULL THEN 500 ELSE CAST(trunc((1 - p) * 1000) AS INT) END AS risk_score,
CASE WHEN p IS NULL THEN 'Manual review required' WHEN p < 0.10 THEN 'Approve' WHEN p < 0.25 THEN 'Approve with conditions'
     WHEN p < 0.50 THEN 'Manual review required' ELSE 'Decline' END AS recommended_action"""
_BANDED = f"{_APPS}, b AS (SELECT *, default_probability AS p, {_BAND_SQL}, default_probability IS NULL AS is_fallback FROM apps)"


@register("risk_bands", rounded_all(f"""WITH {_BANDED}
SELECT SK_ID_CURR, coalesce(p, 0.5) AS default_probability, risk_label, risk_score, recommended_action, is_fallback FROM b""",
    ["SK_ID_CURR", "risk_label", "risk_score", "recommended_action", "is_fallback"]))
def risk_bands(spark, sf_dir):
    """S-04 + S-06: band, truncated score, action; failed scores get the fallback row."""
    return finish(banded(spark, sf_dir).select("SK_ID_CURR", "default_probability", "risk_label", "risk_score",
                                               "recommended_action", "is_fallback"))


MODEL_VERSION = "1.0.0"


@register("score_batch", rounded_all(f"""WITH {_BANDED}
SELECT SK_ID_CURR, AMT_INCOME_TOTAL, AMT_CREDIT, coalesce(p, 0.5) AS default_probability, risk_score, risk_label,
  recommended_action, sha256(CAST(SK_ID_CURR AS VARCHAR) || ':{MODEL_VERSION}') AS prediction_id,
  '{MODEL_VERSION}' AS model_version FROM b""",
    ["SK_ID_CURR", "risk_score", "risk_label", "recommended_action", "prediction_id", "model_version"]))
def score_batch(spark, sf_dir):
    """S-06 / K-07 / S-02: scored batch ordered by probability (descending, id as tie-break) with a
    reproducible prediction id (sha-256 of id and model version)."""
    out = banded(spark, sf_dir).select(
        "SK_ID_CURR", "AMT_INCOME_TOTAL", "AMT_CREDIT", "default_probability", "risk_score", "risk_label",
        "recommended_action",
        F.sha2(F.concat(F.col("SK_ID_CURR").cast("string"), F.lit(f":{MODEL_VERSION}")), 256).alias("prediction_id"),
        F.lit(MODEL_VERSION).alias("model_version"))
    return finish(out).orderBy(F.col("default_probability").desc(), "SK_ID_CURR")


@register("affordability", rounded_all(f"""WITH a AS ({an.SQL_APPLICATION})
SELECT SK_ID_CURR,
  AMT_CREDIT / nullif(AMT_INCOME_TOTAL + 1, 0) AS credit_to_income,
  AMT_ANNUITY / nullif(AMT_INCOME_TOTAL + 1, 0) * 100 AS repayment_pct,
  CASE WHEN AMT_ANNUITY > 0 THEN AMT_CREDIT / AMT_ANNUITY END AS implied_tenure,
  AMT_INCOME_TOTAL * 4 AS safe_loan_cap,
  CASE WHEN AMT_CREDIT > AMT_INCOME_TOTAL * 4 THEN AMT_CREDIT - AMT_INCOME_TOTAL * 4 ELSE 0.0 END AS cap_excess,
  CASE WHEN AMT_CREDIT / nullif(AMT_INCOME_TOTAL + 1, 0) <= 4 THEN 'Safe'
       WHEN AMT_CREDIT / nullif(AMT_INCOME_TOTAL + 1, 0) <= 6 THEN 'Caution' ELSE 'High Risk' END AS cti_label,
  CASE WHEN AMT_ANNUITY / nullif(AMT_INCOME_TOTAL + 1, 0) * 100 <= 30 THEN 'Comfortable'
       WHEN AMT_ANNUITY / nullif(AMT_INCOME_TOTAL + 1, 0) * 100 <= 40 THEN 'Moderate' ELSE 'Too High' END AS repayment_label
FROM a""", ["SK_ID_CURR", "cti_label", "repayment_label"]))
def affordability(spark, sf_dir):
    """S-08 / S-09: affordability ratios with three-level labels."""
    out = D.affordability(an.application(spark, sf_dir))
    return finish(out.select("SK_ID_CURR", "credit_to_income", "repayment_pct", "implied_tenure", "safe_loan_cap",
                             "cap_excess", "cti_label", "repayment_label"))


_ADVICE_SQL = f"""{_APPS},
g AS (SELECT SK_ID_CURR, default_probability AS p,
        coalesce(AMT_CREDIT, 300000.0) / (coalesce(AMT_INCOME_TOTAL, 100000.0) + 1) AS cti,
        coalesce(AMT_ANNUITY, 20000.0) / (coalesce(AMT_INCOME_TOTAL, 100000.0) + 1) AS ati,
        (coalesce(nullif(EXT_SOURCE_1, 0), 0.5) + coalesce(nullif(EXT_SOURCE_2, 0), 0.5) + coalesce(nullif(EXT_SOURCE_3, 0), 0.5)) / 3 AS ext,
        abs(coalesce(DAYS_EMPLOYED, -1000)) / 365.25 AS emp, abs(coalesce(DAYS_BIRTH, -14000)) / 365.25 AS age
      FROM apps),
r AS (SELECT *,
        CASE WHEN cti > 5 THEN 'H:Reduce Loan Amount' WHEN cti > 4 THEN 'M:Loan Amount is on the Edge' END AS r1,
        CASE WHEN ati > 0.40 THEN 'H:Monthly Repayment Too High' WHEN ati > 0.30 THEN 'M:Repayment Burden is Moderate' END AS r2,
        CASE WHEN ext < 0.35 THEN 'H:External Credit Scores are Low' WHEN ext < 0.50 THEN 'M:Credit Scores Have Room to Improve' END AS r3,
        CASE WHEN emp < 1 THEN 'H:Very Short Employment History' WHEN emp < 2 THEN 'M:Employment Tenure is Short' END AS r4,
        CASE WHEN age < 25 THEN 'M:Young Applicant — Limited Credit History' END AS r5
      FROM g),
s AS (SELECT SK_ID_CURR, p,
        CASE WHEN r1 IS NULL AND r2 IS NULL AND r3 IS NULL AND r4 IS NULL AND r5 IS NULL AND p < 0.10
             THEN ['L:Profile is Strong'] ELSE list_filter([r1, r2, r3, r4, r5], lambda x: x IS NOT NULL) END AS t
      FROM r),
a AS (SELECT SK_ID_CURR,
        array_to_string(list_transform(t, lambda x: substr(x, 3)), '|') AS advice,
        CAST(len(list_filter(t, lambda x: x LIKE 'H:%')) AS INTEGER) AS n_high,
        CAST(len(list_filter(t, lambda x: x LIKE 'M:%')) AS INTEGER) AS n_medium,
        CAST(len(list_filter(t, lambda x: x LIKE 'L:%')) AS INTEGER) AS n_low
      FROM s)"""


@register("advice_rules", f"WITH {_ADVICE_SQL} SELECT * FROM a")
def advice_rules(spark, sf_dir):
    """S-10: prioritized advice titles ('|'-joined) and counts per priority."""
    return D.advice(scored_apps(spark, sf_dir)).select("SK_ID_CURR", "advice", "n_high", "n_medium", "n_low")


@register("advice_range", f"""WITH {_ADVICE_SQL}
SELECT SK_ID_CURR,
  CAST(CASE WHEN n_high + n_medium > 0 THEN least(n_high * 8 + n_medium * 4, 30) END AS INTEGER) AS improve_min_pct,
  CAST(CASE WHEN n_high + n_medium > 0 THEN least(n_high * 15 + n_medium * 8, 50) END AS INTEGER) AS improve_max_pct
FROM a""")
def advice_range(spark, sf_dir):
    """S-11: estimated improvement range from the number of high / medium advice items."""
    return D.advice(scored_apps(spark, sf_dir)).select("SK_ID_CURR", "improve_min_pct", "improve_max_pct")


@register("population_bucket", rounded_all(f"""WITH {_APPS}
SELECT SK_ID_CURR, default_probability / 0.0807 AS times_population_rate,
  CASE WHEN default_probability * 100 <= 5 THEN 'Very Low (<5%)' WHEN default_probability * 100 <= 10 THEN 'Low (5-10%)'
       WHEN default_probability * 100 <= 25 THEN 'Medium (10-25%)' WHEN default_probability * 100 <= 50 THEN 'High (25-50%)'
       ELSE 'Very High (>50%)' END AS population_bucket
FROM apps""", ["SK_ID_CURR", "population_bucket"]))
def population_bucket(spark, sf_dir):
    """S-12: multiple of the population default rate and the population bucket."""
    out = D.population_position(scored_apps(spark, sf_dir))
    return finish(out.select("SK_ID_CURR", "times_population_rate", "population_bucket"))


_SCORE_BAND_SQL = ("CASE WHEN risk_score >= 790 THEN 'Low Risk' WHEN risk_score >= 650 THEN 'Medium Risk' "
                   "WHEN risk_score >= 500 THEN 'High Risk' ELSE 'Very High Risk' END")


@register("portfolio_kpis", rounded_all(f"""WITH {_BANDED}
SELECT count(*) AS portfolio_size, avg(risk_score) AS avg_score,
  avg(CASE WHEN {_SCORE_BAND_SQL} IN ('High Risk', 'Very High Risk') THEN 1.0 ELSE 0.0 END)::DOUBLE AS high_risk_share
FROM b""", ["portfolio_size"]))
def portfolio_kpis(spark, sf_dir):
    """R-01: portfolio size, mean score and high-risk share (score bands)."""
    return finish(D.portfolio_kpis(banded(spark, sf_dir)))


@register("portfolio_bands", f"""WITH {_BANDED}
SELECT {_SCORE_BAND_SQL} AS risk_label, count(*) AS n,
  CAST(list_position(['Low Risk', 'Medium Risk', 'High Risk', 'Very High Risk'], {_SCORE_BAND_SQL}) AS BIGINT) AS band_order
FROM b GROUP BY ALL""")
def portfolio_bands(spark, sf_dir):
    """R-02 / K-08: population per score band in band order."""
    return D.portfolio_bands(banded(spark, sf_dir))


_CUTS = list(range(400, 901, 10))


@register("threshold_sensitivity", rounded_all(f"""WITH {_BANDED},
c AS (SELECT CAST(t AS DOUBLE) AS threshold FROM range(400, 901, 10) AS r(t))
SELECT threshold, count(b.risk_score) AS approved, (SELECT count(*) FROM b) - count(b.risk_score) AS declined,
  count(b.risk_score) * 100.0 / (SELECT count(*) FROM b) AS approved_pct,
  ((SELECT count(*) FROM b) - count(b.risk_score)) * 100.0 / (SELECT count(*) FROM b) AS declined_pct,
  CAST(count(b.risk_score) * 25000 AS DOUBLE) AS revenue
FROM c LEFT JOIN b ON b.risk_score >= c.threshold GROUP BY threshold""",
    ["threshold", "approved", "declined"]))
def threshold_sensitivity(spark, sf_dir):
    """R-03: approvals, declines, shares and revenue at every score cut 400..900 (step 10)."""
    return finish(T.threshold_sensitivity(banded(spark, sf_dir), "risk_score", _CUTS))


@register("decision_counts", f"""WITH {_BANDED}
SELECT count(*) AS total, count(*) FILTER (WHERE risk_label = 'Low Risk') AS approve,
  count(*) FILTER (WHERE risk_label IN ('Medium Risk', 'High Risk')) AS review,
  count(*) FILTER (WHERE risk_label = 'Very High Risk') AS decline FROM b""")
def decision_counts(spark, sf_dir):
    """R-04: approve / review / decline counts of a scored batch."""
    return D.decision_counts(banded(spark, sf_dir))


@register("prob_buckets", rounded_all(f"""WITH {_BANDED},
k AS (SELECT CASE WHEN default_probability < 0.10 THEN 'Low (<10%)' WHEN default_probability < 0.25 THEN 'Medium (10-25%)'
               WHEN default_probability < 0.50 THEN 'High (25-50%)' ELSE 'Very High (>50%)' END AS bucket, count(*) AS n
      FROM (SELECT coalesce(p, 0.5) AS default_probability FROM b) AS q GROUP BY ALL)
SELECT bucket, n, n::DOUBLE / sum(n) OVER () AS share FROM k""", ["bucket", "n"]))
def prob_buckets(spark, sf_dir):
    """R-05: probability-bucket counts and shares."""
    return finish(D.probability_buckets(banded(spark, sf_dir)))


# ------------------------------------------------------------------ validation

_VALIDATED = [c for c, _, _ in an.APPLICATION[1] if c != "NAME_CONTRACT_TYPE"]

# Hand-written oracle predicates, in contract order, for the columns the analogue carries.
_RULES_SQL = [
    ("required:AMT_INCOME_TOTAL", "AMT_INCOME_TOTAL IS NULL"),
    ("required:AMT_CREDIT", "AMT_CREDIT IS NULL"),
    ("required:AMT_ANNUITY", "AMT_ANNUITY IS NULL"),
    ("required:DAYS_BIRTH", "DAYS_BIRTH IS NULL"),
    ("required:DAYS_EMPLOYED", "DAYS_EMPLOYED IS NULL"),
    ("AMT_INCOME_TOTAL>0", "AMT_INCOME_TOTAL <= 0"),
    ("AMT_CREDIT>0", "AMT_CREDIT <= 0"),
    ("AMT_ANNUITY>0", "AMT_ANNUITY <= 0"),
    ("DAYS_BIRTH<0", "DAYS_BIRTH >= 0"),
    ("DAYS_EMPLOYED<=0", "DAYS_EMPLOYED > 0"),
    ("EXT_SOURCE_1 in [0,1]", "EXT_SOURCE_1 < 0 OR EXT_SOURCE_1 > 1"),
    ("EXT_SOURCE_2 in [0,1]", "EXT_SOURCE_2 < 0 OR EXT_SOURCE_2 > 1"),
    ("EXT_SOURCE_3 in [0,1]", "EXT_SOURCE_3 < 0 OR EXT_SOURCE_3 > 1"),
    ("AMT_GOODS_PRICE>0", "AMT_GOODS_PRICE <= 0"),
    ("CODE_GENDER allowed", "CODE_GENDER NOT IN ('M', 'F', 'XNA')"),
    ("CNT_CHILDREN in [0,20]", "CNT_CHILDREN < 0 OR CNT_CHILDREN > 20"),
    ("CNT_FAM_MEMBERS in [1,20]", "CNT_FAM_MEMBERS < 1 OR CNT_FAM_MEMBERS > 20"),
    ("DAYS_REGISTRATION<=0", "DAYS_REGISTRATION > 0"),
    ("DAYS_ID_PUBLISH<=0", "DAYS_ID_PUBLISH > 0"),
    ("FLAG_MOBIL in [0,1]", "FLAG_MOBIL < 0 OR FLAG_MOBIL > 1"),
    ("FLAG_EMP_PHONE in [0,1]", "FLAG_EMP_PHONE < 0 OR FLAG_EMP_PHONE > 1"),
    ("FLAG_WORK_PHONE in [0,1]", "FLAG_WORK_PHONE < 0 OR FLAG_WORK_PHONE > 1"),
    ("FLAG_PHONE in [0,1]", "FLAG_PHONE < 0 OR FLAG_PHONE > 1"),
    ("FLAG_EMAIL in [0,1]", "FLAG_EMAIL < 0 OR FLAG_EMAIL > 1"),
    ("AMT_REQ_CREDIT_BUREAU_MON>=0", "AMT_REQ_CREDIT_BUREAU_MON < 0"),
    ("AMT_REQ_CREDIT_BUREAU_QRT>=0", "AMT_REQ_CREDIT_BUREAU_QRT < 0"),
    ("AMT_REQ_CREDIT_BUREAU_YEAR>=0", "AMT_REQ_CREDIT_BUREAU_YEAR < 0"),
    ("credit>=0.5*goods", "AMT_GOODS_PRICE <> 0 AND AMT_CREDIT <> 0 AND AMT_CREDIT < AMT_GOODS_PRICE * 0.5"),
]
_VIOL_SQL = ", ".join(f"CASE WHEN coalesce({p}, false) THEN '{n}' END" for n, p in _RULES_SQL)


def _validated(spark, sf_dir):
    return an.application(spark, sf_dir).select(*_VALIDATED)


@register("validate_split", f"""WITH a AS ({an.SQL_APPLICATION}),
v AS (SELECT SK_ID_CURR, concat_ws(',', {_VIOL_SQL}) AS violations FROM a)
SELECT SK_ID_CURR, violations = '' AS is_valid, violations FROM v""")
def validate_split(spark, sf_dir):
    """Q-01 .. Q-06: every rule evaluated per row; valid flag and the ordered violation list."""
    v = V.with_violations(_validated(spark, sf_dir), V.application_contract())
    return v.select("SK_ID_CURR", "is_valid", F.array_join("violations", ",").alias("violations"))


@register("validate_rule_counts", "WITH a AS (" + an.SQL_APPLICATION + ") " + " UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) FILTER (WHERE coalesce({p}, false)) AS n_violations FROM a" for n, p in _RULES_SQL))
def validate_rule_counts(spark, sf_dir):
    """Q-06: per-rule violation counts (every applicable rule, zero included) in one pass."""
    return V.rule_counts(_validated(spark, sf_dir), V.application_contract())
