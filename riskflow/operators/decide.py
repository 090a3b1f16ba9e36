"""Decisioning and portfolio operators (S-04, S-06, S-08 .. S-12, R-01 .. R-05, K-07, K-08).

All are projections or one grouped aggregate; none needs Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.functions import nullsafe as ns

# Fixed values of the reference decision rules.
RISK_BANDS = [(0.10, "Low Risk", "Approve"), (0.25, "Medium Risk", "Approve with conditions"),
              (0.50, "High Risk", "Manual review required")]
RISK_TOP = ("Very High Risk", "Decline")
RISK_ORDER = ["Low Risk", "Medium Risk", "High Risk", "Very High Risk"]
FALLBACK = {"default_probability": 0.5, "risk_label": "High Risk", "risk_score": 500,
            "recommended_action": "Manual review required"}
SCORE_BANDS = [(790, "Low Risk"), (650, "Medium Risk"), (500, "High Risk")]
POPULATION_RATE = 0.0807
POPULATION_BUCKETS = [(5, "Very Low (<5%)"), (10, "Low (5-10%)"), (25, "Medium (10-25%)"),
                      (50, "High (25-50%)"), (100, "Very High (>50%)")]
PROB_BUCKETS = [(0.10, "Low (<10%)"), (0.25, "Medium (10-25%)"), (0.50, "High (25-50%)")]
PROB_TOP = "Very High (>50%)"
REVENUE_PER_LOAN = 25000


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _chain(x: Column, bands, top, strict: bool = True) -> Column:
    out = None
    for cut, val in bands:
        cond = x < F.lit(cut) if strict else x >= F.lit(cut)
        out = F.when(cond, F.lit(val)) if out is None else out.when(cond, F.lit(val))
    return out.otherwise(F.lit(top))


def risk_band(df: DataFrame, prob: str = "default_probability") -> DataFrame:
    """S-04: label, score int((1 - p) * 1000) (truncation, N15) and recommended action."""
    p = F.col(prob)
    return df.withColumns({
        "risk_label": _chain(p, [(c, lab) for c, lab, _ in RISK_BANDS], RISK_TOP[0]),
        "risk_score": ((F.lit(1.0) - p) * 1000).cast("int"),
        "recommended_action": _chain(p, [(c, act) for c, _, act in RISK_BANDS], RISK_TOP[1]),
    })


def with_fallback(df: DataFrame, prob: str = "default_probability") -> DataFrame:
    """S-06: rows whose score is missing get the reference fallback row values and ``is_fallback``."""
    miss = F.col(prob).isNull()
    d = risk_band(df, prob)
    return d.withColumns({
        "is_fallback": miss,
        prob: F.coalesce(F.col(prob), F.lit(FALLBACK["default_probability"])),
        "risk_label": F.when(miss, F.lit(FALLBACK["risk_label"])).otherwise(F.col("risk_label")),
        "risk_score": F.when(miss, F.lit(FALLBACK["risk_score"])).otherwise(F.col("risk_score")),
        "recommended_action": F.when(miss, F.lit(FALLBACK["recommended_action"])).otherwise(F.col("recommended_action")),
    })


def three_level(x: Column, good: float, warn: float, labels: Sequence[str]) -> Column:
    """S-09: <= good -> labels[0], <= warn -> labels[1], else labels[2]."""
    return F.when(x <= good, F.lit(labels[0])).when(x <= warn, F.lit(labels[1])).otherwise(F.lit(labels[2]))


def affordability(df: DataFrame, income="AMT_INCOME_TOTAL", credit="AMT_CREDIT", annuity="AMT_ANNUITY") -> DataFrame:
    """S-08 / S-09: credit/income, repayment %, implied tenure, safe cap 4x income and its excess."""
    i, c, a = _c(income), _c(credit), _c(annuity)
    cti = ns.ratio_plus1(c, i)
    ati = ns.ratio_plus1(a, i) * 100
    cap = i * 4
    return df.withColumns({
        "credit_to_income": cti,
        "repayment_pct": ati,
        "implied_tenure": F.when(a > 0, c / a),
        "safe_loan_cap": cap,
        "cap_excess": F.when(c > cap, c - cap).otherwise(F.lit(0.0)),
        "cti_label": three_level(cti, 4, 6, ["Safe", "Caution", "High Risk"]),
        "repayment_label": three_level(ati, 30, 40, ["Comfortable", "Moderate", "Too High"]),
    })


# Advice rules in priority order - (priority, title).
ADVICE = {
    "cti_high": ("high", "Reduce Loan Amount"),
    "cti_edge": ("medium", "Loan Amount is on the Edge"),
    "ati_high": ("high", "Monthly Repayment Too High"),
    "ati_mod": ("medium", "Repayment Burden is Moderate"),
    "ext_low": ("high", "External Credit Scores are Low"),
    "ext_mid": ("medium", "Credit Scores Have Room to Improve"),
    "emp_short": ("high", "Very Short Employment History"),
    "emp_mid": ("medium", "Employment Tenure is Short"),
    "young": ("medium", "Young Applicant — Limited Credit History"),
    "strong": ("low", "Profile is Strong"),
}
ADVICE_DEFAULTS = {"AMT_INCOME_TOTAL": 100000.0, "AMT_CREDIT": 300000.0, "AMT_ANNUITY": 20000.0,
                   "DAYS_BIRTH": -14000, "DAYS_EMPLOYED": -1000}


def advice(df: DataFrame, prob: str = "default_probability") -> DataFrame:
    """S-10 / S-11: prioritized advice titles, counts per priority and the improvement range. An income of -1 gives
    infinite ratios, which are above every limit."""
    g = {k: F.coalesce(F.col(k), F.lit(v)) for k, v in ADVICE_DEFAULTS.items()}
    ext = [ns.falsy_default(f"EXT_SOURCE_{i}", 0.5) for i in (1, 2, 3)]
    cti = ns.float_ratio(g["AMT_CREDIT"], g["AMT_INCOME_TOTAL"] + 1)
    ati = ns.float_ratio(g["AMT_ANNUITY"], g["AMT_INCOME_TOTAL"] + 1)
    ext_avg = (ext[0] + ext[1] + ext[2]) / 3
    emp = F.abs(g["DAYS_EMPLOYED"]) / 365.25
    age = F.abs(g["DAYS_BIRTH"]) / 365.25
    fired = [
        F.when(cti > 5, F.lit("cti_high")).when(cti > 4, F.lit("cti_edge")),
        F.when(ati > 0.40, F.lit("ati_high")).when(ati > 0.30, F.lit("ati_mod")),
        F.when(ext_avg < 0.35, F.lit("ext_low")).when(ext_avg < 0.50, F.lit("ext_mid")),
        F.when(emp < 1, F.lit("emp_short")).when(emp < 2, F.lit("emp_mid")),
        F.when(age < 25, F.lit("young")),
    ]
    rules = F.array_compact(F.array(*fired))
    rules = F.when((F.size(rules) == 0) & (F.col(prob) < 0.10), F.array(F.lit("strong"))).otherwise(rules)
    titles = F.create_map(*[x for k, (_, t) in ADVICE.items() for x in (F.lit(k), F.lit(t))])
    prio = F.create_map(*[x for k, (p, _) in ADVICE.items() for x in (F.lit(k), F.lit(p))])
    d = df.withColumn("_rules", rules)
    n_high = F.size(F.filter("_rules", lambda r: prio[r] == "high"))
    n_med = F.size(F.filter("_rules", lambda r: prio[r] == "medium"))
    return (d.withColumns({
        "advice": F.array_join(F.transform("_rules", lambda r: titles[r]), "|"),
        "n_high": n_high, "n_medium": n_med,
        "n_low": F.size(F.filter("_rules", lambda r: prio[r] == "low")),
    }).withColumns({
        "improve_min_pct": F.when(n_high + n_med > 0, F.least(n_high * 8 + n_med * 4, F.lit(30))),
        "improve_max_pct": F.when(n_high + n_med > 0, F.least(n_high * 15 + n_med * 8, F.lit(50))),
    }).drop("_rules"))


def population_position(df: DataFrame, prob: str = "default_probability") -> DataFrame:
    """S-12: multiple of the population default rate and the population bucket."""
    pct = F.col(prob) * 100
    bucket = None
    for t, name in POPULATION_BUCKETS:
        bucket = F.when(pct <= t, F.lit(name)) if bucket is None else bucket.when(pct <= t, F.lit(name))
    return df.withColumns({"times_population_rate": F.col(prob) / F.lit(POPULATION_RATE),
                           "population_bucket": bucket.otherwise(F.lit(POPULATION_BUCKETS[-1][1]))})


def score_band(score: Column) -> Column:
    """R-02: score >= 790 Low, >= 650 Medium, >= 500 High, else Very High."""
    return _chain(score, SCORE_BANDS, RISK_TOP[0], strict=False)


def portfolio_kpis(df: DataFrame, score: str = "risk_score") -> DataFrame:
    """R-01: size, mean score, share of High + Very High (score bands)."""
    band = score_band(F.col(score))
    return df.agg(F.count(F.lit(1)).alias("portfolio_size"), F.avg(score).alias("avg_score"),
                  F.avg(band.isin("High Risk", "Very High Risk").cast("double")).alias("high_risk_share"))


def portfolio_bands(df: DataFrame, score: str = "risk_score") -> DataFrame:
    """R-02 / K-08: population per score band in the fixed band order."""
    order = F.array(*[F.lit(x) for x in RISK_ORDER])
    return (df.groupBy(score_band(F.col(score)).alias("risk_label")).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("band_order", F.array_position(order, F.col("risk_label")))
              .orderBy("band_order"))


def decision_counts(df: DataFrame, label: str = "risk_label") -> DataFrame:
    """R-04: approve (Low), review (Medium, High), decline (Very High)."""
    c = F.col(label)
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(c == "Low Risk").alias("approve"),
                  F.count_if(c.isin("Medium Risk", "High Risk")).alias("review"),
                  F.count_if(c == "Very High Risk").alias("decline"))


def probability_buckets(df: DataFrame, prob: str = "default_probability") -> DataFrame:
    """R-05: counts and shares per probability bucket."""
    from pyspark.sql import Window
    b = _chain(F.col(prob), PROB_BUCKETS, PROB_TOP)
    w = Window.partitionBy(F.lit(1))  # four rows
    return (df.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("share", F.col("n") / F.sum("n").over(w)))


def respond(df: DataFrame, prob: str = "default_probability", factors: str | None = None, id_col: str | None = None,
            model_version: str = "1.0.0") -> DataFrame:
    """S-02 .. S-06 response record per row: probability rounded to 6 digits, band, score,
    action, top risk factors (array<struct>, empty when not requested), model version and a
    reproducible prediction id (sha-256 of the row id and the version). Failed scores get the
    fallback values (S-06)."""
    from riskflow.functions.rounding import round_double
    # The band and score are taken from the probability as returned (rounded to 6 digits).
    d = with_fallback(df.withColumn(prob, round_double(F.col(prob), 6)), prob)
    empty = F.array().cast("array<struct<feature:string,shap_value:double,direction:string,description:string>>")
    pid = (F.sha2(F.concat(F.col(id_col).cast("string"), F.lit(f":{model_version}")), 256) if id_col
           else F.expr("uuid()"))
    return d.withColumns({
        "top_risk_factors": F.coalesce(F.col(factors), empty) if factors else empty,
        "model_version": F.lit(model_version),
        "prediction_id": pid,
    })
