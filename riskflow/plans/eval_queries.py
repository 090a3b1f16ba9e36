"""Threshold, blend, calibration and stability query keys (V-11, V-12, V-15 .. V-18, M-08, X-01 .. X-03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow.operators import calibration as C
from riskflow.operators import stability as ST
from riskflow.operators import thresholds as T
from riskflow.plans import analogues as an
from riskflow.plans.registry import finish, register, rounded_all

_CUTS = ", ".join(f"({i}, CAST({t!r} AS DOUBLE))" for i, t in enumerate(T.sweep_cuts()))

_SWEEP_SQL = f"""
sl AS ({an.SQL_SCORED_LONG}),
cuts AS (SELECT * FROM (VALUES {_CUTS}) AS v(i, t)),
k AS (SELECT model, i, t,
        count(*) FILTER (WHERE prob >= t AND label = 1) AS TP,
        count(*) FILTER (WHERE prob >= t AND label <> 1) AS FP,
        count(*) FILTER (WHERE prob < t AND label <> 1) AS TN,
        count(*) FILTER (WHERE prob < t AND label = 1) AS FN
      FROM sl JOIN cuts ON true GROUP BY model, i, t),
r AS (SELECT *, TP::DOUBLE / (TP + FP + 1e-9) AS pr, TP::DOUBLE / (TP + FN + 1e-9) AS re,
        TN::DOUBLE / (TN + FP + 1e-9) AS sp FROM k),
sweep AS (
  SELECT model, i, round(round(t, 9), 2) AS threshold,
    round(round(pr, 9), 4) AS precision, round(round(re, 9), 4) AS recall,
    round(round(sp, 9), 4) AS specificity,
    round(round(2.0 * TP / (2 * TP + FP + FN + 1e-9), 9), 4) AS f1,
    round(round(re + sp - 1, 9), 4) AS youden_j,
    round(round(1.0 * FP + 5.0 * FN, 9), 1)::DOUBLE AS biz_cost,
    round(round((TN + FN)::DOUBLE / (TP + FP + TN + FN), 9), 4) AS approval_rate,
    round(round(FN::DOUBLE / (TN + FN + 1e-9), 9), 4) AS bad_rate_approved,
    TP, FP, TN, FN
  FROM r)"""


@register("threshold_sweep", rounded_all(f"WITH {_SWEEP_SQL} SELECT * FROM sweep", ["model", "i"]))
def threshold_sweep(spark, sf_dir):
    """V-11: 98 cuts per model with confusion counts, rates, Youden J and cost (fp*1 + fn*5)."""
    sw = T.threshold_sweep(an.scored_long(spark, sf_dir), "label", "prob", ["model"])
    return finish(sw.withColumn("i", F.col("i").cast("int")))


@register("threshold_optima", rounded_all(f"""WITH {_SWEEP_SQL},
f AS (SELECT model, threshold AS t_f1, f1 AS best_f1 FROM sweep QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) = 1),
y AS (SELECT model, threshold AS t_youden_j, youden_j AS best_youden_j FROM sweep QUALIFY row_number() OVER (PARTITION BY model ORDER BY youden_j DESC, threshold) = 1),
c AS (SELECT model, threshold AS t_biz_cost, biz_cost AS best_biz_cost FROM sweep QUALIFY row_number() OVER (PARTITION BY model ORDER BY biz_cost, threshold) = 1)
SELECT * FROM f JOIN y USING (model) JOIN c USING (model)""", ["model"]))
def threshold_optima(spark, sf_dir):
    """V-12: optimal cut per model by F1, Youden J and cost; ties go to the lowest cut."""
    sw = T.threshold_sweep(an.scored_long(spark, sf_dir), "label", "prob", ["model"])
    return finish(T.threshold_optima(sw, ["model"]))


_GRID = ", ".join(f"({i}, CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE), CAST({c!r} AS DOUBLE))"
                  for i, a, b, c in T.blend_grid())


@register("blend_grid", rounded_all(f"""
WITH s AS ({an.SQL_SCORED}),
g AS (SELECT * FROM (VALUES {_GRID}) AS v(combo, w1, w2, w3)),
b AS (SELECT combo, label, w1 * m_len + w2 * m_mix + w3 * m_noise AS s FROM s JOIN g ON true),
h AS (SELECT combo, s, CAST(sum(label) AS DOUBLE) AS p, CAST(count(*) - sum(label) AS DOUBLE) AS n FROM b GROUP BY combo, s),
c AS (SELECT *, sum(p) OVER (PARTITION BY combo ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
        sum(p) OVER (PARTITION BY combo) AS tp_all, sum(n) OVER (PARTITION BY combo) AS tn_all FROM h),
a AS (SELECT combo, sum(n * (cp - p / 2)) / (max(tp_all) * max(tn_all)) AS auc_roc FROM c GROUP BY combo)
SELECT a.combo, auc_roc, round(w1, 1) AS w1, round(w2, 1) AS w2, round(w3, 2) AS w3,
  row_number() OVER (ORDER BY auc_roc DESC, a.combo) = 1 AS best
FROM a JOIN g USING (combo)""", ["combo", "best"]))
def blend_grid(spark, sf_dir):
    """M-08 / J-07: AUC of every blend on the reference weight grid; first maximum marked best."""
    return finish(T.blend_search(an.scored(spark, sf_dir), "label", ["m_len", "m_mix", "m_noise"]))


_CAL_LEVELS = ", ".join(f"CAST({q!r} AS DOUBLE)" for q in C.quantile_levels(15))


@register("calibration_bins", rounded_all(f"""
WITH sl AS ({an.SQL_SCORED_LONG}),
e AS (SELECT model, quantile_cont(prob, [{_CAL_LEVELS}]) AS edges FROM sl GROUP BY model),
b AS (SELECT sl.model, label, prob, len(list_filter(edges[2:15], lambda v: v < prob)) AS bin FROM sl JOIN e USING (model))
SELECT model, bin, avg(prob) AS mean_predicted, avg(label::DOUBLE) AS observed_rate, count(*) AS n
FROM b GROUP BY model, bin""", ["model", "bin"]))
def calibration_bins(spark, sf_dir):
    """V-15: 15 quantile bins per model, mean predicted vs observed default rate."""
    out = C.calibration_bins(an.scored_long(spark, sf_dir), "label", "prob", 15, ["model"])
    return finish(out.withColumn("bin", F.col("bin").cast("bigint")))


_PSI_LEVELS = ", ".join(f"CAST({q!r} AS DOUBLE)" for q in C.quantile_levels(10))


def _psi_sql(src: str, group: str, pop: str, val: str) -> str:
    return f"""
src AS ({src}),
e AS (SELECT {group}, quantile_cont({val}, [{_PSI_LEVELS}]) AS edges FROM src WHERE {pop} = 0 GROUP BY {group}),
b AS (SELECT src.{group}, {pop} AS pop,
        CASE WHEN {val} >= edges[1] AND {val} <= edges[11] THEN len(list_filter(edges[1:10], lambda v: v <= {val})) - 1 END AS bin
      FROM src JOIN e USING ({group})),
t AS (SELECT {group}, pop, count(*) AS total FROM b GROUP BY {group}, pop),
cnt AS (SELECT {group}, pop, bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY {group}, pop, bin),
d AS (SELECT {group}, pop, bin FROM e, (VALUES (0), (1)) AS pp(pop), range(10) AS r(bin)),
sh AS (SELECT d.{group}, d.pop, d.bin, greatest(coalesce(n::DOUBLE / total, 0), 1e-4) AS share
       FROM d LEFT JOIN cnt USING ({group}, pop, bin) LEFT JOIN t USING ({group}, pop)),
pv AS (SELECT {group}, bin, max(share) FILTER (WHERE pop = 0) AS e, max(share) FILTER (WHERE pop = 1) AS a
       FROM sh GROUP BY {group}, bin),
psi AS (SELECT {group}, sum((e - a) * ln(e / a)) AS psi FROM pv GROUP BY {group})"""


_STATUS_SQL = "CASE WHEN psi < 0.10 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'critical' END"


@register("psi_score", rounded_all(
    "WITH " + _psi_sql(f"SELECT model, prob, CASE WHEN CAST(substr(source, 4) AS INT) < 10 THEN 0 ELSE 1 END AS live "
                       f"FROM ({an.SQL_SCORED_LONG}) AS q", "model", "live", "prob")
    + f" SELECT model, psi, {_STATUS_SQL} AS status FROM psi", ["model", "status"]))
def psi_score(spark, sf_dir):
    """V-17 / V-18: score PSI per model, sources src0-9 as the expected population, src10-19 as actual."""
    sl = an.scored_long(spark, sf_dir).withColumn(
        "live", F.when(F.substring("source", 4, 10).cast("int") < 10, 0).otherwise(1))
    out = ST.psi(sl.filter("live = 0"), sl.filter("live = 1"), "prob", ["model"])
    return finish(out)


_FEATURES = ["value", "hour", "k"]
_EV_LONG = " UNION ALL ".join(f"SELECT '{f}' AS feature, live, {f} AS x FROM ({an.SQL_EVENTS}) AS e_{f}" for f in _FEATURES)
_DRIFT_SQL = "WITH " + _psi_sql(_EV_LONG, "feature", "live", "x") + """,
m AS (SELECT feature, avg(x) FILTER (WHERE live = 0) AS mean_train, avg(x) FILTER (WHERE live = 1) AS mean_live
      FROM src GROUP BY feature),
rep AS (SELECT feature, psi, """ + _STATUS_SQL + """ AS status, mean_train, mean_live FROM psi JOIN m USING (feature))"""


def _drift(spark, sf_dir):
    ev = an.events_monitored(spark, sf_dir)
    return ST.drift_report(ev.filter("live = 0"), ev.filter("live = 1"), _FEATURES)


@register("drift_report", rounded_all(_DRIFT_SQL + " SELECT * FROM rep", ["feature", "status"]))
def drift_report(spark, sf_dir):
    """X-01: per-feature PSI, status and means; events of the first half of the month are the baseline."""
    return finish(_drift(spark, sf_dir))


@register("drift_summary", rounded_all(_DRIFT_SQL + """
SELECT avg(psi) AS overall_psi, count(*) FILTER (WHERE psi > 0.10) AS n_drifted,
  CASE WHEN avg(psi) < 0.10 THEN 'stable' WHEN avg(psi) < 0.25 THEN 'moderate' ELSE 'critical' END AS overall_status,
  CASE WHEN avg(psi) < 0.10 THEN 'No action needed. Model is stable.'
       WHEN avg(psi) < 0.25 THEN 'Monitor closely. Consider retraining within 30 days.'
       ELSE 'Retrain model immediately.' END AS recommendation,
  coalesce(array_to_string(list_sort(list(feature) FILTER (WHERE psi > 0.10)), ','), '') AS drifted_features
FROM rep""", ["n_drifted", "overall_status", "recommendation", "drifted_features"]))
def drift_summary(spark, sf_dir):
    """X-02 / X-03: overall PSI (mean of features), status, recommendation and drifted features."""
    return finish(ST.drift_summary(_drift(spark, sf_dir)))


_RATES = """
  TP::DOUBLE / (TP + FP + 1e-9) AS precision, TP::DOUBLE / (TP + FN + 1e-9) AS recall,
  TN::DOUBLE / (TN + FP + 1e-9) AS specificity, 2.0 * TP / (2 * TP + FP + FN + 1e-9) AS f1,
  (TP::DOUBLE * TN - FP::DOUBLE * FN) / (sqrt((TP + FP)::DOUBLE * (TP + FN) * (TN + FP) * (TN + FN)) + 1e-9) AS mcc,
  (TN + FN)::DOUBLE / (TP + FP + TN + FN) AS approval_rate, FN::DOUBLE / (TN + FN + 1e-9) AS bad_rate_approved"""


@register("evaluation_report", rounded_all(f"""WITH {_SWEEP_SQL},
yj AS (SELECT model, threshold FROM sweep QUALIFY row_number() OVER (PARTITION BY model ORDER BY youden_j DESC, threshold) = 1),
rc AS (SELECT model, 'default' AS cut, 0.5::DOUBLE AS threshold FROM yj UNION ALL SELECT model, 'youden', threshold FROM yj),
cf AS (SELECT rc.model, cut, rc.threshold,
         count(*) FILTER (WHERE prob >= rc.threshold AND label = 1) AS TP,
         count(*) FILTER (WHERE prob >= rc.threshold AND label <> 1) AS FP,
         count(*) FILTER (WHERE prob < rc.threshold AND label <> 1) AS TN,
         count(*) FILTER (WHERE prob < rc.threshold AND label = 1) AS FN
       FROM sl JOIN rc ON sl.model = rc.model GROUP BY ALL),
hh AS (SELECT model, prob AS s, CAST(sum(label) AS DOUBLE) AS p, CAST(count(*) - sum(label) AS DOUBLE) AS n FROM sl GROUP BY model, prob),
cc AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY model) AS tot_p,
        sum(n) OVER (PARTITION BY model) AS tot_n
      FROM hh WINDOW w AS (PARTITION BY model ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rk AS (SELECT model, sum(n * (cp - p / 2)) / nullif(max(tot_p) * max(tot_n), 0) AS auc_roc,
        2 * (sum(n * (cp - p / 2)) / nullif(max(tot_p) * max(tot_n), 0)) - 1 AS gini,
        greatest(max(cp / nullif(tot_p, 0) - cn / nullif(tot_n, 0)), 0) AS ks_stat,
        sum(CASE WHEN p > 0 THEN (p / tot_p) * cp / (cp + cn) ELSE 0 END) AS auc_pr,
        sum(p * (s - 1) * (s - 1) + n * s * s) / (max(tot_p) + max(tot_n)) AS brier,
        -sum(p * ln(least(greatest(s, 2.220446049250313e-16), 1 - 2.220446049250313e-16))
             + n * ln(1 - least(greatest(s, 2.220446049250313e-16), 1 - 2.220446049250313e-16))) / (max(tot_p) + max(tot_n)) AS log_loss,
        CAST(max(tot_p) + max(tot_n) AS BIGINT) AS n_rows, CAST(max(tot_p) AS BIGINT) AS n_pos
      FROM cc GROUP BY model)
SELECT cf.*, {_RATES}, rk.* EXCLUDE (model) FROM cf JOIN rk USING (model)""", ["model", "cut"], 5))
def evaluation_report(spark, sf_dir):
    """V-21: full metric record per model at the default 0.5 cut and at the Youden-optimal cut."""
    from riskflow.operators import metrics as M
    sl = an.scored_long(spark, sf_dir)
    opt = T.threshold_optima(T.threshold_sweep(sl, "label", "prob", ["model"]), ["model"])
    cuts = (opt.select("model", F.lit("default").alias("cut"), F.lit(0.5).alias("threshold"))
               .unionByName(opt.select("model", F.lit("youden").alias("cut"), F.col("t_youden_j").alias("threshold"))))
    return finish(M.report_at_cuts(sl, cuts, "label", "prob", ["model"]), 5)


# Stored blend weights and member defaults of the reference serving path.
BLEND_WEIGHTS = {"m_len": 0.55, "m_mix": 0.45, "m_noise": 0.0}
MEMBER_DEFAULTS = {"m_len": 0.5, "m_mix": 0.5, "m_noise": 0.0}


@register("blend_scores", rounded_all(f"""WITH s AS ({an.SQL_SCORED})
SELECT doc_id, label,
  round(round(0.55 * coalesce(m_len, 0.5) + 0.45 * coalesce(m_mix, 0.5), 9), 6) AS default_probability
FROM s""", ["doc_id", "label"]))
def blend_scores(spark, sf_dir):
    """M-09 / S-02 / S-03: stored-weight blend (members at weight <= 0.01 skipped, missing members
    defaulted), score rounded to 6 digits."""
    from riskflow.functions.rounding import round_double
    b = T.blend(an.scored(spark, sf_dir), BLEND_WEIGHTS, "default_probability", defaults=MEMBER_DEFAULTS)
    return finish(b.select("doc_id", "label", round_double(F.col("default_probability"), 6).alias("default_probability")))
