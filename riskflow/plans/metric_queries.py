"""Evaluation query keys over labelled, scored documents (V-01 .. V-22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow.operators import metrics as M
from riskflow.plans import analogues as an
from riskflow.plans.registry import finish, register, rounded_all

# Oracle building blocks: per-(model, distinct score) counts with cumulative sums.
_POINTS_SQL = f"""
sl AS ({an.SQL_SCORED_LONG}),
h AS (SELECT model, prob AS s, CAST(sum(label) AS DOUBLE) AS p, CAST(count(*) - sum(label) AS DOUBLE) AS n
      FROM sl GROUP BY model, prob),
c AS (SELECT *,
        sum(p) OVER w AS cp, sum(n) OVER w AS cn,
        lead(p) OVER (PARTITION BY model ORDER BY s DESC) AS next_p,
        lead(n) OVER (PARTITION BY model ORDER BY s DESC) AS next_n,
        sum(p) OVER (PARTITION BY model) AS tot_p, sum(n) OVER (PARTITION BY model) AS tot_n
      FROM h WINDOW w AS (PARTITION BY model ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

_EPS = M.LOG_LOSS_EPS
_RANK_SQL = f"""
SELECT model,
  sum(n * (cp - p / 2)) / nullif(max(tot_p) * max(tot_n), 0) AS auc_roc,
  2 * (sum(n * (cp - p / 2)) / nullif(max(tot_p) * max(tot_n), 0)) - 1 AS gini,
  greatest(max(cp / nullif(tot_p, 0) - cn / nullif(tot_n, 0)), 0) AS ks_stat,
  sum(CASE WHEN p > 0 THEN (p / tot_p) * cp / (cp + cn) ELSE 0 END) AS auc_pr,
  sum(p * (s - 1) * (s - 1) + n * s * s) / (max(tot_p) + max(tot_n)) AS brier,
  -sum(p * ln(least(greatest(s, {_EPS!r}), 1 - {_EPS!r})) + n * ln(1 - least(greatest(s, {_EPS!r}), 1 - {_EPS!r})))
     / (max(tot_p) + max(tot_n)) AS log_loss,
  CAST(max(tot_p) + max(tot_n) AS BIGINT) AS n_rows, CAST(max(tot_p) AS BIGINT) AS n_pos
FROM c GROUP BY model"""


@register("rank_metrics", rounded_all(f"WITH {_POINTS_SQL} {_RANK_SQL}", ["model"]))
def rank_metrics(spark, sf_dir):
    """V-01 .. V-06 per model: exact tie-aware AUC, Gini, KS, AP, Brier, log loss."""
    return finish(M.rank_metrics(an.scored_long(spark, sf_dir), "label", "prob", ["model"]))


@register("roc_points", rounded_all(f"""WITH {_POINTS_SQL}
SELECT model, cn / tot_n AS fpr, cp / tot_p AS tpr, s AS threshold FROM c
WHERE cp + cn = p + n OR next_p IS NULL OR next_p <> p OR next_n <> n
UNION ALL
SELECT DISTINCT model, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr, 'inf'::DOUBLE AS threshold FROM c""", ["model"]))
def roc_points(spark, sf_dir):
    """V-13 with intermediate (collinear) points dropped, plus the (0, 0, inf) start."""
    return finish(M.roc_points(an.scored_long(spark, sf_dir), "label", "prob", ["model"]))


@register("pr_points", rounded_all(f"""WITH {_POINTS_SQL}
SELECT model, cp / (cp + cn) AS precision, cp / tot_p AS recall, s AS threshold FROM c
UNION ALL
SELECT DISTINCT model, 1.0::DOUBLE AS precision, 0.0::DOUBLE AS recall, NULL::DOUBLE AS threshold FROM c""", ["model"]))
def pr_points(spark, sf_dir):
    """V-14: precision/recall per distinct score, plus the (1, 0) end point."""
    return finish(M.pr_points(an.scored_long(spark, sf_dir), "label", "prob", ["model"]))


_CONF_SQL = """
SELECT {g},
  count(*) FILTER (WHERE prob >= {t} AND label = 1) AS TP,
  count(*) FILTER (WHERE prob >= {t} AND label <> 1) AS FP,
  count(*) FILTER (WHERE prob < {t} AND label <> 1) AS TN,
  count(*) FILTER (WHERE prob < {t} AND label = 1) AS FN
FROM sl GROUP BY {g}"""

_RATES_SQL = """
  TP::DOUBLE / (TP + FP + 1e-9) AS precision,
  TP::DOUBLE / (TP + FN + 1e-9) AS recall,
  TN::DOUBLE / (TN + FP + 1e-9) AS specificity,
  2.0 * TP / (2 * TP + FP + FN + 1e-9) AS f1,
  (TP::DOUBLE * TN - FP::DOUBLE * FN) / (sqrt((TP + FP)::DOUBLE * (TP + FN) * (TN + FP) * (TN + FN)) + 1e-9) AS mcc,
  (TN + FN)::DOUBLE / (TP + FP + TN + FN) AS approval_rate,
  FN::DOUBLE / (TN + FN + 1e-9) AS bad_rate_approved"""


@register("confusion_metrics", rounded_all(f"""
WITH sl AS ({an.SQL_SCORED_LONG}), k AS ({_CONF_SQL.format(g='model', t='0.5')})
SELECT model, TP, FP, TN, FN, {_RATES_SQL} FROM k""", ["model"]))
def confusion_metrics(spark, sf_dir):
    """V-07 .. V-10 at the 0.5 cut per model."""
    return finish(M.confusion_at(an.scored_long(spark, sf_dir), "label", "prob", 0.5, ["model"]))


_G_POINTS_SQL = _POINTS_SQL.replace("PARTITION BY model", "PARTITION BY model, lang").replace(
    "GROUP BY model, prob", "GROUP BY model, lang, prob").replace("SELECT model, prob AS s", "SELECT model, lang, prob AS s")
_G_RANK_SQL = _RANK_SQL.replace("SELECT model,", "SELECT model, lang,").replace("GROUP BY model", "GROUP BY model, lang")


@register("full_metrics_by_group", rounded_all(f"""
WITH {_G_POINTS_SQL}, r AS ({_G_RANK_SQL}), k AS ({_CONF_SQL.format(g='model, lang', t='0.5')})
SELECT r.*, k.* EXCLUDE (model, lang), {_RATES_SQL}, 0.5::DOUBLE AS threshold
FROM r JOIN k USING (model, lang)""", ["model", "lang"], 5))
def full_metrics_by_group(spark, sf_dir):
    """V-19 / V-20: full metric record per (model, language) segment, rounded to 5 digits."""
    return finish(M.full_metrics(an.scored_long(spark, sf_dir), "label", "prob", 0.5, ["model", "lang"]), 5)


@register("model_comparison", rounded_all(f"""
WITH {_POINTS_SQL}, r AS ({_RANK_SQL}), k AS ({_CONF_SQL.format(g='model', t='0.5')}),
m AS (SELECT r.model, round(round(auc_roc, 9), 5) AS auc_roc, gini, ks_stat, auc_pr, brier, {_RATES_SQL}
      FROM r JOIN k USING (model))
SELECT model, auc_roc, gini, ks_stat, auc_pr, brier, f1, precision, recall,
  max(CASE WHEN lower(model) LIKE '%noise%' THEN auc_roc END) OVER () AS baseline_auc,
  row_number() OVER (ORDER BY auc_roc DESC, model) AS rank,
  (auc_roc - max(CASE WHEN lower(model) LIKE '%noise%' THEN auc_roc END) OVER ()) * 100 AS gain_pp
FROM m""", ["model", "rank"], 5))
def model_comparison(spark, sf_dir):
    """V-22 + K-06: per-model record ranked by (rounded) AUC with the gain over the baseline in points.
    The noise score plays the baseline model."""
    from riskflow.plans.registry import round_double
    fm = M.full_metrics(an.scored_long(spark, sf_dir), "label", "prob", 0.5, ["model"])
    fm = fm.withColumn("auc_roc", round_double(F.col("auc_roc"), 5)).select(
        "model", "auc_roc", "gini", "ks_stat", "auc_pr", "brier", "f1", "precision", "recall")
    out = M.compare_models(fm, "model", "noise", "auc_roc").withColumn("rank", F.col("rank").cast("long"))
    return finish(out, 5)
