"""Encoding and fold query keys (E-01 .. E-05, W-01, M-01, A-77, D-14) over labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow.operators import folds as FO
from riskflow.operators import metrics as M
from riskflow.operators import woe as W
from riskflow.plans import analogues as an
from riskflow.plans.registry import finish, register, rounded_all
from riskflow.sources.tables import read_table

CATS = ["lang", "source"]
SEED, K = 42, 5

_STACK_SQL = " UNION ALL ".join(
    f"SELECT label, '{c}' AS \"column\", coalesce(CAST({c} AS VARCHAR), '__MISSING__') AS category FROM s" for c in CATS)
_MAP_SQL = f"""
s AS ({an.SQL_SCORED}),
st AS ({_STACK_SQL}),
c AS (SELECT "column", category, CAST(sum(label) AS BIGINT) AS events, count(*) AS total FROM st GROUP BY ALL),
t AS (SELECT "column", sum(events)::DOUBLE AS E, sum(total)::DOUBLE AS T, count(*)::DOUBLE AS k FROM c GROUP BY "column"),
d AS (SELECT c.*, (events + 0.5) / (E + 0.5 * k) AS de, (total - events + 0.5) / (T - E + 0.5 * k) AS dn
      FROM c JOIN t USING ("column")),
m AS (SELECT "column", category, events, total, ln(de / dn) AS woe, (de - dn) * ln(de / dn) AS iv FROM d)"""


@register("woe_fit", rounded_all(f"WITH {_MAP_SQL} SELECT * FROM m", ['"column"', "category"]))
def woe_fit(spark, sf_dir):
    """E-01 / E-02: smoothed WoE map per (column, category) with each category's IV share."""
    return finish(W.woe_fit(an.scored(spark, sf_dir), "label", CATS))


@register("iv_rank", rounded_all(f"""WITH {_MAP_SQL},
iv AS (SELECT "column", sum(iv) AS iv FROM m GROUP BY "column")
SELECT "column", iv,
  CASE WHEN iv < 0.02 THEN 'Unpredictive' WHEN iv < 0.10 THEN 'Weak' WHEN iv < 0.30 THEN 'Medium'
       WHEN iv < 0.50 THEN 'Strong' ELSE 'Suspicious' END AS strength,
  row_number() OVER (ORDER BY iv DESC, "column") AS iv_rank
FROM iv""", ['"column"', "strength", "iv_rank"]))
def iv_rank(spark, sf_dir):
    """E-02 / E-03 / K-03: information value per column, strength band, ranking."""
    m = W.woe_fit(an.scored(spark, sf_dir), "label", CATS)
    return finish(W.information_value(m).withColumn("iv_rank", F.col("iv_rank").cast("long")))


@register("woe_transform", rounded_all(f"""WITH {_MAP_SQL}
SELECT doc_id,
  coalesce((SELECT woe FROM m WHERE "column" = 'lang' AND category = coalesce(d.lang, '__MISSING__')), 0.0) AS lang_WOE,
  coalesce((SELECT woe FROM m WHERE "column" = 'source' AND category = coalesce(d.source, '__MISSING__')), 0.0) AS source_WOE
FROM documents AS d""", ["doc_id"]))
def woe_transform(spark, sf_dir):
    """E-04 / J-04: map fitted on labelled documents applied to every document (unseen -> 0)."""
    m = W.woe_fit(an.scored(spark, sf_dir), "label", CATS)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return finish(W.woe_transform(docs, m, CATS).select("doc_id", "lang_WOE", "source_WOE"))


_FOLD_SQL = f"""
s AS ({an.SQL_SCORED}),
f AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{SEED}')) - 1) % {K} AS INT) AS fold
      FROM s)"""


def _folded(spark, sf_dir):
    return FO.stratified_folds(an.scored(spark, sf_dir), "doc_id", "label", K, SEED)


@register("stratified_folds", f"WITH {_FOLD_SQL} SELECT doc_id, label, fold FROM f")
def stratified_folds(spark, sf_dir):
    """W-01: hash-ordered stratified 5-fold assignment (seed 42)."""
    return _folded(spark, sf_dir).select("doc_id", "label", "fold")


_OOF_STACK = " UNION ALL ".join(
    f"SELECT fold, label, '{c}' AS col, coalesce(CAST({c} AS VARCHAR), '__MISSING__') AS category FROM f" for c in CATS)


@register("woe_oof", rounded_all(f"""WITH {_FOLD_SQL},
st AS ({_OOF_STACK}),
pf AS (SELECT col, category, fold, sum(label) AS ev, count(*) AS tot FROM st GROUP BY ALL),
al AS (SELECT col, category, sum(ev) AS ev_all, sum(tot) AS tot_all FROM pf GROUP BY ALL),
g AS (SELECT al.*, r.fold FROM al, range({K}) AS r(fold)),
o AS (SELECT g.fold, g.col, g.category, (ev_all - coalesce(ev, 0))::DOUBLE AS events, (tot_all - coalesce(tot, 0))::DOUBLE AS total
      FROM g LEFT JOIN pf USING (col, category, fold) WHERE tot_all - coalesce(tot, 0) > 0),
t AS (SELECT fold, col, sum(events) AS E, sum(total) AS T, count(*) AS k FROM o GROUP BY ALL),
m AS (SELECT o.fold, o.col, o.category,
        ln(((events + 0.5) / (E + 0.5 * k)) / ((total - events + 0.5) / (T - E + 0.5 * k))) AS woe
      FROM o JOIN t USING (fold, col))
SELECT f.doc_id, f.fold,
  coalesce(ml.woe, 0.0) AS lang_WOE, coalesce(ms.woe, 0.0) AS source_WOE
FROM f
LEFT JOIN m AS ml ON ml.fold = f.fold AND ml.col = 'lang' AND ml.category = coalesce(f.lang, '__MISSING__')
LEFT JOIN m AS ms ON ms.fold = f.fold AND ms.col = 'source' AND ms.category = coalesce(f.source, '__MISSING__')""",
    ["doc_id", "fold"]))
def woe_oof(spark, sf_dir):
    """E-05: fold-safe WoE - each labelled row encoded with the map fitted on the other folds."""
    f = _folded(spark, sf_dir)
    m = W.woe_fit_oof(f, "label", CATS, "fold", K)
    return finish(W.woe_transform_oof(f, m, CATS, "fold").select("doc_id", "fold", "lang_WOE", "source_WOE"))


@register("class_weights", rounded_all(f"""
WITH s AS ({an.SQL_SCORED}), c AS (SELECT label, count(*) AS n FROM s GROUP BY label)
SELECT label, n, (sum(n) OVER ())::DOUBLE / (2.0 * n) AS balanced_weight,
  CAST(trunc((sum(n) FILTER (WHERE label <> 1) OVER ())::DOUBLE / nullif(sum(n) FILTER (WHERE label = 1) OVER (), 0)) AS INT) AS scale_pos_weight
FROM c""", ["label", "n", "scale_pos_weight"]))
def class_weights(spark, sf_dir):
    """M-01: balanced class weights and the truncated negative/positive ratio."""
    return finish(FO.class_weights(an.scored(spark, sf_dir), "label"))


@register("fold_summary", rounded_all(f"""WITH {_FOLD_SQL},
h AS (SELECT fold, m_mix AS s, sum(label)::DOUBLE AS p, (count(*) - sum(label))::DOUBLE AS n FROM f GROUP BY fold, m_mix),
c AS (SELECT *, sum(p) OVER (PARTITION BY fold ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
        sum(p) OVER (PARTITION BY fold) AS tp_all, sum(n) OVER (PARTITION BY fold) AS tn_all FROM h),
a AS (SELECT fold, sum(n * (cp - p / 2)) / (max(tp_all) * max(tn_all)) AS auc_roc,
        CAST(max(tp_all) + max(tn_all) AS BIGINT) AS n_rows, CAST(max(tp_all) AS BIGINT) AS n_pos FROM c GROUP BY fold)
SELECT *, avg(auc_roc) OVER () AS auc_roc_mean, stddev_pop(auc_roc) OVER () AS auc_roc_std,
  auc_roc - avg(auc_roc) OVER () AS auc_roc_vs_mean
FROM a""", ["fold", "n_rows", "n_pos"]))
def fold_summary(spark, sf_dir):
    """A-77 / D-14: per-fold AUC of one score with mean and population std across folds."""
    f = _folded(spark, sf_dir)
    per = M.rank_metrics(f, "label", "m_mix", ["fold"]).select("fold", "auc_roc", "n_rows", "n_pos")
    return finish(FO.fold_stability(per, "auc_roc"))
