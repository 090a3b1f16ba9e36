"""Row-level feature query keys (P-01 .. P-43): narrow projections, no shuffle
(except ``feat_falsy_default``, which left-joins one block for P-42)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow.functions import nullsafe as ns
from riskflow.operators import blocks, features
from riskflow.plans import analogues as an
from riskflow.plans.registry import finish, register, rounded_all

_APP = f"WITH app0 AS ({an.SQL_APPLICATION}), app AS (SELECT * REPLACE (CASE WHEN DAYS_EMPLOYED = 365243 THEN NULL ELSE DAYS_EMPLOYED END AS DAYS_EMPLOYED), CAST(coalesce(app0.DAYS_EMPLOYED = 365243, false) AS INT) AS FLAG_DAYS_EMPLOYED_ANOM FROM app0)"


@register("feat_sentinel", f"{_APP} SELECT SK_ID_CURR, DAYS_EMPLOYED, FLAG_DAYS_EMPLOYED_ANOM FROM app")
def sentinel(spark, sf_dir):
    """P-01, P-02: sentinel flag then sentinel -> NULL."""
    app = features.sentinel_features(an.application(spark, sf_dir))
    return app.select("SK_ID_CURR", "DAYS_EMPLOYED", "FLAG_DAYS_EMPLOYED_ANOM")


@register("feat_prev_sentinel", rounded_all(f"""
WITH p AS ({an.SQL_PREVIOUS})
SELECT SK_ID_PREV,
  CASE WHEN DAYS_FIRST_DUE = 365243 THEN NULL ELSE DAYS_FIRST_DUE END AS DAYS_FIRST_DUE,
  CASE WHEN DAYS_TERMINATION = 365243 THEN NULL ELSE DAYS_TERMINATION END AS DAYS_TERMINATION,
  AMT_CREDIT / nullif(AMT_APPLICATION + 1, 0) AS PREV_CREDIT_APPLICATION_RATIO,
  AMT_CREDIT / nullif(AMT_GOODS_PRICE + 1, 0) AS PREV_CREDIT_GOODS_RATIO
FROM p""", ["SK_ID_PREV"]))
def prev_sentinel(spark, sf_dir):
    """P-31 over a column list (absent columns skipped) and P-32 ratios."""
    p = blocks.prepare_previous(an.previous(spark, sf_dir))
    return finish(p.select("SK_ID_PREV", "DAYS_FIRST_DUE", "DAYS_TERMINATION",
                           "PREV_CREDIT_APPLICATION_RATIO", "PREV_CREDIT_GOODS_RATIO"))


_RATIO_COLS = ["AGE_YEARS", "EMPLOYED_YEARS", "REGISTRATION_YEARS", "ID_PUBLISH_YEARS", "CREDIT_TO_INCOME",
               "ANNUITY_TO_INCOME", "CREDIT_TO_GOODS", "ANNUITY_TO_CREDIT", "INCOME_PER_PERSON", "INCOME_PER_CHILD",
               "EMPLOYED_TO_AGE", "EMPLOYED_MINUS_AGE", "GOODS_CREDIT_DIFF"]


@register("feat_row_ratios", rounded_all(f"""{_APP}
SELECT SK_ID_CURR,
  -DAYS_BIRTH / 365.25 AS AGE_YEARS,
  -DAYS_EMPLOYED / 365.25 AS EMPLOYED_YEARS,
  -DAYS_REGISTRATION / 365.25 AS REGISTRATION_YEARS,
  -DAYS_ID_PUBLISH / 365.25 AS ID_PUBLISH_YEARS,
  AMT_CREDIT / nullif(AMT_INCOME_TOTAL + 1, 0) AS CREDIT_TO_INCOME,
  AMT_ANNUITY / nullif(AMT_INCOME_TOTAL + 1, 0) AS ANNUITY_TO_INCOME,
  AMT_CREDIT / nullif(AMT_GOODS_PRICE + 1, 0) AS CREDIT_TO_GOODS,
  AMT_ANNUITY / nullif(AMT_CREDIT + 1, 0) AS ANNUITY_TO_CREDIT,
  AMT_INCOME_TOTAL / nullif(CNT_FAM_MEMBERS + 1, 0) AS INCOME_PER_PERSON,
  AMT_INCOME_TOTAL / nullif(CNT_CHILDREN + 1, 0) AS INCOME_PER_CHILD,
  (-DAYS_EMPLOYED / 365.25) / nullif(-DAYS_BIRTH / 365.25 + 1, 0) AS EMPLOYED_TO_AGE,
  DAYS_EMPLOYED - DAYS_BIRTH AS EMPLOYED_MINUS_AGE,
  AMT_GOODS_PRICE - AMT_CREDIT AS GOODS_CREDIT_DIFF
FROM app""", ["SK_ID_CURR"]))
def row_ratios(spark, sf_dir):
    """P-03 .. P-14, P-27."""
    app = features.ratio_features(features.sentinel_features(an.application(spark, sf_dir)))
    return finish(app.select("SK_ID_CURR", *_RATIO_COLS))


_E = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
_N = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in _E)
_S = " + ".join(f"coalesce({c}, 0)" for c in _E)
_MEAN = f"CASE WHEN ({_N}) > 0 THEN (0.0 + {_S}) / ({_N}) END"
_SS = " + ".join(f"coalesce(({c} - m) * ({c} - m), 0)" for c in _E)


@register("feat_row_stats", rounded_all(f"""
WITH a0 AS ({an.SQL_APPLICATION}),
a AS (SELECT *, {_MEAN} AS m, {_N} AS n FROM a0)
SELECT SK_ID_CURR,
  m AS EXT_SOURCE_MEAN,
  CASE WHEN n >= 2 THEN sqrt((0.0 + {_SS}) / (n - 1)) END AS EXT_SOURCE_STD,
  coalesce(EXT_SOURCE_1, 0) * coalesce(EXT_SOURCE_2, 0) * coalesce(EXT_SOURCE_3, 0) AS EXT_SOURCE_PROD,
  greatest(EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3) AS EXT_SOURCE_MAX,
  least(EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3) AS EXT_SOURCE_MIN,
  EXT_SOURCE_1 * EXT_SOURCE_2 AS EXT_1_2,
  EXT_SOURCE_1 * EXT_SOURCE_3 AS EXT_1_3,
  EXT_SOURCE_2 * EXT_SOURCE_3 AS EXT_2_3
FROM a""", ["SK_ID_CURR"]))
def row_stats(spark, sf_dir):
    """P-15 .. P-22 (N7 skip-missing row statistics, N10 product)."""
    app = features.row_stat_features(an.application(spark, sf_dir))
    return finish(app.select("SK_ID_CURR", "EXT_SOURCE_MEAN", "EXT_SOURCE_STD", "EXT_SOURCE_PROD", "EXT_SOURCE_MAX",
                             "EXT_SOURCE_MIN", "EXT_1_2", "EXT_1_3", "EXT_2_3"))


def _sum0(cols):
    return " + ".join(f"coalesce({c}, 0)" for c in cols)


@register("feat_row_sums", rounded_all(f"""
WITH a AS ({an.SQL_APPLICATION})
SELECT SK_ID_CURR,
  {_sum0(['FLAG_DOCUMENT_2', 'FLAG_DOCUMENT_3', 'FLAG_DOCUMENT_4', 'FLAG_DOCUMENT_5'])} AS TOTAL_DOCS_SUBMITTED,
  DEF_30_CNT_SOCIAL_CIRCLE / nullif(OBS_30_CNT_SOCIAL_CIRCLE + 1, 0) AS SOCIAL_CIRCLE_DEFAULT_30_RATIO,
  DEF_60_CNT_SOCIAL_CIRCLE / nullif(OBS_60_CNT_SOCIAL_CIRCLE + 1, 0) AS SOCIAL_CIRCLE_DEFAULT_60_RATIO,
  {_sum0(features.ENQUIRY_COLUMNS)} AS TOTAL_BUREAU_ENQUIRIES,
  {_sum0(features.CONTACT_COLUMNS)} AS TOTAL_CONTACT_FLAGS
FROM a""", ["SK_ID_CURR"]))
def row_sums(spark, sf_dir):
    """P-23 .. P-26 (prefix-selected document flags, N8 row sums)."""
    app = features.row_sum_features(an.application(spark, sf_dir))
    return finish(app.select("SK_ID_CURR", "TOTAL_DOCS_SUBMITTED", "SOCIAL_CIRCLE_DEFAULT_30_RATIO",
                             "SOCIAL_CIRCLE_DEFAULT_60_RATIO", "TOTAL_BUREAU_ENQUIRIES", "TOTAL_CONTACT_FLAGS"))


@register("feat_card_rows", rounded_all(f"""
WITH c AS ({an.SQL_CARD})
SELECT SK_ID_PREV,
  CASE WHEN AMT_BALANCE / nullif(AMT_CREDIT_LIMIT_ACTUAL + 1, 0) IS NULL THEN NULL
       ELSE least(greatest(AMT_BALANCE / nullif(AMT_CREDIT_LIMIT_ACTUAL + 1, 0), 0), 5) END AS CC_UTILIZATION,
  CAST(coalesce(AMT_BALANCE > AMT_CREDIT_LIMIT_ACTUAL, false) AS INT) AS CC_OVER_LIMIT,
  CASE WHEN AMT_PAYMENT_TOTAL_CURRENT / nullif(AMT_INST_MIN_REGULARITY + 1, 0) IS NULL THEN NULL
       ELSE least(greatest(AMT_PAYMENT_TOTAL_CURRENT / nullif(AMT_INST_MIN_REGULARITY + 1, 0), 0), 20) END AS CC_PAYMENT_RATIO
FROM c""", ["SK_ID_PREV"]))
def card_rows(spark, sf_dir):
    """P-33 .. P-35: null-propagating clips and the over-limit flag."""
    c = blocks.prepare_card(an.card(spark, sf_dir))
    return finish(c.select("SK_ID_PREV", "CC_UTILIZATION", "CC_OVER_LIMIT", "CC_PAYMENT_RATIO"))


@register("feat_clip_flags", rounded_all(f"""
WITH i AS ({an.SQL_INSTALMENTS}),
j AS (SELECT *, AMT_PAYMENT - AMT_INSTALMENT AS PAYMENT_DIFF,
        CASE WHEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT IS NULL THEN NULL
             ELSE greatest(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT, 0) END AS DAYS_LATE FROM i)
SELECT SK_ID_PREV, SK_ID_CURR, AMT_PAYMENT, PAYMENT_DIFF,
  least(greatest(AMT_PAYMENT / nullif(AMT_INSTALMENT + 1e-6, 0), 0), 5) AS PAYMENT_RATIO,
  DAYS_LATE,
  CASE WHEN DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT IS NULL THEN NULL
       ELSE greatest(DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT, 0) END AS DAYS_EARLY,
  CAST(coalesce(DAYS_LATE > 0, false) AS INT) AS LATE_FLAG,
  CAST(coalesce(PAYMENT_DIFF < 0, false) AS INT) AS UNDERPAID_FLAG,
  CAST(coalesce(PAYMENT_DIFF > 0, false) AS INT) AS OVERPAID_FLAG
FROM j""", ["SK_ID_PREV", "SK_ID_CURR"]))
def clip_flags(spark, sf_dir):
    """P-36 .. P-38 row level (late days with missing entry date stay NULL, flag 0)."""
    i = blocks.prepare_instalments(an.instalments(spark, sf_dir))
    return finish(i.select("SK_ID_PREV", "SK_ID_CURR", "AMT_PAYMENT", "PAYMENT_DIFF", "PAYMENT_RATIO", "DAYS_LATE",
                           "DAYS_EARLY", "LATE_FLAG", "UNDERPAID_FLAG", "OVERPAID_FLAG"))


@register("feat_falsy_default", rounded_all(f"""
WITH a AS ({an.SQL_APPLICATION}), card0 AS ({an.SQL_CARD}),
cc AS (SELECT SK_ID_CURR, count(SK_ID_PREV) AS cc_total_records, avg(SK_DPD) AS cc_sk_dpd_mean
       FROM card0 GROUP BY SK_ID_CURR)
SELECT a.SK_ID_CURR,
  coalesce(nullif(AMT_GOODS_PRICE, 0), AMT_CREDIT) AS GOODS_PRICE_OR_CREDIT,
  coalesce(nullif(CNT_FAM_MEMBERS, 0), 2) AS CNT_FAM_OR_DEFAULT,
  coalesce(nullif(CNT_CHILDREN, 0), 0) AS CNT_CHILDREN_OR_DEFAULT,
  coalesce(EXT_SOURCE_1, -999) AS EXT_SOURCE_1_FILLED,
  coalesce(EXT_SOURCE_3, -999) AS EXT_SOURCE_3_FILLED,
  coalesce(cc_total_records, 0) AS cc_total_records,
  coalesce(cc_sk_dpd_mean, 0) AS cc_sk_dpd_mean
FROM a LEFT JOIN cc USING (SK_ID_CURR)""", ["SK_ID_CURR"]))
def falsy_default(spark, sf_dir):
    """P-40 constant fill, P-41 falsy defaults (value or column), P-42 cold-start defaults."""
    app = an.application(spark, sf_dir)
    out = app.select(
        "SK_ID_CURR",
        ns.falsy_default("AMT_GOODS_PRICE", F.col("AMT_CREDIT")).alias("GOODS_PRICE_OR_CREDIT"),
        ns.falsy_default("CNT_FAM_MEMBERS", 2.0).alias("CNT_FAM_OR_DEFAULT"),
        ns.falsy_default("CNT_CHILDREN", 0).alias("CNT_CHILDREN_OR_DEFAULT"),
        F.col("EXT_SOURCE_1").alias("EXT_SOURCE_1_FILLED"),
        F.col("EXT_SOURCE_3").alias("EXT_SOURCE_3_FILLED"),
    )
    out = features.constant_fill(out, -999.0, ["EXT_SOURCE_1_FILLED", "EXT_SOURCE_3_FILLED"])
    cc = (an.card(spark, sf_dir).groupBy("SK_ID_CURR")
          .agg(F.count("SK_ID_PREV").alias("cc_total_records"), F.avg("SK_DPD").alias("cc_sk_dpd_mean")))
    out = out.join(cc, "SK_ID_CURR", "left")
    out = features.cold_start_defaults(out, ["cc_total_records", "cc_sk_dpd_mean"])
    return finish(out)


@register("decode_status", """
SELECT SK_ID_BUREAU, STATUS,
  CASE STATUS WHEN '0' THEN 0 WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3 WHEN '4' THEN 4
              WHEN '5' THEN 5 WHEN 'C' THEN 0 END AS STATUS_NUMERIC,
  count(*) AS n
FROM (""" + an.SQL_BUREAU_BALANCE + """) AS bb
GROUP BY ALL""")
def decode_status(spark, sf_dir):
    """P-30: status decode map; X and unknown codes give NULL. Counted per (record, code)."""
    bb = an.bureau_balance(spark, sf_dir)
    return (bb.select("SK_ID_BUREAU", "STATUS", blocks.decode_status("STATUS").alias("STATUS_NUMERIC"))
            .groupBy("SK_ID_BUREAU", "STATUS", "STATUS_NUMERIC").agg(F.count(F.lit(1)).alias("n")))


@register("label_index", """
WITH f AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority),
r AS (SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY n DESC, o_orderpriority) - 1 AS DOUBLE) AS priority_index FROM f)
SELECT o_orderkey, o_orderpriority, priority_index FROM orders JOIN r USING (o_orderpriority)""")
def label_index(spark, sf_dir):
    """P-43: category codes fitted on the training table (frequency order, ties by value)."""
    from pyspark.ml.feature import StringIndexer
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority")
    model = StringIndexer(inputCol="o_orderpriority", outputCol="priority_index",
                          stringOrderType="frequencyDesc", handleInvalid="keep").fit(orders)
    return model.transform(orders)
