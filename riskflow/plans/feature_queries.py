"""Feature-block query keys over the test tables (A-10 .. A-60, J-01, J-02)."""

from __future__ import annotations

from riskflow.operators import blocks
from riskflow.plans import analogues as an
from riskflow.plans.registry import finish, register, rounded_all

_STATUS_SQL = ("CASE STATUS WHEN '0' THEN 0 WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3 "
               "WHEN '4' THEN 4 WHEN '5' THEN 5 WHEN 'C' THEN 0 END")

_BUREAU_AGG_SQL = f"""
bb_agg AS (
  SELECT SK_ID_BUREAU,
         count(MONTHS_BALANCE) AS bb_months_count,
         avg(s) AS bb_status_mean,
         max(s) AS bb_status_max,
         CAST(coalesce(sum(s), 0) AS BIGINT) AS bb_status_sum,
         count(*) FILTER (WHERE s >= 1) AS bb_dpd_over_1_count,
         count(*) FILTER (WHERE s >= 2) AS bb_dpd_over_2_count
  FROM (SELECT SK_ID_BUREAU, MONTHS_BALANCE, {_STATUS_SQL} AS s FROM bb) AS t
  GROUP BY SK_ID_BUREAU),
bf AS (SELECT * FROM b LEFT JOIN bb_agg USING (SK_ID_BUREAU)),
ba AS (
  SELECT SK_ID_CURR,
    count(SK_ID_BUREAU) AS bureau_total_loans,
    count(*) FILTER (WHERE CREDIT_ACTIVE = 'Active') AS bureau_active_loans,
    count(*) FILTER (WHERE CREDIT_ACTIVE = 'Closed') AS bureau_closed_loans,
    coalesce(sum(AMT_CREDIT_SUM), 0) AS bureau_credit_sum,
    avg(AMT_CREDIT_SUM) AS bureau_credit_sum_mean,
    max(AMT_CREDIT_SUM) AS bureau_credit_sum_max,
    coalesce(sum(AMT_CREDIT_SUM_DEBT), 0) AS bureau_debt_sum,
    avg(AMT_CREDIT_SUM_DEBT) AS bureau_debt_mean,
    coalesce(sum(AMT_CREDIT_SUM_OVERDUE), 0) AS bureau_overdue_sum,
    avg(AMT_CREDIT_SUM_OVERDUE) AS bureau_overdue_mean,
    max(AMT_CREDIT_SUM_OVERDUE) AS bureau_overdue_max,
    avg(AMT_CREDIT_SUM_LIMIT) AS bureau_credit_limit_mean,
    avg(DAYS_CREDIT) AS bureau_days_credit_mean,
    max(DAYS_CREDIT) AS bureau_days_credit_max,
    min(DAYS_CREDIT) AS bureau_days_credit_min,
    stddev_samp(DAYS_CREDIT) AS bureau_days_credit_std,
    avg(CREDIT_DAY_OVERDUE) AS bureau_days_overdue_mean,
    max(CREDIT_DAY_OVERDUE) AS bureau_days_overdue_max,
    CAST(coalesce(sum(CREDIT_DAY_OVERDUE), 0) AS BIGINT) AS bureau_days_overdue_sum,
    avg(DAYS_CREDIT_ENDDATE) AS bureau_days_enddate_mean,
    CAST(coalesce(sum(CNT_CREDIT_PROLONG), 0) AS BIGINT) AS bureau_prolong_sum,
    avg(bb_months_count) AS bureau_bb_months_mean,
    avg(bb_status_mean) AS bureau_bb_status_mean,
    max(bb_status_max) AS bureau_bb_status_max,
    CAST(coalesce(sum(bb_dpd_over_1_count), 0) AS BIGINT) AS bureau_bb_dpd1_sum,
    CAST(coalesce(sum(bb_dpd_over_2_count), 0) AS BIGINT) AS bureau_bb_dpd2_sum
  FROM bf GROUP BY SK_ID_CURR),
bureau_feats AS (
  SELECT *,
    bureau_active_loans / (bureau_total_loans + 1) AS bureau_active_ratio,
    bureau_debt_sum / nullif(bureau_credit_sum + 1, 0) AS bureau_debt_credit_ratio,
    bureau_overdue_sum / nullif(bureau_credit_sum + 1, 0) AS bureau_overdue_credit_ratio,
    abs(bureau_days_credit_mean) AS bureau_avg_loan_age
  FROM ba)"""


# ---------------------------------------------------------------- flagship

def two_level_credit(spark, sf_dir):
    """A-10 -> J-01 -> A-20 -> J-02: per-applicant bureau features (flagship)."""
    app = an.application(spark, sf_dir).select("SK_ID_CURR")
    feats = blocks.bureau_block(an.bureau(spark, sf_dir), an.bureau_balance(spark, sf_dir))
    return finish(app.join(feats, "SK_ID_CURR", "left"))


register("feat_two_level_credit", rounded_all(f"""
WITH app AS ({an.SQL_APPLICATION}), b AS ({an.SQL_BUREAU}), bb AS ({an.SQL_BUREAU_BALANCE}),
{_BUREAU_AGG_SQL}
SELECT app.SK_ID_CURR, bureau_feats.* EXCLUDE (SK_ID_CURR)
FROM app LEFT JOIN bureau_feats USING (SK_ID_CURR)""", ["SK_ID_CURR"]))(two_level_credit)


# ---------------------------------------------------------------- A-30

_PREV_SQL = """
p AS (
  SELECT * REPLACE (
      CASE WHEN DAYS_FIRST_DUE = 365243 THEN NULL ELSE DAYS_FIRST_DUE END AS DAYS_FIRST_DUE,
      CASE WHEN DAYS_TERMINATION = 365243 THEN NULL ELSE DAYS_TERMINATION END AS DAYS_TERMINATION),
    AMT_CREDIT / nullif(AMT_APPLICATION + 1, 0) AS PREV_CREDIT_APPLICATION_RATIO,
    AMT_CREDIT / nullif(AMT_GOODS_PRICE + 1, 0) AS PREV_CREDIT_GOODS_RATIO
  FROM prev0),
pa AS (
  SELECT SK_ID_CURR,
    count(SK_ID_PREV) AS prev_total_applications,
    count(*) FILTER (WHERE NAME_CONTRACT_STATUS = 'Approved') AS prev_approved_count,
    count(*) FILTER (WHERE NAME_CONTRACT_STATUS = 'Refused') AS prev_refused_count,
    count(*) FILTER (WHERE NAME_CONTRACT_STATUS = 'Canceled') AS prev_canceled_count,
    count(*) FILTER (WHERE NAME_CONTRACT_STATUS = 'Unused offer') AS prev_unused_count,
    avg(AMT_CREDIT) AS prev_amt_credit_mean,
    max(AMT_CREDIT) AS prev_amt_credit_max,
    coalesce(sum(AMT_CREDIT), 0) AS prev_amt_credit_sum,
    avg(AMT_ANNUITY) AS prev_amt_annuity_mean,
    max(AMT_ANNUITY) AS prev_amt_annuity_max,
    avg(AMT_APPLICATION) AS prev_amt_application_mean,
    avg(AMT_GOODS_PRICE) AS prev_amt_goods_mean,
    avg(DAYS_DECISION) AS prev_days_decision_mean,
    min(DAYS_DECISION) AS prev_days_decision_min,
    max(DAYS_DECISION) AS prev_days_decision_max,
    max(HOUR_APPR_PROCESS_START) AS prev_hour_appr_max,
    avg(HOUR_APPR_PROCESS_START) AS prev_hour_appr_mean,
    avg(AMT_DOWN_PAYMENT) AS prev_down_payment_mean,
    coalesce(sum(AMT_DOWN_PAYMENT), 0) AS prev_down_payment_sum,
    avg(RATE_DOWN_PAYMENT) AS prev_rate_down_mean,
    avg(RATE_INTEREST_PRIMARY) AS prev_rate_interest_mean,
    max(RATE_INTEREST_PRIMARY) AS prev_rate_interest_max,
    avg(PREV_CREDIT_APPLICATION_RATIO) AS prev_credit_app_ratio_mean,
    avg(PREV_CREDIT_GOODS_RATIO) AS prev_credit_goods_ratio_mean,
    avg(SELLERPLACE_AREA) AS prev_sellerplace_area_mean,
    max(SELLERPLACE_AREA) AS prev_sellerplace_area_max,
    avg(CNT_PAYMENT) AS prev_cnt_payment_mean,
    coalesce(sum(CNT_PAYMENT), 0) AS prev_cnt_payment_sum
  FROM p GROUP BY SK_ID_CURR),
prev_feats AS (
  SELECT *,
    prev_approved_count / (prev_total_applications + 1) AS prev_approval_rate,
    prev_refused_count / (prev_total_applications + 1) AS prev_refusal_rate,
    prev_amt_annuity_mean / nullif(prev_amt_credit_mean + 1, 0) AS prev_annuity_credit_ratio
  FROM pa)"""


@register("feat_prev_block", rounded_all(
    f"WITH prev0 AS ({an.SQL_PREVIOUS}), {_PREV_SQL} SELECT * FROM prev_feats", ["SK_ID_CURR"]))
def prev_block(spark, sf_dir):
    """A-30 with P-31 sentinels and P-32 ratios."""
    return finish(blocks.previous_block(an.previous(spark, sf_dir)))


# ---------------------------------------------------------------- A-40

_POS_SQL = """
pa AS (
  SELECT SK_ID_CURR,
    count(SK_ID_PREV) AS pos_total_records,
    avg(MONTHS_BALANCE) AS pos_months_balance_mean,
    min(MONTHS_BALANCE) AS pos_months_balance_min,
    avg(CNT_INSTALMENT) AS pos_cnt_instalment_mean,
    avg(CNT_INSTALMENT_FUTURE) AS pos_cnt_instalment_future_mean,
    avg(SK_DPD) AS pos_sk_dpd_mean,
    max(SK_DPD) AS pos_sk_dpd_max,
    CAST(coalesce(sum(SK_DPD), 0) AS BIGINT) AS pos_sk_dpd_sum,
    avg(SK_DPD_DEF) AS pos_sk_dpd_def_mean,
    max(SK_DPD_DEF) AS pos_sk_dpd_def_max,
    CAST(coalesce(sum(SK_DPD_DEF), 0) AS BIGINT) AS pos_sk_dpd_def_sum,
    count(*) FILTER (WHERE NAME_CONTRACT_STATUS = 'Completed') AS pos_completed_count,
    count(*) FILTER (WHERE NAME_CONTRACT_STATUS = 'Active') AS pos_active_count
  FROM pos0 GROUP BY SK_ID_CURR),
pos_feats AS (
  SELECT *,
    CAST(coalesce(pos_sk_dpd_max > 0, false) AS INT) AS pos_dpd_ever_flag,
    pos_completed_count / (pos_total_records + 1) AS pos_completion_rate,
    pos_cnt_instalment_future_mean / nullif(pos_cnt_instalment_mean + 1, 0) AS pos_future_instalment_ratio
  FROM pa)"""


@register("feat_pos_block", rounded_all(
    f"WITH pos0 AS ({an.SQL_POS}), {_POS_SQL} SELECT * FROM pos_feats", ["SK_ID_CURR"]))
def pos_block(spark, sf_dir):
    """A-40."""
    return finish(blocks.pos_block(an.pos(spark, sf_dir)))


# ---------------------------------------------------------------- A-50

_CARD_SQL = """
c AS (
  SELECT *,
    CASE WHEN AMT_BALANCE / nullif(AMT_CREDIT_LIMIT_ACTUAL + 1, 0) IS NULL THEN NULL
         ELSE least(greatest(AMT_BALANCE / nullif(AMT_CREDIT_LIMIT_ACTUAL + 1, 0), 0), 5) END AS CC_UTILIZATION,
    CAST(coalesce(AMT_BALANCE > AMT_CREDIT_LIMIT_ACTUAL, false) AS INT) AS CC_OVER_LIMIT,
    CASE WHEN AMT_PAYMENT_TOTAL_CURRENT / nullif(AMT_INST_MIN_REGULARITY + 1, 0) IS NULL THEN NULL
         ELSE least(greatest(AMT_PAYMENT_TOTAL_CURRENT / nullif(AMT_INST_MIN_REGULARITY + 1, 0), 0), 20) END AS CC_PAYMENT_RATIO
  FROM card0),
ca AS (
  SELECT SK_ID_CURR,
    count(SK_ID_PREV) AS cc_total_records,
    avg(MONTHS_BALANCE) AS cc_months_balance_mean,
    min(MONTHS_BALANCE) AS cc_months_balance_min,
    avg(AMT_BALANCE) AS cc_amt_balance_mean,
    max(AMT_BALANCE) AS cc_amt_balance_max,
    avg(AMT_CREDIT_LIMIT_ACTUAL) AS cc_amt_credit_limit_mean,
    max(AMT_CREDIT_LIMIT_ACTUAL) AS cc_amt_credit_limit_max,
    avg(AMT_DRAWINGS_CURRENT) AS cc_amt_drawings_total_mean,
    coalesce(sum(AMT_DRAWINGS_CURRENT), 0) AS cc_amt_drawings_total_sum,
    avg(AMT_PAYMENT_TOTAL_CURRENT) AS cc_amt_payment_mean,
    avg(AMT_RECEIVABLE_PRINCIPAL) AS cc_amt_receivable_mean,
    avg(CNT_DRAWINGS_CURRENT) AS cc_cnt_drawings_mean,
    avg(SK_DPD) AS cc_sk_dpd_mean,
    max(SK_DPD) AS cc_sk_dpd_max,
    avg(SK_DPD_DEF) AS cc_sk_dpd_def_mean,
    avg(CC_UTILIZATION) AS cc_utilization_mean,
    max(CC_UTILIZATION) AS cc_utilization_max,
    CAST(coalesce(sum(CC_OVER_LIMIT), 0) AS BIGINT) AS cc_over_limit_sum,
    avg(CC_OVER_LIMIT) AS cc_over_limit_mean,
    avg(CC_PAYMENT_RATIO) AS cc_payment_ratio_mean,
    min(CC_PAYMENT_RATIO) AS cc_payment_ratio_min
  FROM c GROUP BY SK_ID_CURR),
card_feats AS (
  SELECT *,
    CAST(coalesce(cc_sk_dpd_max > 0, false) AS INT) AS cc_dpd_ever_flag,
    cc_amt_balance_mean / nullif(cc_amt_credit_limit_mean + 1, 0) AS cc_balance_limit_ratio
  FROM ca)"""


@register("feat_card_block", rounded_all(
    f"WITH card0 AS ({an.SQL_CARD}), {_CARD_SQL} SELECT * FROM card_feats", ["SK_ID_CURR"]))
def card_block(spark, sf_dir):
    """A-50 with P-33..P-35 (clips propagate missing, zero denominators give missing)."""
    return finish(blocks.card_block(an.card(spark, sf_dir)))


# ---------------------------------------------------------------- A-60

_INST_SQL = """
i1 AS (
  SELECT *,
    AMT_PAYMENT - AMT_INSTALMENT AS PAYMENT_DIFF,
    CASE WHEN AMT_PAYMENT / nullif(AMT_INSTALMENT + 1e-6, 0) IS NULL THEN NULL
         ELSE least(greatest(AMT_PAYMENT / nullif(AMT_INSTALMENT + 1e-6, 0), 0), 5) END AS PAYMENT_RATIO,
    CASE WHEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT IS NULL THEN NULL
         ELSE greatest(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT, 0) END AS DAYS_LATE,
    CASE WHEN DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT IS NULL THEN NULL
         ELSE greatest(DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT, 0) END AS DAYS_EARLY
  FROM inst0),
i2 AS (
  SELECT *,
    CAST(coalesce(DAYS_LATE > 0, false) AS INT) AS LATE_FLAG,
    CAST(coalesce(PAYMENT_DIFF < 0, false) AS INT) AS UNDERPAID_FLAG,
    CAST(coalesce(PAYMENT_DIFF > 0, false) AS INT) AS OVERPAID_FLAG
  FROM i1),
ia AS (
  SELECT SK_ID_CURR,
    count(SK_ID_PREV) AS inst_total_payments,
    avg(PAYMENT_RATIO) AS inst_payment_ratio_mean,
    min(PAYMENT_RATIO) AS inst_payment_ratio_min,
    stddev_samp(PAYMENT_RATIO) AS inst_payment_ratio_std,
    avg(PAYMENT_DIFF) AS inst_payment_diff_mean,
    min(PAYMENT_DIFF) AS inst_payment_diff_min,
    coalesce(sum(PAYMENT_DIFF), 0) AS inst_payment_diff_sum,
    avg(DAYS_LATE) AS inst_days_late_mean,
    max(DAYS_LATE) AS inst_days_late_max,
    coalesce(sum(DAYS_LATE), 0) AS inst_days_late_sum,
    avg(DAYS_EARLY) AS inst_days_early_mean,
    max(DAYS_EARLY) AS inst_days_early_max,
    avg(LATE_FLAG) AS inst_late_flag_mean,
    CAST(coalesce(sum(LATE_FLAG), 0) AS BIGINT) AS inst_late_flag_sum,
    avg(UNDERPAID_FLAG) AS inst_underpaid_mean,
    CAST(coalesce(sum(UNDERPAID_FLAG), 0) AS BIGINT) AS inst_underpaid_sum,
    avg(OVERPAID_FLAG) AS inst_overpaid_mean,
    count(DISTINCT SK_ID_PREV) AS inst_num_unique_loans,
    avg(AMT_PAYMENT) AS inst_amt_payment_mean,
    coalesce(sum(AMT_PAYMENT), 0) AS inst_amt_payment_sum,
    avg(AMT_INSTALMENT) AS inst_amt_instalment_mean
  FROM i2 GROUP BY SK_ID_CURR),
inst_feats AS (
  SELECT *,
    CAST(coalesce(inst_days_late_max > 0, false) AS INT) AS inst_ever_late,
    inst_amt_payment_sum AS inst_total_paid,
    inst_late_flag_sum / (inst_total_payments + 1) AS inst_late_rate
  FROM ia)"""


@register("feat_instalment_block", rounded_all(
    f"WITH inst0 AS ({an.SQL_INSTALMENTS}), {_INST_SQL} SELECT * FROM inst_feats", ["SK_ID_CURR"]))
def instalment_block(spark, sf_dir):
    """A-60 with P-36..P-38 over lineitem ⋈ orders."""
    return finish(blocks.instalment_block(an.instalments(spark, sf_dir)))


# ---------------------------------------------------------------- J-02 star join

def star_features(spark, sf_dir):
    """J-02: application features + five history blocks, all left-joined on the applicant key.

    Each block has one row per key, so every join is 1:1 on ``SK_ID_CURR``;
    AQE turns sides whose measured size is small into broadcasts at run time
    and keeps sort-merge joins (co-partitioned on the same key) otherwise.
    """
    from riskflow.operators.features import application_features
    from riskflow.operators.joins import star_join
    app = application_features(an.application(spark, sf_dir))
    parts = [
        blocks.bureau_block(an.bureau(spark, sf_dir), an.bureau_balance(spark, sf_dir)),
        blocks.previous_block(an.previous(spark, sf_dir)),
        blocks.pos_block(an.pos(spark, sf_dir)),
        blocks.card_block(an.card(spark, sf_dir)),
        blocks.instalment_block(an.instalments(spark, sf_dir)),
    ]
    return star_join(app, parts, "SK_ID_CURR")


_STAR_COLS = ["SK_ID_CURR", "AGE_YEARS", "CREDIT_TO_INCOME", "EXT_SOURCE_MEAN", "TOTAL_DOCS_SUBMITTED",
              "bureau_total_loans", "bureau_debt_credit_ratio", "bureau_bb_dpd1_sum",
              "prev_total_applications", "prev_approval_rate",
              "cc_total_records", "cc_utilization_mean", "cc_dpd_ever_flag",
              "inst_total_payments", "inst_late_rate", "inst_num_unique_loans"]


@register("feat_star_join", rounded_all(f"""
WITH app AS ({an.SQL_APPLICATION}), b AS ({an.SQL_BUREAU}), bb AS ({an.SQL_BUREAU_BALANCE}),
prev0 AS ({an.SQL_PREVIOUS}), card0 AS ({an.SQL_CARD}), inst0 AS ({an.SQL_INSTALMENTS}),
{_BUREAU_AGG_SQL}, {_PREV_SQL}, {_CARD_SQL}, {_INST_SQL}
SELECT app.SK_ID_CURR,
  -DAYS_BIRTH / 365.25 AS AGE_YEARS,
  AMT_CREDIT / nullif(AMT_INCOME_TOTAL + 1, 0) AS CREDIT_TO_INCOME,
  (coalesce(EXT_SOURCE_1, 0) + coalesce(EXT_SOURCE_2, 0) + coalesce(EXT_SOURCE_3, 0))
    / nullif((EXT_SOURCE_1 IS NOT NULL)::INT + (EXT_SOURCE_2 IS NOT NULL)::INT + (EXT_SOURCE_3 IS NOT NULL)::INT, 0) AS EXT_SOURCE_MEAN,
  coalesce(FLAG_DOCUMENT_2, 0) + coalesce(FLAG_DOCUMENT_3, 0) + coalesce(FLAG_DOCUMENT_4, 0) + coalesce(FLAG_DOCUMENT_5, 0) AS TOTAL_DOCS_SUBMITTED,
  bureau_total_loans, bureau_debt_credit_ratio, bureau_bb_dpd1_sum,
  prev_total_applications, prev_approval_rate,
  cc_total_records, cc_utilization_mean, cc_dpd_ever_flag,
  inst_total_payments, inst_late_rate, inst_num_unique_loans
FROM app
LEFT JOIN bureau_feats USING (SK_ID_CURR)
LEFT JOIN prev_feats USING (SK_ID_CURR)
LEFT JOIN card_feats USING (SK_ID_CURR)
LEFT JOIN inst_feats USING (SK_ID_CURR)""", ["SK_ID_CURR"]))
def star_join_query(spark, sf_dir):
    """J-02 + N12: no fill after the left joins (applicants without history keep NULL counts)."""
    return finish(star_features(spark, sf_dir).select(*_STAR_COLS))
