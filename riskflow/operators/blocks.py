"""History blocks: row preparation (P-30 .. P-38) and per-applicant aggregates.

Each block takes a DataFrame with the credit column names of its source
table and returns one row per key. Column lists are presets: callers with
other tables rename into these names (see ``riskflow.plans.analogues``).

Post-aggregate ratios are SQL expressions with the same null rules as
``riskflow.functions.nullsafe`` (``try_divide`` for the ``x + 1`` denominators,
``coalesce(x > 0, false)`` flags), applied in one projection.

Plan shape per block: narrow row projection -> partial aggregate ->
exchange on the key -> final aggregate. The two-level bureau block
aggregates the balance table on ``SK_ID_BUREAU`` *before* joining it to the
bureau table (J-01), so the join sees one row per bureau record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.functions import nullsafe as ns
from riskflow.operators.aggspec import AggSpec as S
from riskflow.operators.aggspec import aggregate_block

# Status decode of the monthly balance table (P-30).
STATUS_CODES = {"0": 0, "1": 1, "2": 2, "3": 3, "4": 4, "5": 5, "C": 0}
# "X" (unknown) and any other code decode to missing.

# Fixed value: day columns of previous applications that use the 365243 sentinel (P-31).
PREV_DAY_SENTINEL_COLUMNS = ["DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION",
                             "DAYS_LAST_DUE", "DAYS_TERMINATION"]
SENTINEL_DAYS = 365243


def decode_status(col: str = "STATUS"):
    """P-30: CASE over the fixed code table; unknown codes give NULL."""
    c = F.col(col)
    expr = None
    for code, val in STATUS_CODES.items():
        expr = (F.when(c == code, F.lit(val)) if expr is None else expr.when(c == code, F.lit(val)))
    return expr.otherwise(F.lit(None).cast("int"))


def nullify_sentinels(df: DataFrame, cols, sentinel=SENTINEL_DAYS) -> DataFrame:
    """P-31: sentinel -> NULL over those of ``cols`` that exist."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: ns.sentinel_to_null(c, sentinel) for c in present}) if present else df


# ------------------------------------------------------------------ A-10 / A-20

BUREAU_BALANCE_SPECS = [
    S("bb_months_count", "count", "MONTHS_BALANCE"),
    S("bb_status_mean", "mean", "STATUS_NUMERIC"),
    S("bb_status_max", "max", "STATUS_NUMERIC"),
    S("bb_status_sum", "sum", "STATUS_NUMERIC"),
    S("bb_dpd_over_1_count", "count_ge", "STATUS_NUMERIC", 1),
    S("bb_dpd_over_2_count", "count_ge", "STATUS_NUMERIC", 2),
]

BUREAU_SPECS = [
    S("bureau_total_loans", "count", "SK_ID_BUREAU"),
    S("bureau_active_loans", "count_eq", "CREDIT_ACTIVE", "Active"),
    S("bureau_closed_loans", "count_eq", "CREDIT_ACTIVE", "Closed"),
    S("bureau_credit_sum", "sum", "AMT_CREDIT_SUM"),
    S("bureau_credit_sum_mean", "mean", "AMT_CREDIT_SUM"),
    S("bureau_credit_sum_max", "max", "AMT_CREDIT_SUM"),
    S("bureau_debt_sum", "sum", "AMT_CREDIT_SUM_DEBT"),
    S("bureau_debt_mean", "mean", "AMT_CREDIT_SUM_DEBT"),
    S("bureau_overdue_sum", "sum", "AMT_CREDIT_SUM_OVERDUE"),
    S("bureau_overdue_mean", "mean", "AMT_CREDIT_SUM_OVERDUE"),
    S("bureau_overdue_max", "max", "AMT_CREDIT_SUM_OVERDUE"),
    S("bureau_credit_limit_mean", "mean", "AMT_CREDIT_SUM_LIMIT"),
    S("bureau_days_credit_mean", "mean", "DAYS_CREDIT"),
    S("bureau_days_credit_max", "max", "DAYS_CREDIT"),
    S("bureau_days_credit_min", "min", "DAYS_CREDIT"),
    S("bureau_days_credit_std", "std", "DAYS_CREDIT"),
    S("bureau_days_overdue_mean", "mean", "CREDIT_DAY_OVERDUE"),
    S("bureau_days_overdue_max", "max", "CREDIT_DAY_OVERDUE"),
    S("bureau_days_overdue_sum", "sum", "CREDIT_DAY_OVERDUE"),
    S("bureau_days_enddate_mean", "mean", "DAYS_CREDIT_ENDDATE"),
    S("bureau_prolong_sum", "sum", "CNT_CREDIT_PROLONG"),
    S("bureau_bb_months_mean", "mean", "bb_months_count"),
    S("bureau_bb_status_mean", "mean", "bb_status_mean"),
    S("bureau_bb_status_max", "max", "bb_status_max"),
    S("bureau_bb_dpd1_sum", "sum", "bb_dpd_over_1_count"),
    S("bureau_bb_dpd2_sum", "sum", "bb_dpd_over_2_count"),
]

BUREAU_POST = [
    ("bureau_active_ratio", "bureau_active_loans / (bureau_total_loans + 1)"),
    ("bureau_debt_credit_ratio", "try_divide(bureau_debt_sum, bureau_credit_sum + 1)"),
    ("bureau_overdue_credit_ratio", "try_divide(bureau_overdue_sum, bureau_credit_sum + 1)"),
    ("bureau_avg_loan_age", "abs(bureau_days_credit_mean)"),
]


def bureau_balance_block(bureau_balance: DataFrame, key: str = "SK_ID_BUREAU") -> DataFrame:
    """A-10: monthly status history per bureau record."""
    prepared = bureau_balance.select(key, "MONTHS_BALANCE", decode_status("STATUS").alias("STATUS_NUMERIC"))
    return aggregate_block(prepared, key, BUREAU_BALANCE_SPECS)


def bureau_block(bureau: DataFrame, bureau_balance: DataFrame,
                 key: str = "SK_ID_CURR", child_key: str = "SK_ID_BUREAU") -> DataFrame:
    """A-20 over J-01: two-level aggregate (balance -> bureau record -> applicant)."""
    bb = bureau_balance_block(bureau_balance, child_key)
    # J-01: left join of the pre-aggregated child; one row per bureau record on each side.
    full = bureau.join(bb, child_key, "left")
    return aggregate_block(full, key, BUREAU_SPECS, BUREAU_POST)


# ------------------------------------------------------------------ A-30

PREV_SPECS = [
    S("prev_total_applications", "count", "SK_ID_PREV"),
    S("prev_approved_count", "count_eq", "NAME_CONTRACT_STATUS", "Approved"),
    S("prev_refused_count", "count_eq", "NAME_CONTRACT_STATUS", "Refused"),
    S("prev_canceled_count", "count_eq", "NAME_CONTRACT_STATUS", "Canceled"),
    S("prev_unused_count", "count_eq", "NAME_CONTRACT_STATUS", "Unused offer"),
    S("prev_amt_credit_mean", "mean", "AMT_CREDIT"),
    S("prev_amt_credit_max", "max", "AMT_CREDIT"),
    S("prev_amt_credit_sum", "sum", "AMT_CREDIT"),
    S("prev_amt_annuity_mean", "mean", "AMT_ANNUITY"),
    S("prev_amt_annuity_max", "max", "AMT_ANNUITY"),
    S("prev_amt_application_mean", "mean", "AMT_APPLICATION"),
    S("prev_amt_goods_mean", "mean", "AMT_GOODS_PRICE"),
    S("prev_days_decision_mean", "mean", "DAYS_DECISION"),
    S("prev_days_decision_min", "min", "DAYS_DECISION"),
    S("prev_days_decision_max", "max", "DAYS_DECISION"),
    S("prev_hour_appr_max", "max", "HOUR_APPR_PROCESS_START"),
    S("prev_hour_appr_mean", "mean", "HOUR_APPR_PROCESS_START"),
    S("prev_down_payment_mean", "mean", "AMT_DOWN_PAYMENT"),
    S("prev_down_payment_sum", "sum", "AMT_DOWN_PAYMENT"),
    S("prev_rate_down_mean", "mean", "RATE_DOWN_PAYMENT"),
    S("prev_rate_interest_mean", "mean", "RATE_INTEREST_PRIMARY"),
    S("prev_rate_interest_max", "max", "RATE_INTEREST_PRIMARY"),
    S("prev_credit_app_ratio_mean", "mean", "PREV_CREDIT_APPLICATION_RATIO"),
    S("prev_credit_goods_ratio_mean", "mean", "PREV_CREDIT_GOODS_RATIO"),
    S("prev_sellerplace_area_mean", "mean", "SELLERPLACE_AREA"),
    S("prev_sellerplace_area_max", "max", "SELLERPLACE_AREA"),
    S("prev_cnt_payment_mean", "mean", "CNT_PAYMENT"),
    S("prev_cnt_payment_sum", "sum", "CNT_PAYMENT"),
]

PREV_POST = [
    ("prev_approval_rate", "prev_approved_count / (prev_total_applications + 1)"),
    ("prev_refusal_rate", "prev_refused_count / (prev_total_applications + 1)"),
    ("prev_annuity_credit_ratio", "try_divide(prev_amt_annuity_mean, prev_amt_credit_mean + 1)"),
]


def prepare_previous(prev: DataFrame) -> DataFrame:
    """P-31 + P-32."""
    prev = nullify_sentinels(prev, PREV_DAY_SENTINEL_COLUMNS)
    return prev.withColumns({
        "PREV_CREDIT_APPLICATION_RATIO": ns.ratio_plus1("AMT_CREDIT", "AMT_APPLICATION"),
        "PREV_CREDIT_GOODS_RATIO": ns.ratio_plus1("AMT_CREDIT", "AMT_GOODS_PRICE"),
    })


def previous_block(prev: DataFrame, key: str = "SK_ID_CURR") -> DataFrame:
    """A-30."""
    return aggregate_block(prepare_previous(prev), key, PREV_SPECS, PREV_POST)


# ------------------------------------------------------------------ A-40

POS_SPECS = [
    S("pos_total_records", "count", "SK_ID_PREV"),
    S("pos_months_balance_mean", "mean", "MONTHS_BALANCE"),
    S("pos_months_balance_min", "min", "MONTHS_BALANCE"),
    S("pos_cnt_instalment_mean", "mean", "CNT_INSTALMENT"),
    S("pos_cnt_instalment_future_mean", "mean", "CNT_INSTALMENT_FUTURE"),
    S("pos_sk_dpd_mean", "mean", "SK_DPD"),
    S("pos_sk_dpd_max", "max", "SK_DPD"),
    S("pos_sk_dpd_sum", "sum", "SK_DPD"),
    S("pos_sk_dpd_def_mean", "mean", "SK_DPD_DEF"),
    S("pos_sk_dpd_def_max", "max", "SK_DPD_DEF"),
    S("pos_sk_dpd_def_sum", "sum", "SK_DPD_DEF"),
    S("pos_completed_count", "count_eq", "NAME_CONTRACT_STATUS", "Completed"),
    S("pos_active_count", "count_eq", "NAME_CONTRACT_STATUS", "Active"),
]

POS_POST = [
    ("pos_dpd_ever_flag", "CAST(coalesce(pos_sk_dpd_max > 0, false) AS INT)"),
    ("pos_completion_rate", "pos_completed_count / (pos_total_records + 1)"),
    ("pos_future_instalment_ratio", "try_divide(pos_cnt_instalment_future_mean, pos_cnt_instalment_mean + 1)"),
]


def pos_block(pos: DataFrame, key: str = "SK_ID_CURR") -> DataFrame:
    """A-40."""
    return aggregate_block(pos, key, POS_SPECS, POS_POST)


# ------------------------------------------------------------------ A-50

CARD_SPECS = [
    S("cc_total_records", "count", "SK_ID_PREV"),
    S("cc_months_balance_mean", "mean", "MONTHS_BALANCE"),
    S("cc_months_balance_min", "min", "MONTHS_BALANCE"),
    S("cc_amt_balance_mean", "mean", "AMT_BALANCE"),
    S("cc_amt_balance_max", "max", "AMT_BALANCE"),
    S("cc_amt_credit_limit_mean", "mean", "AMT_CREDIT_LIMIT_ACTUAL"),
    S("cc_amt_credit_limit_max", "max", "AMT_CREDIT_LIMIT_ACTUAL"),
    S("cc_amt_drawings_total_mean", "mean", "AMT_DRAWINGS_CURRENT"),
    S("cc_amt_drawings_total_sum", "sum", "AMT_DRAWINGS_CURRENT"),
    S("cc_amt_payment_mean", "mean", "AMT_PAYMENT_TOTAL_CURRENT"),
    S("cc_amt_receivable_mean", "mean", "AMT_RECEIVABLE_PRINCIPAL"),
    S("cc_cnt_drawings_mean", "mean", "CNT_DRAWINGS_CURRENT"),
    S("cc_sk_dpd_mean", "mean", "SK_DPD"),
    S("cc_sk_dpd_max", "max", "SK_DPD"),
    S("cc_sk_dpd_def_mean", "mean", "SK_DPD_DEF"),
    S("cc_utilization_mean", "mean", "CC_UTILIZATION"),
    S("cc_utilization_max", "max", "CC_UTILIZATION"),
    S("cc_over_limit_sum", "sum", "CC_OVER_LIMIT"),
    S("cc_over_limit_mean", "mean", "CC_OVER_LIMIT"),
    S("cc_payment_ratio_mean", "mean", "CC_PAYMENT_RATIO"),
    S("cc_payment_ratio_min", "min", "CC_PAYMENT_RATIO"),
]

CARD_POST = [
    ("cc_dpd_ever_flag", "CAST(coalesce(cc_sk_dpd_max > 0, false) AS INT)"),
    ("cc_balance_limit_ratio", "try_divide(cc_amt_balance_mean, cc_amt_credit_limit_mean + 1)"),
]


def prepare_card(cc: DataFrame) -> DataFrame:
    """P-33 .. P-35."""
    return cc.withColumns({
        "CC_UTILIZATION": ns.clip(ns.ratio_plus1("AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL"), 0, 5),
        "CC_OVER_LIMIT": ns.flag(F.col("AMT_BALANCE") > F.col("AMT_CREDIT_LIMIT_ACTUAL")),
        "CC_PAYMENT_RATIO": ns.clip(ns.ratio_plus1("AMT_PAYMENT_TOTAL_CURRENT", "AMT_INST_MIN_REGULARITY"), 0, 20),
    })


def card_block(cc: DataFrame, key: str = "SK_ID_CURR") -> DataFrame:
    """A-50."""
    return aggregate_block(prepare_card(cc), key, CARD_SPECS, CARD_POST)


# ------------------------------------------------------------------ A-60

INST_SPECS = [
    S("inst_total_payments", "count", "SK_ID_PREV"),
    S("inst_payment_ratio_mean", "mean", "PAYMENT_RATIO"),
    S("inst_payment_ratio_min", "min", "PAYMENT_RATIO"),
    S("inst_payment_ratio_std", "std", "PAYMENT_RATIO"),
    S("inst_payment_diff_mean", "mean", "PAYMENT_DIFF"),
    S("inst_payment_diff_min", "min", "PAYMENT_DIFF"),
    S("inst_payment_diff_sum", "sum", "PAYMENT_DIFF"),
    S("inst_days_late_mean", "mean", "DAYS_LATE"),
    S("inst_days_late_max", "max", "DAYS_LATE"),
    S("inst_days_late_sum", "sum", "DAYS_LATE"),
    S("inst_days_early_mean", "mean", "DAYS_EARLY"),
    S("inst_days_early_max", "max", "DAYS_EARLY"),
    S("inst_late_flag_mean", "mean", "LATE_FLAG"),
    S("inst_late_flag_sum", "sum", "LATE_FLAG"),
    S("inst_underpaid_mean", "mean", "UNDERPAID_FLAG"),
    S("inst_underpaid_sum", "sum", "UNDERPAID_FLAG"),
    S("inst_overpaid_mean", "mean", "OVERPAID_FLAG"),
    S("inst_num_unique_loans", "nunique", "SK_ID_PREV"),
    S("inst_amt_payment_mean", "mean", "AMT_PAYMENT"),
    S("inst_amt_payment_sum", "sum", "AMT_PAYMENT"),
    S("inst_amt_instalment_mean", "mean", "AMT_INSTALMENT"),
]

INST_POST = [
    ("inst_ever_late", "CAST(coalesce(inst_days_late_max > 0, false) AS INT)"),
    ("inst_total_paid", "inst_amt_payment_sum"),
    ("inst_late_rate", "inst_late_flag_sum / (inst_total_payments + 1)"),
]


def prepare_instalments(inst: DataFrame) -> DataFrame:
    """P-36 .. P-38."""
    diff = F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")
    return inst.withColumns({
        "PAYMENT_DIFF": F.col("AMT_PAYMENT") - F.col("AMT_INSTALMENT"),
        "PAYMENT_RATIO": ns.clip(ns.ratio("AMT_PAYMENT", F.col("AMT_INSTALMENT") + F.lit(1e-6)), 0, 5),
        "DAYS_LATE": ns.clip(diff, 0),
        "DAYS_EARLY": ns.clip(-diff, 0),
    }).withColumns({
        "LATE_FLAG": ns.flag(F.col("DAYS_LATE") > 0),
        "UNDERPAID_FLAG": ns.flag(F.col("PAYMENT_DIFF") < 0),
        "OVERPAID_FLAG": ns.flag(F.col("PAYMENT_DIFF") > 0),
    })


def instalment_block(inst: DataFrame, key: str = "SK_ID_CURR") -> DataFrame:
    """A-60."""
    return aggregate_block(prepare_instalments(inst), key, INST_SPECS, INST_POST)
