"""Application-level feature expressions (P-01 .. P-27) and column utilities (P-39 .. P-43).

All of these are narrow: one ``select`` over the input, no shuffle, pure
built-in expressions (whole-stage codegen). One expression library serves
training, batch scoring and streaming scoring (N18).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.functions import nullsafe as ns

# Fixed values from the reference feature definitions.
EMPLOYED_SENTINEL = 365243
DAYS_PER_YEAR = 365.25
EXT_SOURCES = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
ENQUIRY_COLUMNS = ["AMT_REQ_CREDIT_BUREAU_HOUR", "AMT_REQ_CREDIT_BUREAU_DAY", "AMT_REQ_CREDIT_BUREAU_WEEK",
                   "AMT_REQ_CREDIT_BUREAU_MON", "AMT_REQ_CREDIT_BUREAU_QRT", "AMT_REQ_CREDIT_BUREAU_YEAR"]
CONTACT_COLUMNS = ["FLAG_MOBIL", "FLAG_EMP_PHONE", "FLAG_WORK_PHONE", "FLAG_CONT_MOBILE", "FLAG_PHONE", "FLAG_EMAIL"]
DOCUMENT_PREFIX = "FLAG_DOCUMENT_"


def _years(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return -c / F.lit(DAYS_PER_YEAR)


def sentinel_features(df: DataFrame, col: str = "DAYS_EMPLOYED", sentinel=EMPLOYED_SENTINEL) -> DataFrame:
    """P-01, P-02: anomaly flag, then sentinel -> NULL."""
    return df.withColumns({
        f"FLAG_{col}_ANOM": ns.flag(F.col(col) == F.lit(sentinel)),
    }).withColumn(col, ns.sentinel_to_null(col, sentinel))


def ratio_features(df: DataFrame) -> DataFrame:
    """P-03 .. P-14, P-27 (expects P-02 applied)."""
    d = df.withColumns({
        "AGE_YEARS": _years("DAYS_BIRTH"),
        "EMPLOYED_YEARS": _years("DAYS_EMPLOYED"),
        "REGISTRATION_YEARS": _years("DAYS_REGISTRATION"),
        "ID_PUBLISH_YEARS": _years("DAYS_ID_PUBLISH"),
        "CREDIT_TO_INCOME": ns.ratio_plus1("AMT_CREDIT", "AMT_INCOME_TOTAL"),
        "ANNUITY_TO_INCOME": ns.ratio_plus1("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
        "CREDIT_TO_GOODS": ns.ratio_plus1("AMT_CREDIT", "AMT_GOODS_PRICE"),
        "ANNUITY_TO_CREDIT": ns.ratio_plus1("AMT_ANNUITY", "AMT_CREDIT"),
        "INCOME_PER_PERSON": ns.ratio_plus1("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
        "INCOME_PER_CHILD": ns.ratio_plus1("AMT_INCOME_TOTAL", "CNT_CHILDREN"),
        "EMPLOYED_MINUS_AGE": F.col("DAYS_EMPLOYED") - F.col("DAYS_BIRTH"),
        "GOODS_CREDIT_DIFF": F.col("AMT_GOODS_PRICE") - F.col("AMT_CREDIT"),
    })
    return d.withColumn("EMPLOYED_TO_AGE", ns.ratio_plus1("EMPLOYED_YEARS", "AGE_YEARS"))


def row_stat_features(df: DataFrame, cols: Sequence[str] = tuple(EXT_SOURCES), prefix: str = "EXT_SOURCE") -> DataFrame:
    """P-15 .. P-22: row statistics over the external scores (N7, N10)."""
    cols = list(cols)
    out = {
        f"{prefix}_MEAN": ns.row_mean(cols),
        f"{prefix}_STD": ns.row_std(cols),
        f"{prefix}_PROD": ns.row_prod0(cols),
        f"{prefix}_MAX": ns.row_max(cols),
        f"{prefix}_MIN": ns.row_min(cols),
    }
    if len(cols) == 3:
        a, b, c = (F.col(x) for x in cols)
        out.update({"EXT_1_2": a * b, "EXT_1_3": a * c, "EXT_2_3": b * c})
    return df.withColumns(out)


def document_columns(df: DataFrame, prefix: str = DOCUMENT_PREFIX) -> list[str]:
    """F-09: schema-driven column selection by prefix."""
    return [c for c in df.columns if c.startswith(prefix)]


def row_sum_features(df: DataFrame) -> DataFrame:
    """P-23 .. P-26: row sums (N8) and social-circle ratios."""
    present = set(df.columns)
    return df.withColumns({
        "TOTAL_DOCS_SUBMITTED": ns.row_sum0(document_columns(df)),
        "SOCIAL_CIRCLE_DEFAULT_30_RATIO": ns.ratio_plus1("DEF_30_CNT_SOCIAL_CIRCLE", "OBS_30_CNT_SOCIAL_CIRCLE"),
        "SOCIAL_CIRCLE_DEFAULT_60_RATIO": ns.ratio_plus1("DEF_60_CNT_SOCIAL_CIRCLE", "OBS_60_CNT_SOCIAL_CIRCLE"),
        "TOTAL_BUREAU_ENQUIRIES": ns.row_sum0([c for c in ENQUIRY_COLUMNS if c in present]),
        "TOTAL_CONTACT_FLAGS": ns.row_sum0([c for c in CONTACT_COLUMNS if c in present]),
    })


def application_features(df: DataFrame) -> DataFrame:
    """All 27 application-level expressions, in the reference order of dependence."""
    d = sentinel_features(df)
    d = ratio_features(d)
    d = row_stat_features(d)
    return row_sum_features(d)


# ------------------------------------------------------------------ utilities

def drop_if_present(df: DataFrame, cols: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """P-39: drop columns that exist; never drops the ``keep`` (id) columns."""
    keep = set(keep)
    return df.drop(*[c for c in cols if c in df.columns and c not in keep])


def constant_fill(df: DataFrame, value, cols: Sequence[str] | None = None) -> DataFrame:
    """P-40: fill missing with a constant (e.g. -999 or 0) before a model."""
    return df.fillna(value, subset=list(cols) if cols else None)


def falsy_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """P-41: ``x or d`` semantics (missing or zero -> d)."""
    return df.withColumns({c: ns.falsy_default(c, d) for c, d in defaults.items()})


# Defaults used for applicants with no history at serving time (P-42).
COLD_START_DEFAULTS = {"prev_approval_rate": 0.5, "prev_refusal_rate": 0.5}


def cold_start_defaults(df: DataFrame, history_cols: Sequence[str],
                        special: Mapping[str, float] = COLD_START_DEFAULTS) -> DataFrame:
    """P-42: history features of applicants with no history -> 0 (rates 0.5). Off by default."""
    fills = {c: float(special.get(c, 0.0)) for c in history_cols if c in df.columns}
    return df.fillna(fills)


def align_columns(df: DataFrame, target: Sequence[str], fill=0, keep: Sequence[str] = ()) -> DataFrame:
    """IO-14: reorder to ``target``; absent columns become the constant ``fill``."""
    present = set(df.columns)
    cols = [F.col(k) for k in keep] + [F.col(c) if c in present else F.lit(fill).alias(c) for c in target]
    return df.select(*cols)


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """SET-01: column-set intersection, in the order of ``a``."""
    bs = set(b.columns)
    return [c for c in a.columns if c in bs]


def missing_required(df: DataFrame, required: Sequence[str]) -> list[str]:
    """SET-03 / IO-13: required-minus-present columns."""
    present = set(df.columns)
    return [c for c in required if c not in present]
