"""Explicit schemas (IO-01): the credit source tables, the request / response records and
the library's own tables. CSV sources are read with these, never with schema inference.

Fixed values: column names of the reference's source tables (only the columns it uses,
plus keys), request fields and response fields.
"""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType,
                               StructField, StructType, TimestampType)


def _struct(spec: list[tuple[str, object]]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in spec])


D, I, L, S = DoubleType(), IntegerType(), LongType(), StringType()

APPLICATION_CATEGORICALS = ["NAME_CONTRACT_TYPE", "CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "NAME_TYPE_SUITE",
                            "NAME_INCOME_TYPE", "NAME_EDUCATION_TYPE", "NAME_FAMILY_STATUS", "NAME_HOUSING_TYPE",
                            "OCCUPATION_TYPE", "WEEKDAY_APPR_PROCESS_START", "ORGANIZATION_TYPE", "FONDKAPREMONT_MODE",
                            "HOUSETYPE_MODE", "WALLSMATERIAL_MODE", "EMERGENCYSTATE_MODE"]

#: Measures of the applicant's building, each as average, mode and median.
HOUSING_MEASURES = ["APARTMENTS", "BASEMENTAREA", "YEARS_BEGINEXPLUATATION", "YEARS_BUILD", "COMMONAREA", "ELEVATORS",
                    "ENTRANCES", "FLOORSMAX", "FLOORSMIN", "LANDAREA", "LIVINGAPARTMENTS", "LIVINGAREA",
                    "NONLIVINGAPARTMENTS", "NONLIVINGAREA"]

APPLICATION = _struct(
    [("SK_ID_CURR", L), ("TARGET", I)]
    + [(c, D) for c in ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "CNT_FAM_MEMBERS",
                        "DAYS_REGISTRATION", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3",
                        "OBS_30_CNT_SOCIAL_CIRCLE", "DEF_30_CNT_SOCIAL_CIRCLE", "OBS_60_CNT_SOCIAL_CIRCLE",
                        "DEF_60_CNT_SOCIAL_CIRCLE", "AMT_REQ_CREDIT_BUREAU_HOUR", "AMT_REQ_CREDIT_BUREAU_DAY",
                        "AMT_REQ_CREDIT_BUREAU_WEEK", "AMT_REQ_CREDIT_BUREAU_MON", "AMT_REQ_CREDIT_BUREAU_QRT",
                        "AMT_REQ_CREDIT_BUREAU_YEAR", "REGION_POPULATION_RELATIVE",
                        "OWN_CAR_AGE", "DAYS_LAST_PHONE_CHANGE"]]
    + [(f"{m}_{stat}", D) for stat in ("AVG", "MODE", "MEDI") for m in HOUSING_MEASURES] + [("TOTALAREA_MODE", D)]
    + [(c, I) for c in ["REGION_RATING_CLIENT_W_CITY", "HOUR_APPR_PROCESS_START", "REG_REGION_NOT_LIVE_REGION",
                        "REG_REGION_NOT_WORK_REGION", "LIVE_REGION_NOT_WORK_REGION", "REG_CITY_NOT_LIVE_CITY",
                        "REG_CITY_NOT_WORK_CITY", "LIVE_CITY_NOT_WORK_CITY"]]
    + [(c, I) for c in ["CNT_CHILDREN", "DAYS_BIRTH", "DAYS_EMPLOYED", "DAYS_ID_PUBLISH", "FLAG_MOBIL",
                        "FLAG_EMP_PHONE", "FLAG_WORK_PHONE", "FLAG_CONT_MOBILE", "FLAG_PHONE", "FLAG_EMAIL",
                        "REGION_RATING_CLIENT"]]
    + [(f"FLAG_DOCUMENT_{i}", I) for i in range(2, 22)]
    + [(c, S) for c in APPLICATION_CATEGORICALS])

BUREAU = _struct([("SK_ID_BUREAU", L), ("SK_ID_CURR", L), ("CREDIT_ACTIVE", S), ("CREDIT_TYPE", S),
                  ("AMT_CREDIT_SUM", D), ("AMT_CREDIT_SUM_DEBT", D), ("AMT_CREDIT_SUM_OVERDUE", D),
                  ("AMT_CREDIT_SUM_LIMIT", D), ("DAYS_CREDIT_ENDDATE", D), ("DAYS_CREDIT", I),
                  ("CREDIT_DAY_OVERDUE", I), ("CNT_CREDIT_PROLONG", I)])

BUREAU_BALANCE = _struct([("SK_ID_BUREAU", L), ("MONTHS_BALANCE", I), ("STATUS", S)])

PREVIOUS_APPLICATION = _struct(
    [("SK_ID_PREV", L), ("SK_ID_CURR", L), ("NAME_CONTRACT_STATUS", S)]
    + [(c, D) for c in ["AMT_CREDIT", "AMT_ANNUITY", "AMT_APPLICATION", "AMT_GOODS_PRICE", "AMT_DOWN_PAYMENT",
                        "RATE_DOWN_PAYMENT", "RATE_INTEREST_PRIMARY", "CNT_PAYMENT", "DAYS_FIRST_DRAWING",
                        "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE", "DAYS_TERMINATION"]]
    + [(c, I) for c in ["DAYS_DECISION", "HOUR_APPR_PROCESS_START", "SELLERPLACE_AREA"]])

POS_CASH_BALANCE = _struct([("SK_ID_PREV", L), ("SK_ID_CURR", L), ("MONTHS_BALANCE", I), ("SK_DPD", I),
                            ("SK_DPD_DEF", I), ("CNT_INSTALMENT", D), ("CNT_INSTALMENT_FUTURE", D),
                            ("NAME_CONTRACT_STATUS", S)])

CREDIT_CARD_BALANCE = _struct(
    [("SK_ID_PREV", L), ("SK_ID_CURR", L), ("MONTHS_BALANCE", I), ("CNT_DRAWINGS_CURRENT", I), ("SK_DPD", I),
     ("SK_DPD_DEF", I)]
    + [(c, D) for c in ["AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL", "AMT_DRAWINGS_CURRENT", "AMT_PAYMENT_TOTAL_CURRENT",
                        "AMT_INST_MIN_REGULARITY", "AMT_RECEIVABLE_PRINCIPAL"]])

INSTALLMENTS_PAYMENTS = _struct([("SK_ID_PREV", L), ("SK_ID_CURR", L), ("AMT_PAYMENT", D), ("AMT_INSTALMENT", D),
                                 ("DAYS_INSTALMENT", D), ("DAYS_ENTRY_PAYMENT", D)])

# Source name -> schema (test applications share the training schema without TARGET).
CREDIT_SOURCES = {
    "application_train": APPLICATION,
    "application_test": StructType([f for f in APPLICATION.fields if f.name != "TARGET"]),
    "bureau": BUREAU,
    "bureau_balance": BUREAU_BALANCE,
    "previous_application": PREVIOUS_APPLICATION,
    "POS_CASH_balance": POS_CASH_BALANCE,
    "credit_card_balance": CREDIT_CARD_BALANCE,
    "installments_payments": INSTALLMENTS_PAYMENTS,
}

REQUEST = _struct(
    [(c, D) for c in ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY"]]
    + [("DAYS_BIRTH", I), ("DAYS_EMPLOYED", I)]
    + [(c, D) for c in ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "AMT_GOODS_PRICE"]]
    + [(c, S) for c in ["NAME_CONTRACT_TYPE", "CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "NAME_INCOME_TYPE",
                        "NAME_EDUCATION_TYPE", "NAME_FAMILY_STATUS", "NAME_HOUSING_TYPE"]]
    + [("CNT_CHILDREN", I), ("CNT_FAM_MEMBERS", D), ("DAYS_REGISTRATION", D), ("DAYS_ID_PUBLISH", I)]
    + [(c, I) for c in ["FLAG_MOBIL", "FLAG_EMP_PHONE", "FLAG_WORK_PHONE", "FLAG_PHONE", "FLAG_EMAIL"]]
    + [("REGION_POPULATION_RELATIVE", D), ("REGION_RATING_CLIENT", I)]
    + [(c, D) for c in ["AMT_REQ_CREDIT_BUREAU_MON", "AMT_REQ_CREDIT_BUREAU_QRT", "AMT_REQ_CREDIT_BUREAU_YEAR"]]
    + [("explain", BooleanType())])

RISK_FACTOR = _struct([("feature", S), ("shap_value", D), ("direction", S), ("description", S)])

RESPONSE = _struct([("default_probability", D), ("risk_label", S), ("risk_score", I), ("recommended_action", S),
                    ("top_risk_factors", ArrayType(RISK_FACTOR)), ("model_version", S), ("prediction_id", S),
                    ("latency_ms", D)])

OOF = _struct([("id", L), ("label", I), ("fold", I), ("model", S), ("prob", D)])
WOE_MAP = _struct([("column", S), ("category", S), ("events", L), ("total", L), ("woe", D), ("iv", D)])
RUNS = _struct([("run_id", S), ("name", S), ("tags", MapType(S, S)), ("params", MapType(S, S)),
                ("metrics", MapType(S, D)), ("step", I), ("ts", TimestampType())])
DRIFT = _struct([("feature", S), ("psi", D), ("status", S), ("mean_train", D), ("mean_live", D)])
