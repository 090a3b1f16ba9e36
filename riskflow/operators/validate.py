"""Rule-based validation with quarantine (Q-01 .. Q-06, IO-13).

A rule is (name, violation predicate). All rules of a contract become one
``array_compact(array(when(violation, name), ...))`` column, so a whole batch
is validated in one narrow projection; invalid rows are kept (quarantine)
with their reasons instead of rejecting the batch. Rules whose columns are
absent from the input are skipped (IO-13 reports them separately).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    cols: tuple[str, ...]
    violation: object  # callable () -> Column

    def expr(self) -> Column:
        return F.when(F.coalesce(self.violation(), F.lit(False)), F.lit(self.name))


def required(c: str) -> Rule:
    return Rule(f"required:{c}", (c,), lambda: F.col(c).isNull())


def gt(c: str, v) -> Rule:
    return Rule(f"{c}>{v}", (c,), lambda: F.col(c) <= v)


def ge(c: str, v) -> Rule:
    return Rule(f"{c}>={v}", (c,), lambda: F.col(c) < v)


def lt(c: str, v) -> Rule:
    return Rule(f"{c}<{v}", (c,), lambda: F.col(c) >= v)


def le(c: str, v) -> Rule:
    return Rule(f"{c}<={v}", (c,), lambda: F.col(c) > v)


def between(c: str, lo, hi) -> Rule:
    return Rule(f"{c} in [{lo},{hi}]", (c,), lambda: (F.col(c) < lo) | (F.col(c) > hi))


def one_of(c: str, values: Sequence[str]) -> Rule:
    return Rule(f"{c} allowed", (c,), lambda: ~F.col(c).isin(*values))


def pattern(c: str, regex: str) -> Rule:
    return Rule(f"{c} pattern", (c,), lambda: ~F.col(c).rlike(regex))


# The reference request contract.
REQUIRED = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "DAYS_BIRTH", "DAYS_EMPLOYED"]
ENUMS = {
    "NAME_CONTRACT_TYPE": ["Cash loans", "Revolving loans"],
    "CODE_GENDER": ["M", "F", "XNA"],
    "NAME_INCOME_TYPE": ["Working", "State servant", "Commercial associate", "Pensioner", "Unemployed", "Student",
                         "Businessman", "Maternity leave"],
    "NAME_EDUCATION_TYPE": ["Secondary / secondary special", "Higher education", "Incomplete higher",
                            "Lower secondary", "Academic degree"],
    "NAME_FAMILY_STATUS": ["Single / not married", "Married", "Civil marriage", "Widow", "Separated"],
    "NAME_HOUSING_TYPE": ["House / apartment", "Rented apartment", "With parents", "Municipal apartment",
                          "Office apartment", "Co-op apartment"],
}


def application_contract() -> list[Rule]:
    rules = [required(c) for c in REQUIRED]
    rules += [gt("AMT_INCOME_TOTAL", 0), gt("AMT_CREDIT", 0), gt("AMT_ANNUITY", 0), lt("DAYS_BIRTH", 0),
              Rule("DAYS_EMPLOYED<=0", ("DAYS_EMPLOYED",), lambda: F.col("DAYS_EMPLOYED") > 0)]
    rules += [between(f"EXT_SOURCE_{i}", 0, 1) for i in (1, 2, 3)]
    rules += [gt("AMT_GOODS_PRICE", 0)]
    rules += [one_of(c, v) for c, v in ENUMS.items()]
    rules += [pattern("FLAG_OWN_CAR", "^[YN]$"), pattern("FLAG_OWN_REALTY", "^[YN]$"),
              between("CNT_CHILDREN", 0, 20), between("CNT_FAM_MEMBERS", 1, 20),
              le("DAYS_REGISTRATION", 0), le("DAYS_ID_PUBLISH", 0)]
    rules += [between(c, 0, 1) for c in ("FLAG_MOBIL", "FLAG_EMP_PHONE", "FLAG_WORK_PHONE", "FLAG_PHONE",
                                         "FLAG_EMAIL", "REGION_POPULATION_RELATIVE")]
    rules += [between("REGION_RATING_CLIENT", 1, 3)]
    rules += [ge(c, 0) for c in ("AMT_REQ_CREDIT_BUREAU_MON", "AMT_REQ_CREDIT_BUREAU_QRT", "AMT_REQ_CREDIT_BUREAU_YEAR")]
    # Cross-field rule, applied only when both values are truthy (non-missing, non-zero).
    rules += [Rule("credit>=0.5*goods", ("AMT_CREDIT", "AMT_GOODS_PRICE"),
                   lambda: (F.col("AMT_GOODS_PRICE") != 0) & (F.col("AMT_CREDIT") != 0)
                   & (F.col("AMT_CREDIT") < F.col("AMT_GOODS_PRICE") * 0.5))]
    return rules


def applicable(df: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    present = set(df.columns)
    return [r for r in rules if set(r.cols) <= present]


def with_violations(df: DataFrame, rules: Sequence[Rule], out: str = "violations") -> DataFrame:
    """Q-06: ``violations`` array (rule order) and ``is_valid``."""
    rs = applicable(df, rules)
    absent = [F.lit(r.name) for r in rules if r.name.startswith("required:") and not set(r.cols) <= set(df.columns)]
    checks = [*absent, *[r.expr() for r in rs]]      # a required column that is absent fails every row
    v = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    return df.withColumn(out, v).withColumn("is_valid", F.size(out) == 0)


def split(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Valid rows and quarantined rows (with reasons)."""
    v = with_violations(df, rules)
    return v.filter("is_valid").drop("violations", "is_valid"), v.filter(~F.col("is_valid"))


def rule_counts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Per-rule violation counts in one pass (``count_if`` per rule, then unpivot)."""
    rs = applicable(df, rules)
    missing = [r for r in rules if r.name.startswith("required:") and not set(r.cols) <= set(df.columns)]
    rs += [Rule(r.name, (), lambda: F.lit(True)) for r in missing]      # an absent required column fails every row
    if not rs:
        return df.sparkSession.createDataFrame([], "rule string, n_violations long")
    wide = df.agg(*[F.count_if(F.coalesce(r.violation(), F.lit(False))).alias(f"r{i}") for i, r in enumerate(rs)])
    pairs = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"r{i}").alias("n_violations"))
                      for i, r in enumerate(rs)])
    return wide.select(F.explode(pairs).alias("x")).select("x.rule", "x.n_violations")
