"""Null-aware column expressions: the N-rules in one place.

Every helper returns a built-in Spark ``Column`` so the work stays inside
whole-stage codegen. Rules (see SURVEY §1.4):

* group sum of all-missing is 0 (N1); mean/max/min skip missing (N2);
  count counts non-missing (N3); std is the sample std (N4);
* comparisons with missing are false, so conditional counts and flags are 0 (N5);
* clip / max(0, x) propagate missing (N6);
* row-wise mean/std/max/min skip missing (N7); row-wise sum treats missing as 0 (N8);
* ratios never raise: division by zero gives missing (N11).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _names(*cs) -> bool:
    """True when every argument is a column name: the rule is then built as one SQL
    expression (one driver call) instead of a tree of Column objects."""
    return all(isinstance(c, str) for c in cs)


def _q(c: str) -> str:
    return f"`{c}`"


# ---------------------------------------------------------------- aggregates

def sum0(c: ColumnOrName) -> Column:
    """N1: group sum where all-missing (or empty) gives 0."""
    return F.coalesce(F.sum(_c(c)), F.lit(0))


def count_where(pred: Column) -> Column:
    """N5: count of rows where ``pred`` is true; missing counts as false."""
    return F.count_if(F.coalesce(pred, F.lit(False)))


def std_samp(c: ColumnOrName) -> Column:
    """N4: sample standard deviation (NULL for a single value)."""
    return F.stddev_samp(_c(c))


# ---------------------------------------------------------------- row scalars

def flag(pred: Column) -> Column:
    """N5: 1 where ``pred`` holds, 0 where false or missing."""
    return F.coalesce(pred, F.lit(False)).cast("int")


def clip(c: ColumnOrName, lo: float | None = None, hi: float | None = None) -> Column:
    """N6: clip into [lo, hi]; missing stays missing (bare greatest would give lo)."""
    if _names(c):
        e = _q(c)
        if lo is not None:
            e = f"greatest({e}, {float(lo)!r}D)"
        if hi is not None:
            e = f"least({e}, {float(hi)!r}D)"
        return F.expr(f"CASE WHEN {_q(c)} IS NOT NULL THEN {e} END")
    x = _c(c)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(x.isNotNull(), out)


def ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """N11: division that yields missing instead of raising on a zero denominator."""
    if _names(num, den):
        return F.expr(f"try_divide({_q(num)}, {_q(den)})")
    return F.try_divide(_c(num), _c(den))


def ratio_plus1(num: ColumnOrName, den: ColumnOrName) -> Column:
    """The reference's ``num / (den + 1)`` with N11 safety."""
    if _names(num, den):
        return F.expr(f"try_divide({_q(num)}, {_q(den)} + 1)")
    return F.try_divide(_c(num), _c(den) + F.lit(1))


def sentinel_to_null(c: ColumnOrName, sentinel: int | float) -> Column:
    """P-02 / P-31: a sentinel value means "no value"."""
    return F.nullif(_c(c), F.lit(sentinel))


def float_ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``num / den`` of doubles as floating point has it: by zero an infinity, 0 / 0 NaN (larger than all); no error."""
    n, d = _c(num).cast("double"), _c(den).cast("double")
    by_zero = F.when(n > 0, F.lit(float("inf"))).when(n < 0, F.lit(float("-inf"))).when(n.isNotNull(), F.lit(float("nan")))
    return F.when(d == 0, by_zero).otherwise(n / d)


def falsy_default(c: ColumnOrName, default) -> Column:
    """P-41: Python's ``x or d`` - missing *or zero* becomes ``d`` (a value or a column)."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(_c(c), F.lit(0)), d)


# ---------------------------------------------------------------- row-wise

def _present(cols: Sequence[ColumnOrName]) -> Column:
    return sum((_c(c).isNotNull().cast("int") for c in cols), F.lit(0))


def _present_sql(cols: Sequence[str]) -> str:
    return "(0" + "".join(f" + CAST({_q(c)} IS NOT NULL AS INT)" for c in cols) + ")"


def _row_mean_sql(cols: Sequence[str]) -> str:
    s = "0.0D" + "".join(f" + coalesce(CAST({_q(c)} AS DOUBLE), 0.0D)" for c in cols)
    return f"CASE WHEN {_present_sql(cols)} > 0 THEN ({s}) / {_present_sql(cols)} END"


def row_sum0(cols: Sequence[ColumnOrName]) -> Column:
    """N8: row sum, missing counted as 0."""
    if _names(*cols):
        return F.expr("0" + "".join(f" + coalesce({_q(c)}, 0)" for c in cols))
    return sum((F.coalesce(_c(c), F.lit(0)) for c in cols), F.lit(0))


def row_prod0(cols: Sequence[ColumnOrName]) -> Column:
    """N10: row product after filling missing with 0."""
    if _names(*cols):
        return F.expr("1.0D" + "".join(f" * coalesce(CAST({_q(c)} AS DOUBLE), 0.0D)" for c in cols))
    out = F.lit(1.0)
    for c in cols:
        out = out * F.coalesce(_c(c).cast("double"), F.lit(0.0))
    return out


def row_mean(cols: Sequence[ColumnOrName]) -> Column:
    """N7: mean of the present values; missing when none is present."""
    if _names(*cols):
        return F.expr(_row_mean_sql(cols))
    n = _present(cols)
    s = sum((F.coalesce(_c(c).cast("double"), F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.when(n > 0, s / n)


def row_std(cols: Sequence[ColumnOrName]) -> Column:
    """N7: sample std of the present values; missing below two values."""
    if _names(*cols):
        m = _row_mean_sql(cols)
        ss = "0.0D" + "".join(f" + coalesce((CAST({_q(c)} AS DOUBLE) - ({m})) * (CAST({_q(c)} AS DOUBLE) - ({m})), 0.0D)"
                              for c in cols)
        return F.expr(f"CASE WHEN {_present_sql(cols)} >= 2 THEN sqrt(({ss}) / ({_present_sql(cols)} - 1)) END")
    n = _present(cols)
    mean = row_mean(cols)
    ss = sum((F.coalesce((_c(c).cast("double") - mean) * (_c(c).cast("double") - mean), F.lit(0.0))
              for c in cols), F.lit(0.0))
    return F.when(n >= 2, F.sqrt(ss / (n - 1)))


def row_max(cols: Sequence[ColumnOrName]) -> Column:
    """N7: ``greatest`` already skips missing."""
    if _names(*cols):
        return F.expr("greatest(" + ", ".join(_q(c) for c in cols) + ")")
    return F.greatest(*[_c(c) for c in cols])


def row_min(cols: Sequence[ColumnOrName]) -> Column:
    if _names(*cols):
        return F.expr("least(" + ", ".join(_q(c) for c in cols) + ")")
    return F.least(*[_c(c) for c in cols])


def nan_to_null(c: ColumnOrName) -> Column:
    """Boundary rule: NaN never survives a source (max/greatest treat NaN as largest)."""
    x = _c(c)
    return F.when(~F.isnan(x), x)
