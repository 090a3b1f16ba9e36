"""Query registry: each key maps to a Spark builder ``(spark, sf_dir) -> DataFrame``
and, where the result can be written in SQL, an independent DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query key {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


from riskflow.functions.rounding import SNAP, round_double  # noqa: E402,F401


def finish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round floating outputs so both engines agree despite summation order (same operations
    as ``round_double``, written as one SQL projection: one call to build, not one per column)."""
    scale = float(10 ** digits)
    exprs = []
    for f in df.schema.fields:
        c = f"`{f.name}`"
        if isinstance(f.dataType, (DoubleType, FloatType)):
            exprs.append(f"round(round({c}, {SNAP}) * {scale!r}D, 0) / {scale!r}D AS {c}")
        else:
            exprs.append(c)
    return df.selectExpr(*exprs)


def rounded(sql: str, cols: Sequence[str], digits: int = DIGITS) -> str:  # noqa: D401
    """Oracle counterpart of ``finish``: round the listed double columns."""
    rep = ", ".join(f"round(round({c}, {SNAP}), {digits}) + 0 AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS q"


def rounded_all(sql: str, keep: Sequence[str], digits: int = DIGITS) -> str:
    """Round every column but ``keep`` (integers are unchanged by DuckDB's round;
    ``+ 0`` turns -0.0 into 0.0 as Spark's decimal-based round does)."""
    ex = ", ".join(keep)
    return f"SELECT {ex}, round(round(COLUMNS(* EXCLUDE ({ex})), {SNAP}), {digits}) + 0 FROM ({sql}) AS q"
