"""Literal arrays built as one SQL expression (one driver call instead of one per element).

Doubles are written with ``repr`` and the ``D`` suffix, which parses back to the identical
IEEE value, so fixed grids (cut points, quantile levels, weights) keep their exact values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lit(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"{v!r}D"
    return "'" + str(v).replace("'", "''") + "'"


def double_array(values: Sequence[float]) -> Column:
    return F.expr("array(" + ", ".join(_lit(float(v)) for v in values) + ")")


def struct_array(rows: Sequence[Mapping[str, object]]) -> Column:
    """array(named_struct(...), ...) from a list of dicts with the same keys."""
    items = ["named_struct(" + ", ".join(f"'{k}', {_lit(v)}" for k, v in r.items()) + ")" for r in rows]
    return F.expr("array(" + ", ".join(items) + ")")
