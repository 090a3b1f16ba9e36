"""Declarative per-key aggregation (A-10 .. A-60).

A block is a list of ``AggSpec(out, fn, col, pred)`` compiled into **one**
``groupBy(keys).agg(...)``: Spark plans a partial (map-side) hash aggregate,
one exchange on the key, and a final aggregate. All aggregate functions used
here are algebraic, so a hot key (a third of all rows) is combined inside
each map task before the shuffle and never lands whole in one task.
``nunique`` is the only non-algebraic one; Spark plans it as a two-step
aggregate on (key, value), which is also partially combined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AggSpec:
    out: str
    fn: str  # count | sum | mean | max | min | std | nunique | count_eq | count_ge
    col: str
    arg: object = None  # comparison value for count_eq / count_ge

    def sql(self) -> str:
        """The aggregate as a SQL expression (the N-rules: sum of nothing is 0, conditional
        counts treat missing as false, std is the sample std)."""
        c = f"`{self.col}`"
        lit = repr(self.arg) if isinstance(self.arg, (int, float)) else "'" + str(self.arg).replace("'", "''") + "'"
        forms = {
            "count": f"count({c})",
            "sum": f"coalesce(sum({c}), 0)",
            "mean": f"avg({c})",
            "max": f"max({c})",
            "min": f"min({c})",
            "std": f"stddev_samp({c})",
            "nunique": f"count(DISTINCT {c})",
            "count_eq": f"count_if(coalesce({c} = {lit}, false))",
            "count_ge": f"count_if(coalesce({c} >= {lit}, false))",
        }
        if self.fn not in forms:
            raise ValueError(f"unknown aggregate {self.fn!r}")
        return f"{forms[self.fn]} AS `{self.out}`"

    def expr(self) -> Column:
        return F.expr(self.sql())


PostSpec = tuple[str, str]  # (output, SQL expression over the aggregate outputs)


def aggregate_block(df: DataFrame, keys: str | Sequence[str], specs: Sequence[AggSpec],
                    post: Sequence[PostSpec] = ()) -> DataFrame:
    """One grouped aggregate for a whole block plus one post-aggregate projection."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    needed = sorted({s.col for s in specs} - set(keys))
    out = df.select(*keys, *needed).groupBy(*keys).agg(*[s.expr() for s in specs])
    if post:
        out = out.selectExpr("*", *[f"{e} AS `{name}`" for name, e in post])
    return out
