"""Saved members and their blend for batch and stream scoring (S-01 .. S-03, T-01).

A serving folder holds each member (an MLlib pipeline by its own writer, a boosted ensemble as JSON) and one record with
the order, weights, fill values and feature names. The same ``score`` runs on a table and on a stream.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.operators import boost
from riskflow.operators.thresholds import blend

LEAST_WEIGHT = 0.01     # members of at most this weight are skipped


@dataclass(frozen=True)
class Serving:
    features: list[str]
    members: dict[str, PipelineModel | boost.Ensemble]
    weights: dict[str, float]
    fills: dict[str, float]         # of the pipelines; a boosted member takes missing values as they are

    def score(self, df: DataFrame, out: str = "default_probability") -> DataFrame:
        """All columns of ``df``, the probability of each member that counts (``prob_<name>``) and their blend."""
        used = [n for n in self.members if self.weights[n] > LEAST_WEIGHT]
        trees = [n for n in used if isinstance(self.members[n], boost.Ensemble)]
        d = df
        if trees:
            d = boost.score(d, [self.members[n] for n in trees], df.columns, [f"prob_{n}" for n in trees])
        for n in used:
            if n not in trees:
                names, d = pipeline_inputs(self.features), filled(d, self.features, self.fills[n])
                before = d.columns
                d = self.members[n].transform(d)
                d = d.withColumn(f"prob_{n}", vector_to_array("probability")[1]).select(*[f"`{c}`" for c in before if c not in names], f"prob_{n}")
        return blend(d, {f"prob_{n}": self.weights[n] for n in used}, out, LEAST_WEIGHT)


def pipeline_inputs(features: Sequence[str]) -> list[str]:
    """Names under which a pipeline member is fitted and served: its inputs filled, whatever the table's columns are."""
    return [f"_in_{i}" for i in range(len(features))]


def filled(df: DataFrame, features: Sequence[str], fill: float) -> DataFrame:
    """The inputs of a pipeline member; null and NaN are missing."""
    return df.withColumns({i: F.coalesce(F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None).cast("double")), F.lit(float(fill)))
                           for i, f in zip(pipeline_inputs(features), features, strict=True)})


def save(spark: SparkSession, root: str, serving: Serving) -> str:
    for n, m in serving.members.items():
        if isinstance(m, PipelineModel):
            m.write().overwrite().save(f"{root}/{n}")
        else:
            spark.createDataFrame([(m.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/{n}")
    record = {"features": serving.features, "weights": serving.weights, "fills": serving.fills,
              "members": {n: type(m).__name__ for n, m in serving.members.items()}}
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/record")
    return root


def load(spark: SparkSession, root: str) -> Serving:
    record: Mapping = json.loads(spark.read.text(f"{root}/record").first().value)
    members = {n: PipelineModel.load(f"{root}/{n}") if kind == "PipelineModel" else boost.Ensemble.from_json(spark.read.text(f"{root}/{n}").first().value)
               for n, kind in record["members"].items()}
    return Serving(record["features"], members, record["weights"], record["fills"])
