"""E-06: the whole feature table from the eight credit sources.

Train and test applications are unioned with a ``split`` column so every
expression, aggregate and join runs once for both; the five history blocks
are aggregated per applicant and left-joined (1:1, N12: no fill); the WoE map
is fitted on the training applications alone, before any join, and applied to all
rows in one projection; categoricals are dropped afterwards while the id, the target
and the split stay. The result has all columns of the published feature list.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.operators import blocks, features, woe
from riskflow.operators.joins import star_join
from riskflow.sources.io import read_csv
from riskflow.sources.schemas import APPLICATION_CATEGORICALS, CREDIT_SOURCES

KEY = "SK_ID_CURR"


def read_credit_tables(spark: SparkSession, base_dir: str, fmt: str = "csv") -> dict[str, DataFrame]:
    """IO-01 / IO-04: the eight sources with explicit schemas (CSV with header, or Parquet)."""
    out = {}
    for name, schema in CREDIT_SOURCES.items():
        path = f"{base_dir.rstrip('/')}/{name}.{fmt}"
        out[name] = read_csv(spark, path, schema) if fmt == "csv" else spark.read.schema(schema).parquet(path)
    return out


def build_feature_table(tables: Mapping[str, DataFrame], fit_woe: bool = True,
                        categoricals: Sequence[str] = tuple(APPLICATION_CATEGORICALS)) -> DataFrame:
    train = tables["application_train"].withColumn("split", F.lit("train"))
    test = tables["application_test"]
    if "TARGET" not in test.columns:
        test = test.withColumn("TARGET", F.lit(None).cast("int"))
    app = features.application_features(train.unionByName(test.withColumn("split", F.lit("test"))))
    parts = [
        blocks.bureau_block(tables["bureau"], tables["bureau_balance"]),
        blocks.previous_block(tables["previous_application"]),
        blocks.pos_block(tables["POS_CASH_balance"]),
        blocks.card_block(tables["credit_card_balance"]),
        blocks.instalment_block(tables["installments_payments"]),
    ]
    cats = [c for c in categoricals if c in app.columns]
    if fit_woe and cats:
        app = woe.woe_transform(app, woe.woe_fit(train, "TARGET", cats), cats)
    out = star_join(app, parts, KEY)
    return features.drop_if_present(out, cats, keep=[KEY])
