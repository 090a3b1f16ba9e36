"""Sources and sinks (IO-01 .. IO-15).

Everything is a Spark reader or writer; outputs go under a base folder that
on a cluster is the shared location the session names (``spark.checkpoint.dir``
by default, or an explicit path), never a machine-local folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType,
                               StringType, StructType)

from riskflow.session import checkpoint_dir


def output_root(spark: SparkSession, base: str | None = None) -> str:
    """Shared output folder: explicit ``base`` or the session's checkpoint folder."""
    return (base or checkpoint_dir(spark)).rstrip("/")


def unique_path(spark: SparkSession, name: str, base: str | None = None) -> str:
    return f"{output_root(spark, base)}/{name}-{uuid.uuid4().hex[:12]}"


# ------------------------------------------------------------------ IO-01 / IO-02 / IO-04

def read_csv(spark: SparkSession, path: str, schema: StructType | str, limit: int | None = None) -> DataFrame:
    """IO-01: CSV with header; the columns of ``schema`` are taken by name, in any order in the file, and cast
    (no inference pass); further columns are ignored, empty fields are NULL, a column that is absent raises.
    IO-02: ``limit`` bounds the scan (the feature of the bounded loader)."""
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = spark.read.option("header", True).option("nullValue", "").option("mode", "PERMISSIVE").csv(path)
    absent = [f.name for f in wanted if f.name not in raw.columns]
    if absent:
        raise ValueError(f"columns absent from {path}: {', '.join(absent)}")
    df = raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted])
    return df.limit(limit) if limit else df


def malformed_counts(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """IO-01: (column, n_malformed) of a CSV: values that are there but are none of the column's type, which ``read_csv``
    reads as NULL."""
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = spark.read.option("header", True).option("nullValue", "").option("mode", "PERMISSIVE").csv(path)
    bad = [F.count_if(F.col(f"`{f.name}`").isNotNull() & F.col(f"`{f.name}`").try_cast(f.dataType).isNull()).alias(f"n{i}") for i, f in enumerate(wanted)]
    pairs = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"n{i}").alias("n_malformed")) for i, f in enumerate(wanted)])
    return raw.agg(*bad).select(F.explode(pairs).alias("x")).select("x.*")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """IO-04."""
    return spark.read.parquet(path)


# ------------------------------------------------------------------ IO-05 / IO-06 / IO-07

def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """IO-05 / IO-07: overwrite a Parquet table (optionally partitioned, e.g. OOF by model)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """IO-06: CSV with header (one folder of part files; no driver-side concatenation)."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


# ------------------------------------------------------------------ IO-03

_INT_RANGES = [(ByteType(), -128, 127), (ShortType(), -32768, 32767), (IntegerType(), -2 ** 31, 2 ** 31 - 1)]
FLOAT32_MAX = 3.4028234663852886e38
DICTIONARY_SHARE = 0.05


def narrowing_plan(df: DataFrame, rsd: float = 0.01) -> DataFrame:
    """IO-03: one pass of min / max / approximate distinct per column, then the planned
    narrow type per column (integers by range, doubles to float, low-cardinality
    strings flagged for dictionary encoding)."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(fields):
        if isinstance(f.dataType, (ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType)):
            aggs += [F.min(f.name).cast("double").alias(f"_min{i}"), F.max(f.name).cast("double").alias(f"_max{i}")]
        elif isinstance(f.dataType, StringType):
            aggs += [F.approx_count_distinct(f.name, rsd).alias(f"_nd{i}")]
    wide = df.agg(*aggs)
    rows = []
    for i, f in enumerate(fields):
        src = F.lit(f.dataType.simpleString())
        if isinstance(f.dataType, (ByteType, ShortType, IntegerType, LongType)):
            lo, hi = F.col(f"_min{i}"), F.col(f"_max{i}")
            tgt = None
            for t, a, b in _INT_RANGES:
                cond = (lo >= a) & (hi <= b)
                tgt = F.when(cond, F.lit(t.simpleString())) if tgt is None else tgt.when(cond, F.lit(t.simpleString()))
            tgt = tgt.otherwise(F.lit("bigint"))
            dic = F.lit(False)
        elif isinstance(f.dataType, (FloatType, DoubleType)):
            tgt = F.when((F.abs(F.col(f"_min{i}")) <= FLOAT32_MAX) & (F.abs(F.col(f"_max{i}")) <= FLOAT32_MAX),
                         F.lit("float")).otherwise(F.lit("double"))
            dic = F.lit(False)
        elif isinstance(f.dataType, StringType):
            tgt = F.lit("string")
            dic = (F.col(f"_nd{i}") / F.col("_n")) < DICTIONARY_SHARE
        else:
            tgt, dic = src, F.lit(False)
        rows.append(F.struct(F.lit(f.name).alias("column"), src.alias("source_type"), tgt.alias("target_type"),
                             dic.alias("is_dictionary")))
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def apply_narrowing(df: DataFrame, plan_rows: Sequence[tuple[str, str]]) -> DataFrame:
    """Cast columns to the planned types (plan rows are one small row per column)."""
    casts = dict(plan_rows)
    return df.select(*[F.col(c).cast(casts.get(c, df.schema[c].dataType.simpleString())).alias(c) for c in df.columns])


# ------------------------------------------------------------------ IO-09 / IO-11 / IO-15

RUNS_SCHEMA = ("run_id string, name string, tags map<string,string>, params map<string,string>, "
               "metrics map<string,double>, step int, ts timestamp")


def append_runs(runs: DataFrame, path: str) -> None:
    """IO-11: append-only run log (tags, params, metrics, step) as a Parquet table."""
    runs.select(*[c.split(" ")[0] for c in RUNS_SCHEMA.split(", ")]).write.mode("append").parquet(path)


def best_runs(spark: SparkSession, path: str, metric: str, k: int = 1) -> DataFrame:
    """IO-11 "best run": top-k runs by one metric of the map column (a top-k report)."""
    return spark.read.parquet(path).orderBy(F.col("metrics")[metric].desc_nulls_last(), "run_id").limit(k)


# Registry defaults used when the stored record is absent or empty.
REGISTRY_DEFAULTS = {"model_version": "1.0.0", "optimal_threshold": 0.21, "auc": None, "n_train_rows": None}


def write_registry(spark: SparkSession, record: Mapping[str, object], path: str) -> str:
    """IO-09: one-row model registry record written as JSON lines."""
    spark.createDataFrame([(json.dumps(dict(record)),)], "value string").write.mode("overwrite").text(path)
    return path


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """IO-09 scan with defaults for absent fields."""
    schema = "model_version string, optimal_threshold double, weights map<string,double>, auc double, " \
             "n_train_rows long, feature_names array<string>"
    df = spark.read.schema(schema).json(path)
    return df.select(
        F.coalesce("model_version", F.lit(REGISTRY_DEFAULTS["model_version"])).alias("model_version"),
        F.coalesce("optimal_threshold", F.lit(REGISTRY_DEFAULTS["optimal_threshold"])).alias("optimal_threshold"),
        "weights", "auc", "n_train_rows", "feature_names")


def feature_names(registry: DataFrame, importance: DataFrame | None = None) -> DataFrame:
    """IO-15: feature names from the registry, else the ``feature`` column of an importance table."""
    names = registry.select(F.explode_outer("feature_names").alias("feature")).filter(F.col("feature").isNotNull())
    if importance is None:
        return names
    return importance.select("feature") if names.isEmpty() else names


# ------------------------------------------------------------------ IO-12 / IO-13

def _dense(rows: DataFrame, file: str, block: str, within: str, seq: str) -> DataFrame:
    """``seq`` from 0 in the order of (file, block, within). Only the number of rows of each block is ordered as a whole."""
    rank = F.row_number().over(Window.partitionBy(file, block).orderBy(within)) - 1
    return _after(rows.withColumn("_rank", rank), file, block, "_rank", seq).drop(within)


def _after(rows: DataFrame, file: str, block: str, rank: str, seq: str) -> DataFrame:
    """``seq`` of rows that have their rank in their block: the rows of the blocks before are added."""
    counts = rows.groupBy(file, block).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(file, block).rowsBetween(Window.unboundedPreceding, -1)      # a row a file or a split of one
    offsets = counts.select(F.col(file).alias("_f"), F.col(block).alias("_k"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = rows.join(offsets, (F.col(file) == F.col("_f")) & (F.col(block) == F.col("_k")))
    return out.withColumn(seq, F.col("_off") + F.col(rank)).drop("_f", "_k", "_off", rank, file, block)


def read_sequenced(spark: SparkSession, path: str, seq: str = "seq") -> DataFrame:
    """IO-12: a Parquet table with the position of each row in it: files in the order of their paths, rows as they lie in
    the file (from the file's own row index, so neither splits nor partitions change it). The index counts the file's rows
    from 0 without gaps: it is the rank itself, and no task orders a file."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    return _after(rows.withColumn("_block", F.lit(0)), "_file", "_block", "_at", seq)


def read_json_records(spark: SparkSession, path: str, schema: StructType | str, seq: str = "seq") -> DataFrame:
    """IO-12: JSON lines to typed rows with their position in the input: files in the order of their paths, then lines. A
    line that is no record of the schema keeps its position and has NULLs; blank lines count."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                                         F.monotonically_increasing_id().alias("_at"))      # ascending within a split
    return records_from_json(_dense(lines, "_file", "_block", "_at", seq), "value", schema, seq)


def records_from_json(df: DataFrame, col: str, schema: StructType | str, seq: str = "seq", keep: Sequence[str] = ()) -> DataFrame:
    """IO-12: JSON strings of a table that has its sequence (``seq``, and further columns to ``keep``) to typed rows."""
    return df.select(seq, *keep, F.from_json(col, schema).alias("_record")).select(seq, *keep, "_record.*")


def contract_report(tables: Mapping[str, DataFrame], required: Mapping[str, Sequence[str]]) -> list[tuple[str, str]]:
    """IO-13 / SET-03: per table, the required columns that are absent (schema-level, no data read)."""
    out = []
    for name, df in tables.items():
        present = set(df.columns)
        missing = [c for c in required.get(name, []) if c not in present]
        out.append((name, ",".join(missing)))
    return out
