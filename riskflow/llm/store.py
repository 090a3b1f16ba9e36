"""Tables written to the shared folder of the session, and small helpers of the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.session import checkpoint_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it again.

    The plan runs once, its lineage ends here, and losing an executor later costs nothing:
    every executor reads the files from the shared folder."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/riskflow/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def id_schema(docs: DataFrame, id_col: str, rest: str) -> T.StructType:
    """``id``, of the type of the id column whatever its fields are named, and the columns of ``rest`` (DDL)."""
    return T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL(rest)])


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name
