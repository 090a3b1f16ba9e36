"""Resumable training stages by a manifest (M-12).

A stage is a set of slices, such as the folds of one model. Each slice's result is a Parquet table of its own in the
shared folder; once it is whole, one row of the manifest says so: stage, slice, hash of the specification and of the
input, number of rows, and a note (the fitted model). A run reads the manifest, keeps the slices that belong to the same
specification and input and whose table still has the rows it says, and computes the others only. The manifest is
append-only, so a run that ends between two slices loses no more than the one it was at.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, is_dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "stage string, slice int, spec_hash string, n_rows long, path string, note string, finished timestamp"


def fingerprint(df: DataFrame, columns: Sequence[str]) -> str:
    """Of the rows of a table in these columns, whatever their order: one aggregate."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
    r = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return f"{r.n}:{r.x}:{r.s}"


def spec_hash(*parts) -> str:
    """Of specifications, names and fingerprints."""
    plain = [[type(p).__name__, asdict(p)] if is_dataclass(p) else p for p in parts]
    return hashlib.sha256(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest()


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """All rows of the manifest; none where nothing was finished yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def _whole(spark: SparkSession, path: str, n_rows: int) -> bool:
    """Whether the table of a slice is there with all its rows."""
    try:
        return spark.read.parquet(path).count() == n_rows
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def run_slices(spark: SparkSession, root: str, stage: str, key: str, slices: Sequence[int],
               compute: Callable[[list[int]], Iterable[tuple[int, DataFrame, str]]], at_once: int | None = None
               ) -> tuple[DataFrame, dict[int, str], list[int]]:
    """The stage's table, the note of each slice, and the slices that were computed now.

    ``compute`` takes up to ``at_once`` unfinished slices and gives (slice, table, note) of each."""
    rows = read_manifest(spark, root).filter((F.col("stage") == stage) & (F.col("spec_hash") == key)).orderBy("finished").collect()
    done = {r.slice: r for r in rows if r.slice in slices and _whole(spark, r.path, r.n_rows)}
    notes, paths = {k: r.note for k, r in done.items()}, {k: r.path for k, r in done.items()}
    left = [s for s in slices if s not in done]
    step = at_once or max(len(left), 1)
    for i in range(0, len(left), step):
        for s, table, note in compute(left[i:i + step]):
            path = f"{root}/{stage}/{key[:16]}/{s}-{uuid.uuid4().hex[:8]}"
            table.write.parquet(path)
            row = spark.createDataFrame([(stage, s, key, spark.read.parquet(path).count(), path, note)], MANIFEST.rsplit(", ", 1)[0])
            row.withColumn("finished", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
            notes[s], paths[s] = note, path
    out = None
    for s in slices:
        part = spark.read.parquet(paths[s])
        out = part if out is None else out.unionByName(part)
    return out, notes, left
