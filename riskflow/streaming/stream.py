"""Structured Streaming re-aims of the request-time paths (T-01, T-02).

T-01 online scoring: file stream -> validation rules (Q) -> feature expressions (P) -> saved members -> blend -> risk
band (S-04). One query reads the source once and appends every row, scored or with the rules it breaks, to one Parquet
sink partitioned by validity, so valid rows and the quarantine are two partitions of one exactly-once table. The
checkpoint lies beside it in the shared folder: a run that is started again on the same folder goes on where it stopped.

T-02 drift monitor: event stream with a watermark, tumbling event-time windows counting values per risk band and per
PSI bin of the baseline population (bin edges are a fixed 11-number array computed once from the baseline table). Closed
windows are appended to a Parquet sink; those still open when a bounded input ends are read from the state of the query,
so each input row is in one window or was late. Both views, PSI and counts per band, come from the same counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskflow.functions.literals import double_array
from riskflow.operators import stability as ST
from riskflow.operators import validate as V
from riskflow.operators.calibration import quantile_edges
from riskflow.sources.io import unique_path


def file_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int = 1) -> DataFrame:
    """Parquet file stream over ``<dir>/<name>.parquet`` (schema taken from the table, no inference)."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # A one-character glob class keeps the source a directory listing (the streaming
    # file source needs a directory base path) that matches exactly this file.
    return (spark.readStream.schema(schema).option("basePath", sf_dir).option("maxFilesPerTrigger", max_files)
                 .parquet(f"{sf_dir}/{name}.parq[u]et"))


def _finished(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


@dataclass(frozen=True)
class ScoredTable:
    """Sink of a scoring stream: all rows, partitioned by ``is_valid``."""
    root: str
    schema: StructType
    input_rows: int

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.root}/rows")

    def valid(self, spark: SparkSession) -> DataFrame:
        return self.read(spark).filter("is_valid").drop("violations", "is_valid")

    def quarantine(self, spark: SparkSession) -> DataFrame:
        """Rows that break rules, with the rules' names joined by commas."""
        return self.read(spark).filter("NOT is_valid").drop("is_valid")


def score_stream(spark: SparkSession, source: DataFrame, transform: Callable[[DataFrame], DataFrame], rules,
                 base: str | None = None, root: str | None = None, score: Callable[[DataFrame], DataFrame] | None = None,
                 scores: tuple[str, ...] = ()) -> ScoredTable:
    """T-01: run the scoring stream over all that is there (availableNow, however long it takes).

    ``transform`` gives the columns that the rules look at; ``score`` adds those that a model gives. The ``scores``
    columns are emptied where a row breaks a rule. ``root`` is the folder of a stream to go on with."""
    root = root or unique_path(spark, "stream-score", base)
    checked = V.with_violations(transform(source), rules)
    out = score(checked) if score else checked
    out = out.withColumns({c: F.when(F.col("is_valid"), F.col(c)) for c in scores})
    out = out.withColumn("violations", F.array_join("violations", ","))
    query = (out.writeStream.format("parquet").outputMode("append").partitionBy("is_valid").option("path", f"{root}/rows")
             .option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start())
    _finished(query)
    return ScoredTable(root, out.schema, sum(p["numInputRows"] for p in query.recentProgress))


def utc_instant(ts: str):
    """Event time as an instant, reading a zone-less timestamp's wall clock as UTC whatever the
    session time zone (watermarks need an instant type)."""
    c = F.col(ts)
    return F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c),
                            F.expr(f"date_part('SECOND', {ts})"), F.lit("UTC"))


def utc_day(col: str):
    """'yyyy-MM-dd' of an instant's UTC day (session time zone independent)."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"),
                                    F.floor(F.unix_seconds(F.col(col)) / 86400).cast("int")), "yyyy-MM-dd")


def baseline_edges(baseline: DataFrame, col: str, buckets: int = 10) -> list[float]:
    """Quantile edges of the baseline population: one aggregate, 11 numbers to the driver."""
    return [float(x) for x in quantile_edges(baseline, col, buckets).collect()[0]["edges"]]


def drift_stream(spark: SparkSession, events: DataFrame, value: str, ts: str, edges: list[float],
                 window: str = "1 day", delay: str = "1 hour", base: str | None = None, band=None, root: str | None = None) -> str:
    """T-02: counts by window, risk band and bin with a watermark, appended to Parquet; returns the stream's folder."""
    b = len(edges) - 1
    e = double_array(edges)
    x = F.col(value).cast("double")
    in_range = (x >= F.lit(edges[0])) & (x <= F.lit(edges[-1]))
    bin_ = F.when(in_range, F.size(F.filter(F.slice(e, 1, b), lambda v: v <= x)) - 1)
    root = root or unique_path(spark, "stream-drift", base)
    counts = (events.withColumn("_ts", utc_instant(ts))
                    .withWatermark("_ts", delay)
                    .select(F.window("_ts", window).alias("w"), (band if band is not None else F.lit("")).alias("band"), bin_.alias("bin"))
                    .groupBy("w", "band", "bin")
                    .agg(F.count(F.lit(1)).alias("n"))
                    .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "band", "bin", "n"))
    _finished(counts.writeStream.outputMode("append").format("parquet").option("path", f"{root}/counts")
              .option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start())
    return root


def window_counts(spark: SparkSession, root: str) -> DataFrame:
    """(window_start, window_end, band, bin, n, is_open): the closed windows of the sink, and those that the query still
    holds in its state. A window is in one of them: it leaves the state with the batch that appends it."""
    closed = spark.read.schema("window_start timestamp, window_end timestamp, band string, bin int, n long").parquet(f"{root}/counts")
    state = spark.read.format("statestore").load(f"{root}/_checkpoint")
    key, value = (state.schema[c].dataType.names for c in ("key", "value"))
    w, band, bin_ = (F.col("key")[k] for k in key)
    held = state.select(w["start"].alias("window_start"), w["end"].alias("window_end"), band.alias("band"), bin_.alias("bin"),
                        F.col("value")[value[0]].cast("long").alias("n"))
    return closed.withColumn("is_open", F.lit(False)).unionByName(held.withColumn("is_open", F.lit(True)))


def band_counts(counts: DataFrame) -> DataFrame:
    """(window_start, band, n, is_open): rows of each window by risk band."""
    return counts.groupBy("window_start", "band", "is_open").agg(F.sum("n").alias("n"))


def window_totals(counts: DataFrame, input_rows: int) -> DataFrame:
    """One row: input_rows, window_rows, open_windows, late_rows. Rows that came after their window had closed are in no
    window, so they are those that the windows lack."""
    return counts.agg(F.lit(input_rows).cast("long").alias("input_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("window_rows"),
                      F.count_distinct(F.when(F.col("is_open"), F.col("window_start"))).alias("open_windows")).withColumn(
        "late_rows", F.col("input_rows") - F.col("window_rows"))


def window_psi(counts: DataFrame, baseline: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """PSI of every emitted window against the baseline shares (both floored at 1e-4)."""
    b = len(edges) - 1
    e = double_array(edges)
    x = F.col(value).cast("double")
    in_range = (x >= F.lit(edges[0])) & (x <= F.lit(edges[-1]))
    base_bins = (baseline.select(F.when(in_range, F.size(F.filter(F.slice(e, 1, b), lambda v: v <= x)) - 1).alias("bin"))
                         .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    every = Window.partitionBy(F.lit(1))  # at most 11 rows (bins + out of range)
    expected = (base_bins.withColumn("t", F.sum("n").over(every)).filter(F.col("bin").isNotNull())
                         .select("bin", (F.col("n") / F.col("t")).alias("e_share")))
    tot = counts.groupBy("window_start").agg(F.sum("n").alias("total"), F.bool_or("is_open").alias("is_open"))
    counts = counts.groupBy("window_start", "bin").agg(F.sum("n").alias("n"))
    dense = tot.select("window_start", "total", F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("bin"))
    shares = (dense.join(counts.filter(F.col("bin").isNotNull()), ["window_start", "bin"], "left")
                   .join(F.broadcast(expected), "bin", "left")
                   .select("window_start", "bin",
                           F.greatest(F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)), F.lit(ST.PSI_FLOOR)).alias("a"),
                           F.greatest(F.coalesce("e_share", F.lit(0.0)), F.lit(ST.PSI_FLOOR)).alias("e")))
    psi = shares.groupBy("window_start").agg(F.sum((F.col("e") - F.col("a")) * F.ln(F.col("e") / F.col("a"))).alias("psi"))
    return psi.join(tot, "window_start").withColumn("status", ST.psi_status(F.col("psi")))
