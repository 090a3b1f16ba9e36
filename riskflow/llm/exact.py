"""Exact dedup by deterministic block naming (DataFrame functions only).

1. Normalised texts are cut into blocks of ``block`` code points.
2. Distinct blocks, compared as whole strings, are sorted and numbered.
3. Adjacent numbers are paired, distinct pairs are sorted and numbered, and so on until each
   document has one number. Documents of the same block count with the same number have equal
   texts, and no others: every step numbers distinct values, so nothing rests on a hash being
   free of collisions. (A 64-bit hash of the block is the shuffle and join key; where two
   blocks share a hash, these few blocks are told apart by their text.)

Numbers are dense within ``_BUCKETS`` sorted buckets (rank * buckets + bucket), so no single
task ranks a whole level. A hot group is combined map-side before the shuffle that numbers it;
the joins back have plain exchanges on both sides, which adaptive execution splits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.store import materialize

BLOCK = 4096
_BUCKETS = 4096


def normalise(text: Column) -> Column:
    """Null as empty; every run of ``[\\x20\\x09-\\x0D]`` as one space. (A lone space already is.)"""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _numbered(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``name``: positive integers in sorted order of ``keys`` within hash buckets."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(_BUCKETS))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys)).cast("long")
    return (distinct.withColumn("_bucket", bucket)
            .withColumn("name", (rank - 1) * _BUCKETS + F.col("_bucket") + 1).drop("_bucket"))


def name_blocks(docs: DataFrame, id_col: str, text_col: str, block: int,
                hash_bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows (rid, id, sha, hs) and blocks (rid, id, sha, n, pos, name); ``hash_bits`` below 64 only serves tests."""
    mask = F.lit(-1 if hash_bits >= 64 else (1 << hash_bits) - 1).cast("long")
    norm = docs.select(F.col(id_col).alias("id"), normalise(F.col(text_col)).alias("t"))
    cut = F.regexp_extract_all("t", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    rows = materialize(
        norm.select(F.monotonically_increasing_id().alias("rid"), "id", F.sha2("t", 256).alias("sha"),
                    F.transform(cut, lambda b: F.xxhash64(b).bitwiseAND(mask)).alias("hs")), "op1-rows")
    texts = norm.select(F.explode(cut).alias("b")).select(F.xxhash64("b").bitwiseAND(mask).alias("h"), "b").distinct()
    hashes = materialize(texts.groupBy("h").agg(F.count(F.lit(1)).alias("c")), "op1-hashes")
    flat = rows.select("rid", "id", "sha", F.size("hs").alias("n"), F.posexplode_outer("hs").alias("pos", "h"))
    names = _numbered(hashes.filter("c = 1").select("h"), ["h"])
    shared = hashes.filter("c > 1").select("h")
    if shared.isEmpty():
        return rows, flat.join(names, "h", "left").drop("h")
    # Blocks whose hash is shared: number the texts themselves and match them by text.
    offset = hashes.count() + _BUCKETS * 2
    both = _numbered(texts.join(shared, "h", "left_semi"), ["h", "b"])
    top = names.agg(F.coalesce(F.max("name"), F.lit(0))).first()[0] + offset
    both = both.withColumn("name", F.col("name") + F.lit(top))
    keyed = norm.select(F.sha2("t", 256).alias("sha"), F.posexplode(cut).alias("pos", "b"))
    keyed = (keyed.withColumn("h", F.xxhash64("b").bitwiseAND(mask)).join(both, ["h", "b"])
             .select("sha", "pos", F.col("name").alias("name2")).distinct())
    out = flat.join(names, "h", "left").join(keyed, ["sha", "pos"], "left")
    return rows, out.withColumn("name", F.coalesce("name2", "name")).drop("name2", "h")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK,
               hash_bits: int = 64) -> DataFrame:
    """(rid, id, sha, n, name): one row per input row; equal (n, name) if and only if equal texts.

    Empty and null texts have n = 0 and name = 0."""
    rows, named = name_blocks(docs, id_col, text_col, block, hash_bits)
    level = materialize(named.select("rid", "n", F.col("n").alias("left"), "pos", "name"), "op1-level0")
    most = level.agg(F.max("n")).first()[0] or 0
    done = level.filter("left <= 1").select("rid", "n", F.coalesce("name", F.lit(0).cast("long")).alias("name"))
    for k in range(math.ceil(math.log2(most)) if most > 1 else 0):
        pairs = (level.filter("left > 1").groupBy("rid", "n", "left", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
                 .agg(F.max(F.expr("CASE WHEN pos % 2 = 0 THEN name END")).alias("a"),
                      F.coalesce(F.max(F.expr("CASE WHEN pos % 2 = 1 THEN name END")), F.lit(0)).alias("b")))
        pairs = materialize(pairs, f"op1-pairs{k}")
        names = _numbered(pairs.select("a", "b").distinct(), ["a", "b"])
        level = pairs.join(names, ["a", "b"]).select(
            "rid", "n", F.ceil(F.col("left") / 2).cast("int").alias("left"), "pos", "name")
        level = materialize(level, f"op1-level{k + 1}")
        done = done.unionByName(level.filter("left <= 1").select("rid", "n", "name"))
    return rows.select("rid", "id", "sha").join(done, "rid")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK,
                hash_bits: int = 64) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    * Texts are equal when equal after ``normalise``; null counts as empty, and empty texts are one group.
    * The row of the smallest id of a group stays. Repeated rows with that same id are one document: all
      are marked kept, and each counts in ``group_size``. A null id never is the smallest unless all are
      null; then such rows are kept.
    * An empty table gives an empty result; further columns of ``docs`` are not read."""
    ids = materialize(identities(docs, id_col, text_col, block, hash_bits), "op1-ids")
    groups = ids.groupBy("n", "name").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return ids.join(groups, ["n", "name"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"))
