"""Line dedup by content-defined chunks of lines (DataFrame functions only).

A rolling hash over the last ``WINDOW`` line hashes chooses the chunks: a window of lines starts a chunk where its
hash is 0 modulo ``every``. Whether it does depends on the lines of the window alone, so a passage that moves, or whose
surroundings change, is cut at the same places. With ``EVERY`` = 1 each window is a chunk; chunks overlap, and a
repeated passage is covered by its chunks from its first line to its last, however short it is. (Sparser, disjoint
chunks lose most passages of two to five lines, as these seldom hold a whole one.)

A chunk that occurs again anywhere is removed but for its first place (by id, then position), line by line: a line goes
where any chunk that holds it goes. A 64-bit hash of the chunk groups the places, and counting combines map-side. Only
the texts of hashes that occur more than once are compared; where two texts share a hash, the text itself takes part in
the grouping. The table of repeated hashes is written first, so both sides of the join back are plain exchanges, which
adaptive execution splits where a chunk is very frequent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.store import materialize

WINDOW = 2
EVERY = 1
_SIGN = "[^\\\\x09-\\\\x0D\\\\x20]"


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _chunks(text: str, every: int, mask: int, item: str) -> str:
    """SQL: array of ``item`` over the chunks of a text: i (first line), x (text of the chunk) and h (its hash).

    A chunk of blank lines alone is none."""
    window = f"array_join(slice(ls, i + 1, {WINDOW}), '\\n')"
    starts = f"IF(size(ls) < {WINDOW}, CAST(array() AS array<int>), sequence(0, size(ls) - {WINDOW}))"
    found = _let(window, "x", _let(f"xxhash64(x) & {mask}L", "h", f"IF(x RLIKE '{_SIGN}' AND xxhash64(x) % {every} = 0, {item}, NULL)"))
    return _let(f"split({text}, '\\n', -1)", "ls", f"filter(transform({starts}, i -> {found}), y -> y IS NOT NULL)")


def line_dedup(docs: DataFrame, every: int = EVERY, id_col: str = "doc_id", text_col: str = "text",
               hash_bits: int = 64) -> DataFrame:
    """One row per input row: id, n_lines, n_runs (of lines removed), n_removed_lines, kept_text.

    Lines end at ``\\n`` only. Null counts as empty, which is one empty line; texts of one line have no chunk and stay
    whole. Of places with the same id and position (repeated rows) all or none stay; a null id comes before all others.
    An empty table gives an empty result; other columns are not read. ``hash_bits`` below 64 only serves tests."""
    mask = -1 if hash_bits >= 64 else (1 << hash_bits) - 1
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(
        "k", F.xxhash64("id", "text"))
    listed = _chunks("text", every, mask, "named_struct('pos', i, 'h', h)")
    chunks = materialize(rows.select("id", "k", F.expr(listed).alias("cs")).filter("size(cs) > 0"), "op2-chunks")
    places = chunks.select("id", "k", F.explode("cs").alias("c")).select("id", "k", "c.pos", "c.h")
    groups = places.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "pos")).alias("kept"))
    groups = materialize(groups.filter("n > 1").select(F.col("h").alias("gh"), "kept"), "op2-groups")
    again = places.join(groups, F.col("h") == F.col("gh"))
    again = materialize(again.groupBy("id", "k").agg(F.collect_set(F.struct("pos", "h", F.expr(
        "NOT (id <=> kept.id AND pos = kept.pos)").alias("gone"))).alias("again")), "op2-again")
    again = again.select(F.col("id").alias("i2"), F.col("k").alias("k2"), "again")
    found = materialize(rows.join(again, F.expr("id <=> i2 AND k = k2"), "left").select("id", "k", "text", "again"), "op2-found")
    # The texts of repeated hashes, compared whole.
    spelled = _let("split(text, '\\n', -1)", "ls", f"transform(again, a -> named_struct('h', a.h, 'pos', a.pos, 't', array_join(slice(ls, a.pos + 1, {WINDOW}), '\\n')))")
    texts = found.filter("again IS NOT NULL").select("id", "k", F.explode(F.expr(spelled)).alias("c")).select("id", "k", "c.*")
    shared = materialize(texts.select("h", "t").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "op2-shared")
    gone = F.expr("transform(filter(again, a -> a.gone), a -> a.pos)")
    if shared.isEmpty():
        found = found.select("id", "text", gone.alias("gone"))
    else:                                       # chunks whose hash is shared are grouped by their text as well
        told = texts.join(shared, "h", "left_semi")
        first = materialize(told.groupBy("h", "t").agg(F.min(F.struct("id", "pos")).alias("kept")).select(
            F.col("h").alias("gh"), F.col("t").alias("gt"), "kept"), "op2-told")
        told = told.join(first, F.expr("h = gh AND t = gt")).groupBy("id", "k").agg(
            F.collect_set("pos").alias("all"), F.collect_set(F.when(F.expr("NOT (id <=> kept.id AND pos = kept.pos)"), F.col("pos"))).alias("more"))
        told = told.select(F.col("id").alias("i3"), F.col("k").alias("k3"), "all", "more")
        found = found.join(told, F.expr("id <=> i3 AND k = k3"), "left").select(
            "id", "text", F.when(F.col("all").isNull(), gone).otherwise(F.array_union(F.array_except(gone, "all"), "more")).alias("gone"))
    gone = F.coalesce("gone", F.expr("CAST(array() AS array<int>)"))
    found = found.select("id", "text", F.array_sort(F.array_distinct(F.flatten(F.transform(
        gone, lambda p: F.sequence(p, p + (WINDOW - 1)))))).alias("gone"))
    # Rows with nothing removed keep their text as it is.
    left = _let("split(text, '\\n', -1)", "ls", "array_join(transform(array_except(sequence(0, size(ls) - 1), gone), i -> ls[i]), '\\n')")
    return found.select(
        F.col("id").alias(id_col), F.expr("CAST(size(split(text, '\\n', -1)) AS BIGINT)").alias("n_lines"),
        F.expr("CAST(size(filter(gone, (g, i) -> i = 0 OR get(gone, i - 1) <> g - 1)) AS BIGINT)").alias("n_runs"),
        F.size("gone").cast("long").alias("n_removed_lines"),
        F.when(F.size("gone") == 0, F.col("text")).otherwise(F.expr(left)).alias("kept_text"))
