"""Ranked lexical search over a length-stratified index.

Documents of one length normaliser m form a stratum. Their postings are grouped by term and, within a term, by
term frequency, so the impact of a group is computed once for all its documents. The largest frequency of each
term bounds what any document of the stratum can score:

1. one pass over the texts gives each document its length and the frequencies of the query terms;
2. N, L, the document frequencies and with them m and the term weights come from that table;
3. the documents are dealt by range over (m, hash of the id), so a stratum that holds a large share of all
   documents is spread over many tasks, and are written as blocks of at most ``BLOCK`` documents of one m;
4. for each item, the ``SEEDS`` blocks of the highest bound are visited first; the score of the k-th best
   document found there is the item's threshold;
5. all other blocks are visited in the order of their bounds, as far as a bound reaches the threshold.

A bound below the threshold leaves out no result, and a bound equal to it is visited, so the ranking is exact.
Terms are told apart by 64-bit fingerprints. Items are searched in shards of about ``SHARD_TERMS`` terms: only one
shard's terms, weights and thresholds are held by a task at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.llm.store import materialize
from riskflow.llm.tokens import ALNUM, Words, int_list, slices

BLOCK = 1024
SEEDS = 4
SHARD_TERMS = 2_000_000
# Fixed values of the score.
WEIGHT_SCALE, IMPACT_SCALE, TF_SCALE, M_SCALE, M_BASE, M_LENGTH = 1000, 1_000_000_000, 1000, 8, 10, 90


@dataclass
class Shard:
    """Terms of a shard's items: ``terms`` sorted fingerprints; item i has the term numbers ``of[first[i]:first[i + 1]]``."""
    terms: np.ndarray
    first: np.ndarray
    of: np.ndarray

    def weigh(self, weights: np.ndarray) -> None:
        self.weight = weights
        self.owner = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, terms): distinct term fingerprints of each row of ``items`` that has a term."""
    schema = T.StructType([T.StructField("item", items.schema[item_col].dataType),
                           T.StructField("terms", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch["text"], ALNUM, True)
            parts = [np.unique(words.hash[words.first[i]:words.first[i + 1]]).view(np.int64) for i in range(batch.num_rows)]
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            terms = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
            yield pa.RecordBatch.from_arrays([batch["item"], terms], names=["item", "terms"])

    found = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return found.filter("size(terms) > 0").withColumn("item_no", F.monotonically_increasing_id())


def postings(docs: DataFrame, terms: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) of every row: its length in terms and the frequencies of the given terms (their numbers)."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()),
                           T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch["text"], ALNUM, True)
            at = np.minimum(np.searchsorted(terms, words.hash), len(terms) - 1)
            hit = terms[at] == words.hash
            key, tf = np.unique(words.doc()[hit] * len(terms) + at[hit], return_counts=True)
            ends = np.searchsorted(key, np.arange(batch.num_rows + 1) * len(terms))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(words.counts.astype(np.int64)), int_list(key % len(terms), ends), int_list(tf, ends)],
                names=["id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def index_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Index of rows (id, m, terms, tfs): one row per block of documents of one m.

    block: number; m; docs: ids by ascending id; of each group of postings, by term, then frequency: term, tf and
    number of documents (group_term, group_tf, group_size); places: positions in docs, group after group."""
    id_type = rows.schema["id"].dataType
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("m", T.LongType()), T.StructField("docs", T.ArrayType(id_type)),
                           *[T.StructField(c, ints) for c in ("group_term", "group_tf", "group_size", "places")]])
    dealt = (rows.withColumn("_deal", F.xxhash64("id", "terms")).repartitionByRange("m", "_deal")
             .sortWithinPartitions("m", F.col("id").asc_nulls_last()).select("id", "m", "terms", "tfs"))

    def build(part: pa.Table) -> pa.RecordBatch:
        size = part.num_rows
        terms, tfs = part["terms"].combine_chunks(), part["tfs"].combine_chunks()
        doc = np.repeat(np.arange(size), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
        term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
        order = np.lexsort((doc, tf, term))
        doc, term, tf = doc[order], term[order], tf[order]
        new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])])
        one = [0, len(new)]
        ids = part["id"].combine_chunks()
        return pa.RecordBatch.from_arrays(
            [pa.array([part["m"][0].as_py()], pa.int64()), pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), ids),
             int_list(term[new], np.array(one)), int_list(tf[new], np.array(one)),
             int_list(np.diff(np.r_[new, len(doc)]), np.array(one)), int_list(doc, np.array([0, len(doc)]))],
            names=[f.name for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, m = [], 0, None
        for batch in batches:
            ms = batch["m"].to_numpy()
            cuts = [0, *(np.flatnonzero(ms[1:] != ms[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                while a < b:
                    if size and (ms[a] != m or size == block):
                        yield build(pa.Table.from_batches(held))
                        held, size = [], 0
                    take = min(b - a, block - size)
                    held.append(batch.slice(a, take))
                    size, m, a = size + take, ms[a], a + take
        if size:
            yield build(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, schema).select(F.monotonically_increasing_id().alias("block"), "*")


def _impact(tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return IMPACT_SCALE * tf // (TF_SCALE * tf + M_SCALE * m)


def _bounds(shard: Shard, m: int, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """For each item, what no document of the block scores more than: all its terms at their largest frequency."""
    last = np.flatnonzero(np.r_[term[1:] != term[:-1], True]) if len(term) else np.zeros(0, np.int64)
    most = np.zeros(len(shard.terms), np.int64)
    most[term[last]] = shard.weight[term[last]] * _impact(tf[last], m)
    gains = most[shard.of]
    sums = np.r_[0, np.cumsum(gains)]
    return sums[shard.first[1:]] - sums[shard.first[:-1]]


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _best_blocks(index: DataFrame, shard: Shard, seeds: int) -> DataFrame:
    """(item, block) of the ``seeds`` blocks of the highest bound of each item; lower numbers first among equals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = batch["block"].to_numpy()
            each = zip(batch["m"].to_pylist(), _lists(batch["group_term"]), _lists(batch["group_tf"]), strict=True)
            bounds = np.stack([_bounds(shard, m, term, tf) for m, term, tf in each])      # [block, item]
            top = np.argsort(-bounds, axis=0, kind="stable")[:seeds]
            value = np.take_along_axis(bounds, top, axis=0)
            item = np.broadcast_to(np.arange(bounds.shape[1]), top.shape)
            some = value > 0
            yield pa.RecordBatch.from_arrays([pa.array(item[some].astype(np.int32)), pa.array(blocks[top[some]]),
                                              pa.array(value[some])], names=["item", "block", "bound"])

    found = index.select("block", "m", "group_term", "group_tf").mapInArrow(run, "item int, block long, bound long")
    by = Window.partitionBy("item").orderBy(F.desc("bound"), "block")
    return found.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= seeds).select("item", "block")


def _visit(index: DataFrame, shard: Shard, least: np.ndarray, k: int, only: DataFrame | None = None) -> DataFrame:
    """(item, id, score) of documents that may be among the k best: at most k of a block for an item.

    ``least``: the score that an item's documents must reach. Within a batch of blocks, an item visits them in the
    order of their bounds and stops where a bound is below the k-th best score known."""
    id_type = index.schema["docs"].dataType.elementType
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("id", id_type), T.StructField("score", T.LongType())])
    chosen = index.join(F.broadcast(only), "block", "left_semi") if only is not None else index

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[] for _ in range(len(shard.first) - 1)]             # up to k best scores of each item, ascending
        floor = least.copy()
        for batch in batches:
            if not batch.num_rows:
                continue
            ms = batch["m"].to_pylist()
            cols = [_lists(batch[c]) for c in ("group_term", "group_tf", "group_size", "places")]
            counts = pc.list_value_length(batch["docs"]).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.r_[0, np.cumsum(counts)]
            bounds = np.stack([_bounds(shard, m, t, f) for m, t, f in zip(ms, *cols[:2], strict=True)])
            impacts: list = [None] * len(ms)
            items, at, scores = [], [], []
            for i in np.flatnonzero((bounds >= floor).any(axis=0) & (bounds.max(axis=0) > 0)):
                own = shard.of[shard.first[i]:shard.first[i + 1]]
                for b in np.argsort(-bounds[:, i], kind="stable"):
                    if bounds[b, i] < floor[i] or not bounds[b, i]:
                        break
                    if impacts[b] is None:                           # once per (term, tf) of the block, for all items
                        term, tf, size, _ = (c[b] for c in cols)
                        impacts[b] = shard.weight[term] * _impact(tf, ms[b]), np.r_[0, np.cumsum(size)]
                    gain, ends = impacts[b]
                    term, places = cols[0][b], cols[3][b]
                    lo, hi = np.searchsorted(term, own), np.searchsorted(term, own, "right")
                    some = lo < hi
                    lo, hi = lo[some], hi[some]
                    n = (ends[hi] - ends[lo])
                    spots = np.repeat(ends[lo] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    groups = np.repeat(lo - np.r_[0, np.cumsum(hi - lo)[:-1]], hi - lo) + np.arange((hi - lo).sum())
                    score = np.zeros(counts[b], np.int64)
                    np.add.at(score, places[spots], np.repeat(gain[groups], ends[groups + 1] - ends[groups]))
                    top = np.flatnonzero(score >= max(floor[i], 1))
                    top = top[np.argsort(-score[top], kind="stable")][:k]     # equal scores by ascending id
                    if len(top):
                        items.append(np.full(len(top), i, np.int32))
                        at.append(starts[b] + top)
                        scores.append(score[top])
                        best[i] = sorted([*best[i], *score[top].tolist()])[-k:]
                        if len(best[i]) == k:
                            floor[i] = max(floor[i], best[i][0])
            if items:
                items, at, scores = np.concatenate(items), np.concatenate(at), np.concatenate(scores)
                keep = scores >= floor[items]
                yield pa.RecordBatch.from_arrays([pa.array(items[keep]), batch["docs"].flatten().take(pa.array(at[keep])),
                                                  pa.array(scores[keep])], names=["item", "id", "score"])

    return chosen.select("m", "docs", "group_term", "group_tf", "group_size", "places").mapInArrow(run, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _search_shard(docs: DataFrame, part: DataFrame, k: int, id_col: str, text_col: str, block: int, seeds: int) -> DataFrame:
    rows = part.orderBy("item_no").collect()                         # one shard: about SHARD_TERMS terms
    flat = np.concatenate([np.asarray(r.terms, np.int64).view(np.uint64) for r in rows])
    terms, of = np.unique(flat, return_inverse=True)
    shard = Shard(terms, np.r_[0, np.cumsum([len(r.terms) for r in rows])], of)
    order = np.lexsort((shard.of, np.repeat(np.arange(len(rows)), np.diff(shard.first))))
    shard.of = shard.of[order]                                       # term numbers of an item ascend
    texts = materialize(postings(docs, terms, id_col, text_col), "op12-postings")
    total = texts.filter("n > 0").agg(F.count(F.lit(1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    df = texts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    weights = np.zeros(len(terms), np.int64)
    for r in df.select("t", F.floor(F.lit(float(WEIGHT_SCALE)) * F.log((F.lit(2.0) * total.N + 2) / (F.lit(2.0) * F.col("df") + 1)))
                       .cast("long").alias("w")).collect():
        weights[r.t] = r.w
    shard.weigh(weights)
    m = F.expr(f"{M_BASE}L + ({M_LENGTH}L * n * {total.N}L) div {max(total.L, 1)}L")
    index = materialize(index_blocks(texts.filter("size(terms) > 0").select("id", m.alias("m"), "terms", "tfs"), block), "op12-index")
    least = np.zeros(len(rows), np.int64)
    if seeds:
        only = _best_blocks(index, shard, seeds).select("block").distinct()       # at most seeds a item of the shard
        first = _ranked(_visit(index, shard, least, k, only), k).filter(F.col("rank") == k)
        for r in first.select("item", "score").collect():
            least[r.item] = r.score
    spark = docs.sparkSession
    names = spark.createDataFrame([(i, r.item) for i, r in enumerate(rows)],
                                  T.StructType([T.StructField("item", T.IntegerType()), T.StructField("_name", part.schema["item"].dataType)]))
    found = _ranked(_visit(index, shard, least, k), k)
    return found.join(F.broadcast(names), "item").select(F.col("_name").alias("item"), "rank", "id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", block: int = BLOCK, seeds: int = SEEDS, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(item, rank, id, score): the k documents of the highest score above 0 of each row of ``items``.

    Equal scores rank by ascending id; a null id comes last. Null, empty and termless texts match nothing and count
    in neither N nor L. Each row is a document or an item of its own: repeated documents rank one after another,
    repeated items have equal results each. Empty tables give an empty result; further columns are not read."""
    asked = materialize(_item_terms(items, item_col, item_text_col), "op12-items")
    words = asked.agg(F.sum(F.size("terms").cast("long"))).first()[0] or 0
    schema = T.StructType([T.StructField(item_col, items.schema[item_col].dataType), T.StructField("rank", T.IntegerType()),
                           T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.LongType())])
    if not words:
        return docs.sparkSession.createDataFrame([], schema)
    shards, out = math.ceil(words / shard_terms), None
    for s in range(shards):
        part = asked.filter(F.pmod(F.xxhash64("item_no"), F.lit(shards)) == s) if shards > 1 else asked
        if part.isEmpty():
            continue
        found = _search_shard(docs, part, k, id_col, text_col, block, seeds).toDF(*schema.names)
        found = materialize(found, "op12-found") if shards > 1 else found
        out = found if out is None else out.unionByName(found)
    return out
