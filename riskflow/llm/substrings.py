"""Substring dedup by level-wise doubling of repeated word windows.

A window of ``length`` words can only be repeated if every shorter window inside it is. The levels
are a quarter, a half and the whole of ``length`` (9, 18, 35); only windows repeated at one level
are extended to the next:

* First level. A 35-word window holds 27 windows of 9 words; the one of the least fingerprint is
  its anchor. Equal windows have equal anchors, so a window whose anchor occurs once in the corpus
  cannot be repeated. Each document has some 2/28 anchors a word, and only these are counted.
* Second level. The windows left take an 18-word anchor in the same way.
* Last level. The windows left are counted themselves (two 64-bit fingerprints side by side). Of a
  fingerprint seen once, the aggregate itself keeps the place, so no join back is needed: what is
  not a single is repeated.

Counting combines map-side, so a passage that a third of all documents share is a few rows a task;
the one join back to places (first level) has plain exchanges that adaptive execution splits.
Equality of windows rests on two 64-bit fingerprints, 128 bits together; an equal anchor of a shorter
level alone never removes a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.store import materialize
from riskflow.llm.tokens import SLICE_BYTES, SPACED, Words, int_list, long_list, slices

LENGTH = 35


def levels(length: int) -> tuple[int, int]:
    return max(1, -(-length // 4)), max(1, -(-length // 2))


def anchors(words: Words, gram: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts of the batch, the word number of each window's anchor, and all gram fingerprints."""
    at, _ = words.windows(length)
    grams = words.window_hash(gram) if len(words.hash) >= gram else np.zeros(0, np.uint64)
    if not len(at):
        return at, at, grams
    span = length - gram + 1
    least = np.empty(len(grams) - span + 1, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    for i in range(0, len(view), 1 << 16):
        least[i:i + (1 << 16)] = view[i:i + (1 << 16)].argmin(axis=1)
    return at, at + least[at], grams


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k, text): a row is known by its id and a hash of id and text, so null and repeated ids do no harm."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("k"), text.alias("text"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstd frames: what is joined with its anchors later is shuffled at less than half its size."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [press.compress(t.as_buffer()) for t in batch["text"].cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch["id"], batch["k"], pa.array(packed, pa.binary())], names=["id", "k", "z"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices of packed batches with their words."""
    press = zstandard.ZstdDecompressor()
    for batch in slices(batches, "z", SLICE_BYTES // 3):
        texts = pa.array([press.decompress(z.as_buffer()) for z in batch["z"]], pa.large_binary())
        yield batch, Words(texts.cast(pa.large_string()), SPACED, lower=False)


def _kept(words: Words, keep: np.ndarray | None = None) -> list[bytes]:
    """The words of each document joined by one space; ``keep`` marks the words that stay, by default all."""
    out = []
    for d in range(len(words.first) - 1):
        body = words.data[words.offsets[d]:words.offsets[d + 1]].tobytes().split()
        out.append(b" ".join(body if keep is None else compress(body, keep[words.first[d]:words.first[d + 1]].tolist())))
    return out


def _first_level(length: int):
    gram, _ = levels(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch["text"], SPACED, lower=False)
            _, anchor, grams = anchors(words, gram, length)
            anchor = anchor[np.flatnonzero(np.diff(anchor, prepend=-1))]
            offs = np.searchsorted(anchor, words.first)
            doc = np.searchsorted(words.first, anchor, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["k"], pa.array(words.counts.astype(np.int64)),
                 pa.array([hashlib.sha256(b).hexdigest() for b in _kept(words)], pa.string()),
                 long_list(grams[anchor], offs), int_list(anchor - words.first[doc], offs)],
                names=["id", "k", "n_words", "sha", "h", "pos"])
    return run


class Candidates(NamedTuple):
    """Windows whose first-level anchor is repeated; ``first`` and ``half_first`` are offsets by document."""

    start: np.ndarray        # word number of the window
    first: np.ndarray
    half: np.ndarray         # word number of each distinct second-level anchor
    half_first: np.ndarray
    which: np.ndarray        # the window's second-level anchor, numbered within the document
    grams: np.ndarray        # second-level fingerprints by word number


def candidates(words: Words, marked: pa.ListArray, length: int) -> Candidates:
    gram, half = levels(length)
    at, anchor, _ = anchors(words, gram, length)
    _, second, grams = anchors(words, half, length)
    good = np.zeros(len(words.hash) + 1, bool)
    good[np.repeat(words.first[:-1], np.diff(marked.offsets.to_numpy())) + marked.flatten().to_numpy()] = True
    at, second = at[good[anchor]], second[good[anchor]]
    new = np.diff(second, prepend=-1) != 0
    half_first = np.searchsorted(second[new], words.first)
    doc = np.searchsorted(words.first, at, "right") - 1
    return Candidates(at, np.searchsorted(at, words.first), second[new], half_first,
                      np.cumsum(new) - 1 - half_first[doc], grams)


def _second_level(length: int):
    """(rid, i, w): fingerprints of the second-level anchors, numbered by i within a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _unpack(batches):
            c = candidates(words, batch["pos"], length)
            size = np.diff(c.half_first)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(batch["rid"].to_numpy(), size)),
                pa.array((np.arange(len(c.half)) - np.repeat(c.half_first[:-1], size)).astype(np.int32)),
                pa.array(c.grams[c.half].view(np.int64))], names=["rid", "i", "w"])
    return run


def _listed(column: pa.ListArray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Mask over ``size`` flat places of those that a list column names within each row; null names none."""
    out = np.zeros(size, bool)
    sizes = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    out[np.repeat(offsets[:-1], sizes) + pc.list_flatten(column).to_numpy()] = True
    return out


def _left(c: Candidates, half_single: pa.ListArray) -> np.ndarray:
    """Mask of the candidates whose second-level anchor is repeated."""
    single = _listed(half_single, c.half_first, len(c.half))
    return ~single[c.which + np.repeat(c.half_first[:-1], np.diff(c.first))]


def _last_level(length: int):
    """(rid, i, w, x): both fingerprints of the windows left after the second level."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _unpack(batches):
            c = candidates(words, batch["pos"], length)
            left = np.flatnonzero(_left(c, batch["half_single"]))
            if not len(left):
                continue
            size = np.diff(c.first)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(batch["rid"].to_numpy(), size)[left]),
                pa.array((left - np.repeat(c.first[:-1], size)[left]).astype(np.int32)),
                *[pa.array(words.window_hash(length, second)[c.start[left]].view(np.int64)) for second in (False, True)],
            ], names=["rid", "i", "w", "x"])
    return run


def _removal(length: int, text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _unpack(batches):
            c = candidates(words, batch["pos"], length)
            start = c.start[_left(c, batch["half_single"]) & ~_listed(batch["single"], c.first, len(c.start))]
            n = len(words.hash)
            gone = np.bincount(start, minlength=n + 1)[:n + 1] - np.bincount(start + length, minlength=n + 1)[:n + 1]
            keep = np.cumsum(gone)[:n] == 0
            kept = np.concatenate([[0], np.cumsum(keep)])
            removed = words.counts - (kept[words.first[1:]] - kept[words.first[:-1]])
            bodies = _kept(words, keep)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["k"], pa.array(removed.astype(np.int64)),
                 pa.array([hashlib.sha256(b).hexdigest() for b in bodies], pa.string()),
                 pa.array([b.decode() if text else None for b in bodies], pa.string())],
                names=["id", "k", "n_removed", "sha2", "kept_text"])
    return run


def substring_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                    with_text: bool = False) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256 (and kept_text: the kept words joined by one space;
    null where nothing was removed).

    A word goes if a window of ``length`` words over it also starts anywhere else, in the same or another row;
    windows are judged on the input. Null and empty texts have no words. Repeated rows are separate places, so
    each loses the windows they share. An empty table gives an empty result; other columns are not read."""
    id_type = docs.schema[id_col].dataType.simpleString()
    keyed = _row_key(docs, id_col, text_col)
    first = keyed.mapInArrow(_first_level(length), f"id {id_type}, k long, n_words long, sha string, "
                                                   "h array<long>, pos array<int>")
    first = materialize(first.withColumn("rid", F.monotonically_increasing_id()), "op4-anchors")
    places = first.select("rid", F.explode(F.arrays_zip("h", "pos")).alias("a")).select("rid", "a.h", "a.pos")
    repeated = places.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h")
    marked = places.join(repeated, "h").groupBy("rid").agg(F.collect_list("pos").alias("pos"))
    marked = first.select("rid", "id", "k").join(marked, "rid").groupBy("id", "k").agg(F.any_value("pos").alias("pos"))
    packed = keyed.mapInArrow(_pack, f"id {id_type}, k long, z binary")
    rows = packed.join(marked.withColumnsRenamed({"id": "id2", "k": "k2"}), F.expr("k = k2 AND id <=> id2")).select(
        F.monotonically_increasing_id().alias("rid"), "id", "k", "z", "pos")
    rows = materialize(rows, "op4-rows")
    half_single = _singles(rows.mapInArrow(_second_level(length), "rid long, i int, w long"), ["w"])
    half_single = half_single.withColumnRenamed("single", "half_single")
    last = rows.select("rid", "z", "pos").join(half_single, "rid", "left").mapInArrow(
        _last_level(length), "rid long, i int, w long, x long")
    final = (rows.join(half_single.join(_singles(last, ["w", "x"]), "rid", "full"), "rid", "left")
             .select("id", "k", "z", "pos", "half_single", "single")
             .mapInArrow(_removal(length, with_text),
                         f"id2 {id_type}, k2 long, n_removed long, sha2 string, kept_text string"))
    out = first.select("id", "k", "n_words", "sha").join(final.distinct(), F.expr("k = k2 AND id <=> id2"), "left")
    cols = [F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
            F.coalesce("sha2", "sha").alias("kept_sha256")]
    return out.select(*cols, *(["kept_text"] if with_text else []))


def _singles(rows: DataFrame, value: list[str]) -> DataFrame:
    """(rid, single): indexes i, in order, of the values of a row that occur once in all rows."""
    once = rows.groupBy(*value).agg(F.count(F.lit(1)).alias("c"), F.min("rid").alias("rid"), F.min("i").alias("i"))
    return once.filter("c = 1").groupBy("rid").agg(F.array_sort(F.collect_list("i")).alias("single"))
