"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton of one shard of items (``shard_words`` words at most, or one longer item) is built once
and broadcast; a larger benchmark is matched shard by shard, each broadcast within that bound, and the
hits are merged. Items are cut into words and hashed in tasks; the driver sees the word hashes of one
shard at a time. Training tokens are streamed through the automaton and the longest matching length is
tracked. A match is removed where it exceeds the length limit (``window`` words) or the coverage limit
(``coverage`` of the words of an item, the whole of it by default). Tokens outside every
item bigram cannot be inside such a match, so runs of known bigrams (found with numpy) are all that
the automaton walks over. There is no shuffle: each document is read where it lies.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm.store import id_schema, materialize
from riskflow.llm.tokens import ALNUM, Words, long_list, slices

WINDOW = 10
COVERAGE = 1.0
SHARD_WORDS = 1_000_000


def least_match(n: int, window: int, coverage: float) -> int:
    """Words of an item of ``n`` words that a match must have to be removed."""
    return min(window, max(1, math.ceil(coverage * n - 1e-9))) if n else 0


class ItemAutomaton:
    """Generalised suffix automaton over word numbers, with the items of each window state."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int, coverage: float = 1.0):
        self.window = window
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set[str]] = [set()]
        self.whole: dict[int, set[str]] = {}
        for name, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
                if self.length[last] >= window:
                    self.items[last].add(name)
            least = least_match(len(words), window, coverage)
            for i in range(len(words) - least + 1 if 0 < least < window else 0):
                state = 0                   # runs that the coverage limit removes end in a state of their own
                for w in words[i:i + least]:
                    state = self._extend(state, w)
                self.whole.setdefault(state, set()).add(name)
        self._finish()

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        self.items.append(set())
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """State for the suffixes of q that are one word longer than p."""
        clone = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.step[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _finish(self) -> None:
        by_length = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for v in reversed(by_length):       # end positions of a state are those of its subtree
            if self.items[v] and self.length[self.link[v]] >= self.window:
                self.items[self.link[v]] |= self.items[v]
        self.short = [-1] * len(self.length)  # nearest suffix state, itself included, that ends a short item
        for v in by_length:
            self.short[v] = v if v in self.whole else self.short[self.link[v]] if self.link[v] >= 0 else -1

    def walk(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Matched word ranges, their items and the longest match of one token run."""
        state, matched, longest, spans, found = 0, 0, 0, [], set()
        for i, w in enumerate(words):
            while state and w not in self.step[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.step[state]:
                state, matched = self.step[state][w], matched + 1
            else:
                matched = 0
            longest = max(longest, matched)
            if matched >= self.window:
                v = state
                while self.length[self.link[v]] >= self.window:
                    v = self.link[v]
                found |= self.items[v]
                spans.append((i + 1 - self.window, i + 1))
            u = self.short[state] if matched >= self.length[state] else self.short[self.link[state]] if state else -1
            while u > 0:
                found |= self.whole[u]
                spans.append((i + 1 - self.length[u], i + 1))
                u = self.short[self.link[u]]
        return spans, found, longest


class Matcher:
    """Automaton of a shard, with the vocabulary and bigrams that select the runs to walk."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int, coverage: float = 1.0):
        every = np.concatenate([h for _, h in items]) if items else np.zeros(0, np.uint64)
        self.vocab = np.unique(every)
        numbered = [(name, np.searchsorted(self.vocab, h).tolist()) for name, h in items]
        self.least = min([window, *(least_match(len(w), window, coverage) for _, w in numbered if w)])
        size = len(self.vocab)
        self.bigrams = np.unique(np.array([a * size + b for _, w in numbered for a, b in zip(w, w[1:])], np.int64))
        self.automaton = ItemAutomaton([x for x in numbered if x[1]], window, coverage)

    def runs(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers, and begin and end of the maximal runs of known bigrams of ``least`` words or more."""
        if not len(hashes) or not len(self.vocab):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        known = self.vocab[ids] == hashes
        joined = known[:-1] & known[1:]
        at = np.flatnonzero(joined)
        pair = ids[at] * len(self.vocab) + ids[at + 1]
        if len(self.bigrams):
            joined[at] = self.bigrams[np.minimum(np.searchsorted(self.bigrams, pair), len(self.bigrams) - 1)] == pair
        else:
            joined[:] = False
        edge = first[(first > 0) & (first < len(hashes))]
        joined[edge - 1] = False
        before, after = np.concatenate([[False], joined]), np.concatenate([joined, [False]])
        begin, end = np.flatnonzero(known & ~before), np.flatnonzero(known & ~after) + 1
        keep = end - begin >= self.least
        return ids, begin[keep], end[keep]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _match(batches: Iterator[pa.RecordBatch], matcher: Matcher, last: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words = Words(batch["text"], ALNUM, lower=True)
        ids, begin, end = matcher.runs(words.hash, words.first)
        spans = [[(x["start"], x["end"]) for x in h] for h in batch["hits"].to_pylist()]
        items = [set(x) for x in batch["items"].to_pylist()]
        longest = batch["longest"].to_pylist()
        docs = np.searchsorted(words.first, begin, "right") - 1
        for d, b, e in zip(docs.tolist(), begin.tolist(), end.tolist()):
            got, found, most = matcher.automaton.walk(ids[b:e].tolist())
            b -= int(words.first[d])
            spans[d] += [(s + b, t + b) for s, t in got]
            items[d] |= found
            longest[d] = max(longest[d], most)
        spans = [_merged(s) for s in spans]
        hits = pa.array([[{"start": s, "end": t} for s, t in x] for x in spans], _HITS)
        kept = batch["text"]
        if last and any(spans):             # the text without the matched spans
            data, texts = words.data, kept.to_pylist()
            for d, found in enumerate(spans):
                if found:
                    f, at, parts = int(words.first[d]), int(words.offsets[d]), []
                    for s, t in found:
                        parts.append(data[at:words.start[f + s]].tobytes())
                        at = int(words.end[f + t - 1])
                    texts[d] = (b"".join(parts) + data[at:words.offsets[d + 1]].tobytes()).decode()
            kept = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch["id"], batch["text"].cast(pa.string()), pa.array(words.counts.astype(np.int64)), hits,
             pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(longest, pa.int32()),
             kept.cast(pa.string())],
            names=["id", "text", "n_words", "hits", "items", "longest", "clean_text"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "t"):
        words = Words(batch["t"], ALNUM, lower=True)
        yield pa.RecordBatch.from_arrays([batch["i"], long_list(words.hash, words.first)], names=["i", "h"])


def _shards(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, np.ndarray]]]:
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    shard, size = [], 0
    for row in materialize(items.mapInArrow(_hashed, "i string, h array<long>"), "op6-items").toLocalIterator():
        h = np.asarray(row["h"], np.int64).view(np.uint64)
        if shard and size + len(h) > limit:
            yield shard
            shard, size = [], 0
        shard.append((row["i"], h))
        size += len(h)
    yield shard


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  shard_words: int = SHARD_WORDS, coverage: float = COVERAGE, most_covered: float = 1.0) -> DataFrame:
    """One row per input row: id, n_words, hits (word ranges), items (sorted ids), longest (match length in words,
    at least where ``window`` is reached), covered (share of the words hit, 0 without words) and clean_text (the text
    without the matched ranges; null where ``covered`` is above ``most_covered``, as the whole document goes then).

    A run of words is hit where it is ``window`` words of an item long, or ``coverage`` of an item's words (rounded up).

    Null or empty texts have no words and no hits; clean_text keeps null. Repeated documents are matched each for
    itself, repeated items count once per id, a null item id counts as the empty string. An item without words
    never matches; an empty benchmark matches nothing. Further columns of either table are not read."""
    spark = docs.sparkSession
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                      F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("hits"),
                      F.expr("CAST(array() AS array<string>)").alias("items"), F.lit(0).alias("longest"))
    shards = _shards(benchmark, item_col, item_text_col, shard_words)
    shard, k = next(shards), 0
    while shard is not None:
        following = next(shards, None)
        sent, last = spark.sparkContext.broadcast(cloudpickle.dumps(Matcher(shard, window, coverage))), following is None

        def match(batches, sent=sent, last=last):
            return _match(batches, pickle.loads(sent.value), last)

        out = out.mapInArrow(match, id_schema(docs, id_col, "text string, n_words long, hits array<struct<start:int,end:int>>, "
                                                            "items array<string>, longest int, clean_text string"))
        if not last:                        # one broadcast automaton at a time
            out = materialize(out, f"op6-shard{k}")
        shard, k = following, k + 1
    covered = F.when(F.col("n_words") > 0, n_hit() / F.col("n_words")).otherwise(0.0)
    return out.select(F.col("id").alias(id_col), "n_words", "hits", "items", "longest", covered.alias("covered"),
                      F.when(covered <= most_covered, F.col("clean_text")).alias("clean_text"))


def n_hit() -> Column:
    """Words within ``hits``."""
    return F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + (h["end"] - h["start"]).cast("long"))


def digest(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counted form: id, n_words, n_hit, n_items, items_sha256, contaminated, longest."""
    hit = n_hit()
    return result.select(id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
                         (hit > 0).alias("contaminated"), "longest")
