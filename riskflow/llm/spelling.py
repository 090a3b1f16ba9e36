"""Spelling variants by Bloom-guided neighbourhoods.

1. Words are counted: within a batch of texts first, then by Spark.
2. The vocabulary is dealt into shards by word length and hash, of about ``SHARD_WORDS`` words each, and each shard
   becomes a blocked Bloom filter: a key sets one bit in each of the eight 64-bit words of one block.
3. Each word generates its edits (every deletion; at every place every larger letter of the alphabet in use, since
   the smaller one is found from the other side) and probes the filter of the edit's length and hash. Filters are
   broadcast in passes of at most ``PASS_BYTES``, whatever the size of the vocabulary.
4. Only the positives shuffle: they meet the vocabulary by hash, and the edit spelled out must equal the word found.
   That leaves no false positive, and a Bloom filter has no false negative.
5. Each word takes the most frequent neighbour as its form where that is frequent enough, and forms are followed to
   their root by pointer doubling.

All letters of a word are below U+0100, so a word is one byte a code point in Latin-1, and the words of one length
are a matrix whose edits are hashed column by column.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.store import materialize
from riskflow.llm.tokens import mix, slices, text_buffer

LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 7, 2, 10
#: A run loses a code point where the crc32 of ``<id>:<run>`` is a multiple of this.
DROP_EVERY = 31
SHARD_WORDS, BITS_A_WORD, PASS_BYTES = 1 << 16, 16, 1 << 27
_HELD, _CHUNK, _SHORT = 1 << 19, 1 << 18, 48
_BLOCK = 8                                  # 64-bit words
_VALUES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def _flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of all ranges, one after another."""
    return np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


def _crcs(prefix: np.ndarray, data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """crc32 of each word data[first[i]:first[i + 1]] after a prefix of that crc32."""
    size = np.diff(first)
    out = prefix.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-size, kind="stable")
    n_long = int((size > _SHORT).sum())
    for i in order[:n_long]:
        out[i] = zlib.crc32(data[first[i]:first[i + 1]].tobytes(), int(prefix[i])) ^ 0xFFFFFFFF
    order = order[n_long:]
    state, at, left = out[order], first[:-1][order], size[order]
    for j in range(int(left.max(initial=0))):
        k = int(np.searchsorted(-left, -j, "left"))          # words of more than j bytes come first
        state[:k] = _CRC[(state[:k] ^ data[at[:k] + j]) & np.uint32(255)] ^ (state[:k] >> np.uint32(8))
    out[order] = state
    return out ^ np.uint32(0xFFFFFFFF)


def batch_words(ids: pa.Array, column: pa.Array, least: int = LEAST_LENGTH) -> pa.Array:
    """The words of ``least`` code points or more of a batch of texts, with repeats."""
    data, offs = text_buffer(column)
    n = len(data)
    lead = data == 0xC3                                      # the first byte of U+00C0 to U+00FF, and of no other
    inside = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A) | lead
    inside[1:] |= lead[:-1]
    starts, ends = inside.copy(), np.zeros(n + 1, bool)
    starts[1:] &= ~inside[:-1]
    ends[1:] = inside
    ends[1:n] &= ~inside[1:]
    edge = offs[(offs > 0) & (offs < n)]
    starts[edge], ends[edge] = inside[edge], inside[edge - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)]
    some = points[end] - points[start] >= least
    start, end = start[some], end[some]
    doc = np.searchsorted(offs, start, "right") - 1
    flat = data[_flat(start, end - start)]
    flat[(flat >= 0x41) & (flat <= 0x5A)] |= 0x20
    first = np.r_[0, np.cumsum(end - start)]
    prefix = np.array([zlib.crc32(f"{x}:".encode()) for x in ids.to_pylist()], np.uint32)
    crc = _crcs(prefix[doc], flat, first).astype(np.int64)
    heads = np.flatnonzero((flat & 0xC0) != 0x80)
    head = np.searchsorted(heads, first)                     # code points before each word
    size = np.diff(head)
    hit = np.flatnonzero(crc % DROP_EVERY == 0)
    gone = heads[head[hit] + crc[hit] % size[hit]]
    keep = np.ones(len(flat), bool)
    keep[gone] = False
    wide = gone[flat[gone] == 0xC3]
    keep[wide + 1] = False
    size[hit] -= 1
    first = np.r_[0, np.cumsum(keep)][first]
    words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(first.astype(np.int64)), pa.py_buffer(flat[keep]))
    return words.filter(pa.array(size >= least))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []

    def summed() -> Iterator[pa.RecordBatch]:
        total = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"])
        held.clear()
        for part in total.to_batches(max_chunksize=1 << 16):
            yield pa.RecordBatch.from_arrays([part["word"].cast(pa.string()), part["n_sum"]], names=["word", "n"])

    for batch in slices(batches):
        found = pc.value_counts(batch_words(batch["id"], batch["text"]))
        held.append(pa.table({"word": found.field(0), "n": found.field(1)}))
        if sum(t.num_rows for t in held) > _HELD:
            yield from summed()
    if held:
        yield from summed()


def _matrices(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, bytes as [word, code point]) of the words of each length, in Latin-1."""
    data, offs = text_buffer(words)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    wide = data[heads] == 0xC3
    letters = np.where(wide, data[np.minimum(heads + 1, len(data) - 1)] + np.uint8(0x40), data[heads])
    first = np.searchsorted(heads, offs)
    size = np.diff(first)
    for length in np.unique(size):
        at = np.flatnonzero(size == length)
        yield at, letters[first[:-1][at][:, None] + np.arange(length)]


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, letters = np.zeros(batch.num_rows, np.uint64), np.zeros(256, bool)
        for at, chars in _matrices(batch["word"]):
            h[at] = mix((_VALUES[chars] * _powers(chars.shape[1])[:-1]).sum(axis=1, dtype=np.uint64))
            letters[np.unique(chars)] = True
        used = pa.ListArray.from_arrays(pa.array([0] * batch.num_rows + [int(letters.sum())], pa.int32()),
                                        pa.array(np.flatnonzero(letters).astype(np.int32)))
        if batch.num_rows:                                   # the last row of a batch carries its letters
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h.view(np.int64)), used], names=["word", "n", "h", "used"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(wid, word, n, len, h, used): words that occur often enough, with a number, their count, length and hash."""
    text = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    counted = (text.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
               .filter(F.col("n") >= LEAST_COUNT))
    hashed = counted.mapInArrow(_hashed, "word string, n long, h long, used array<int>")
    return materialize(hashed.select(F.monotonically_increasing_id().alias("wid"), "word", "n", F.length("word").alias("len"),
                                     "h", "used"), "op11-vocabulary")


def _bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, eight bit numbers in one value) of a key."""
    h = mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32), h * np.uint64(0xD6E8FEB86659FD93 | 1)


def _bit(bits: np.ndarray, j: int) -> np.ndarray:
    return np.uint64(1) << ((bits >> np.uint64(64 - 6 * (j + 1))) & np.uint64(63))


def bloom(hashes: np.ndarray) -> np.ndarray:
    """Blocked Bloom filter of the keys, as [block, word]."""
    blocks = max(1, math.ceil(len(hashes) * BITS_A_WORD / (64 * _BLOCK)))
    out = np.zeros((blocks, _BLOCK), np.uint64)
    block, bits = _bits(hashes, blocks)
    for j in range(_BLOCK):
        np.bitwise_or.at(out[:, j], block.astype(np.int64), _bit(bits, j))
    return out


def _probe(filters: dict[int, tuple[np.ndarray, np.ndarray, int]], length: int, h: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filters of ``length`` hold, false positives included."""
    tables, first, blocks = filters[length]
    shards = len(blocks)
    shard = ((h >> np.uint64(1)) % np.uint64(shards)).astype(np.int64) if shards > 1 else np.zeros(len(h), np.int64)
    at = np.flatnonzero(blocks[shard] > 0)                  # a shard of another pass has no blocks here
    block, bits = _bits(h[at], blocks[shard[at]].astype(np.uint64))
    row = first[shard[at]] + block.astype(np.int64)
    for j in range(_BLOCK):
        bit = _bit(bits, j)
        held = tables[row, j] & bit != 0
        at, row, bits = at[held], row[held], bits[held]
    return at


def _edits(chars: np.ndarray, alphabet: np.ndarray, filters: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, letter or 0 for a deletion, hash) of the edits of equally long words that the filters hold."""
    size = chars.shape[1]
    if size not in filters and size - 1 not in filters:
        return
    power = _powers(size)
    step = max(1, _CHUNK // size)
    for lo in range(0, len(chars), step):
        part = chars[lo:lo + step]
        value = _VALUES[part] * power[:-1]
        whole = np.cumsum(value, axis=1, dtype=np.uint64)
        total = whole[:, -1:]
        if size - 1 in filters:
            h = mix((whole - value) + (total - whole) * _INVERSE)
            fresh = np.ones(part.shape, bool)
            fresh[:, 1:] = part[:, 1:] != part[:, :-1]       # of a run of one letter, the first is deleted
            row, place = np.nonzero(fresh)
            h = h[row, place]
            at = _probe(filters, size - 1, h)
            yield lo + row[at], place[at], np.zeros(len(at), np.uint8), h[at]
        if size in filters:
            bare = total - value
            for c in alphabet:
                row, place = np.nonzero(part < c)
                h = mix(bare[row, place] + _VALUES[c] * power[place])
                at = _probe(filters, size, h)
                yield lo + row[at], place[at], np.full(len(at), c, np.uint8), h[at]


def _filters(words: DataFrame, plan: dict[int, int]) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Filters by word length, pass by pass: (blocks of all shards, first block of each shard, blocks of each shard).

    Filters are built in tasks, a shard each; the driver holds one pass of at most about ``PASS_BYTES``."""
    shards = F.create_map(*[F.lit(x) for pair in plan.items() for x in pair])

    def build(table: pa.Table) -> pa.Table:
        made = bloom(table["h"].combine_chunks().to_numpy().view(np.uint64))
        return pa.table({"len": table["len"][:1].cast(pa.int32()), "shard": table["shard"][:1], "bits": pa.array([made.tobytes()], pa.binary())})

    shard = F.shiftrightunsigned("h", 1) % F.element_at(shards, F.col("len"))
    dealt = words.select("len", "h", shard.cast("int").alias("shard"))
    made = materialize(dealt.groupBy("len", "shard").applyInArrow(build, "len int, shard int, bits binary"), "op11-filters")
    sizes = sorted((r.len, r.shard, r.size) for r in made.select("len", "shard", F.length("bits").alias("size")).collect())
    held, size = [], 0
    for k, row in enumerate(sizes):
        held.append(row[:2])
        size += row[2]
        if k + 1 < len(sizes) and size + sizes[k + 1][2] <= PASS_BYTES:
            continue
        low, high = held[0], held[-1]
        rows = made.filter(F.struct("len", "shard").between(F.struct(F.lit(low[0]), F.lit(low[1])), F.struct(F.lit(high[0]), F.lit(high[1]))))
        found = {(r.len, r.shard): np.frombuffer(r.bits, np.uint64).reshape(-1, _BLOCK) for r in rows.collect()}
        out = {}
        for length in {x[0] for x in held}:
            own = [found.get((length, s), np.zeros((0, _BLOCK), np.uint64)) for s in range(plan[length])]
            blocks = np.array([len(x) for x in own], np.int64)
            out[length] = np.concatenate(own), np.cumsum(blocks) - blocks, blocks
        yield out
        held, size = [], 0


def near_pairs(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(a, word_a, n_a, b, word_b, n_b): each pair of words of the vocabulary that differ by one code point, once."""
    plan = {r.len: math.ceil(r.c / shard_words) for r in words.groupBy("len").agg(F.count(F.lit(1)).alias("c")).collect()}
    letters = [r.c for r in words.select(F.explode("used").alias("c")).distinct().collect()]     # 116 at most
    alphabet = np.array(sorted(letters), np.uint8)
    found = None
    for filters in _filters(words, plan) if plan else ():
        def probe(batches: Iterator[pa.RecordBatch], filters=filters) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                wid = batch["wid"].to_numpy()
                for at, chars in _matrices(batch["word"]):
                    for row, place, letter, h in _edits(chars, alphabet, filters):
                        if len(row):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(wid[at[row]]), pa.array(place.astype(np.int32)), pa.array(letter.astype(np.int32)),
                                 pa.array(h.view(np.int64))], names=["a", "place", "letter", "h"])

        lengths = sorted({x + d for x in filters for d in (0, 1)})
        asked = words.filter(F.col("len").isin(lengths)).select("wid", "word").repartition("wid")
        hits = materialize(asked.mapInArrow(probe, "a long, place int, letter int, h long"), "op11-positives")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return words.select(*[F.expr(e) for e in ("wid AS a", "word AS word_a", "n AS n_a", "wid AS b", "word AS word_b", "n AS n_b")]).limit(0)
    met = found.join(words.select("h", F.col("wid").alias("b"), F.col("word").alias("word_b"), F.col("n").alias("n_b")), "h").drop("h")
    both = met.join(words.select(F.col("wid").alias("a"), F.col("word").alias("word_a"), F.col("n").alias("n_a")), "a")
    spelled = "concat(left(word_a, place), IF(letter = 0, '', chr(letter)), substr(word_a, place + 2))"
    return both.filter(f"{spelled} = word_b").select("a", "word_a", "n_a", "b", "word_b", "n_b")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per word of the vocabulary: word, n, n_near, form, form_n, root.

    The form is the near word of the largest n (among equals the smallest in code-point order) if that n is
    ``FORM_RATIO`` times the word's own or more, else null; root is the end of the chain of forms, the word itself if
    it has none. Null and empty texts have no words; a null id counts as the empty string; each repeated row counts;
    an empty table gives an empty result; further columns are not read."""
    words = vocabulary(docs, id_col, text_col)
    pairs = materialize(near_pairs(words, shard_words), "op11-pairs")
    sides = pairs.select(F.col("a").alias("wid"), F.struct((-F.col("n_b")).alias("n"), F.col("word_b").alias("w"), F.col("b").alias("id")).alias("o"))
    sides = sides.unionByName(pairs.select(F.col("b").alias("wid"), F.struct((-F.col("n_a")).alias("n"), F.col("word_a").alias("w"),
                                                                            F.col("a").alias("id")).alias("o")))
    best = sides.groupBy("wid").agg(F.count(F.lit(1)).alias("n_near"), F.min("o").alias("o"))
    found = words.select("wid", "word", "n").join(best, "wid", "left")
    takes = F.expr(f"-o.n >= {FORM_RATIO} * n")
    found = materialize(found.select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                     F.when(takes, F.col("o.w")).alias("form"), F.when(takes, -F.col("o.n")).alias("form_n"),
                                     F.when(takes, F.col("o.id")).alias("up")), "op11-forms")
    # Counts grow at least tenfold along a chain, so it ends, and doubling reaches its end in a few rounds.
    roots = found.filter("up IS NOT NULL").select("wid", "up")
    while True:
        far = roots.select(F.col("wid").alias("up"), F.col("up").alias("far"))
        after = materialize(roots.join(far, "up", "left").select("wid", F.coalesce("far", "up").alias("up"),
                                                                 F.col("far").isNotNull().alias("moved")), "op11-roots")
        roots = after.select("wid", "up")
        if after.filter("moved").isEmpty():
            break
    named = roots.join(words.select(F.col("wid").alias("up"), F.col("word").alias("top")), "up").select("wid", "top")
    return found.drop("up").join(named, "wid", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("top", "word").alias("root"))
