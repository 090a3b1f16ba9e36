"""N-gram Jaccard join with count vectors in an R-tree.

Shingles are hashed to groups in two ways.

* Cells. Sets with 100 * |A & B| >= t * |A | B| differ in r = (100 - t) * n / t elements at most, n the
  smaller size. Of more than r groups one at least holds the same elements in both, so a document is
  put into one cell for each of its first r + 1 groups with three elements or more, keyed by the content
  of the group: linked documents share a cell. (With too few such groups it is dealt again by another
  hash; two documents that miss each other under one hash both are.) The number of groups follows the
  size, in bands of 1 : 1.5; a document near the lower end of its band joins the band below as well.
  Below ``FEW_GROUPS`` percent so many groups would hold one or two elements each. There the cells are those of
  single elements: linked sets share one of their first n - t * n / 100 + 1 elements in any one order. The order is
  that of a hash, with the elements that very many documents hold at the end, so a passage that they share makes no
  cell of them all. Which elements these are is told by counts over all documents in ``SKETCH`` hash buckets (an
  element beside a frequent one goes to the end as well, which loses nothing).
* Points. The element counts of ``DIMENSIONS`` groups are a point. The summed minima of two points'
  coordinates bound the overlap of the sets; within a cell, an R-tree of the points with the coordinate
  maxima of its boxes finds the pairs that can still be linked. Pairs that survive are verified on
  the whole sets.

(An R-tree of all points alone prunes nothing but size: one coordinate of two unrelated texts of the same
size differs by a few sigma, which is far below the difference that the threshold allows.)

Documents with equal sets are one member, so copies never meet. For components, a first round verifies
each member with the member it shares most pivots with. The pairs that pass the bound in a cell and lie in
different components are then a graph of components: a round verifies the edges of a spanning forest of it
(if all are links, the components are found), the next one those of 8 forests, later ones the best 64, 2048 and
so on of each member, until no such pair is left unverified. Links within a component are not needed, so a
group of near copies costs about a pair a member.
Cells above ``BLOCK`` members are searched block against block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.components import components
from riskflow.llm.store import materialize
from riskflow.llm.tokens import SLICE_BYTES, SPACED, Words, long_list, mix, slices

WORDS = 3
PERCENT = 90
DIMENSIONS = 256
BLOCK = 20_000          # members of a cell that are searched as one
BUCKET = 20_000         # rows of whole cells that are searched in one call, about
LEAF = 16
FEW_GROUPS = 85
SKETCH, FREQUENT, LEAST_FREQUENT = 1 << 21, 1024, 64     # buckets; a frequent one counts so many documents, or one of so many
_CHUNK = 1 << 15
_BAND = 1.5
_DEALS = 8


def shingles(words: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of each document; a shorter text is one shingle."""
    whole = words.window_hash(size) if len(words.hash) >= size else np.zeros(0, np.uint64)
    out = []
    for d, n in enumerate(words.counts.tolist()):
        s = int(words.first[d])
        if n >= size:
            out.append(np.unique(whole[s:s + n - size + 1]))
        elif n:
            h = np.zeros(1, np.uint64)
            for w in words.hash[s:s + n]:
                h = mix(h * np.uint64(0xD1342543DE82EF95) + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _band_ends(percent: int) -> np.ndarray:
    """Lower ends of the size bands; below the first one only equal sets are linked."""
    ends = [-(-percent // (100 - percent)) if percent < 100 else 1]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, int(ends[-1] * _BAND)))
    return np.array(ends)


def _bucket(items: np.ndarray) -> np.ndarray:
    return (items >> np.uint64(43)).astype(np.int64) % SKETCH


def frequent_buckets(docs: DataFrame, size: int, text_col: str) -> np.ndarray:
    """Mask of the buckets whose shingles stand in very many documents; a task sends one count a bucket at most."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SKETCH, np.uint32), 0
        for batch in slices(batches):
            sets = shingles(Words(batch["text"], SPACED, lower=True), size)
            n += len(sets)
            total += np.bincount(_bucket(np.concatenate(sets)), minlength=SKETCH).astype(np.uint32)
        for k in range(SKETCH // _CHUNK if n else 0):
            part = total[k * _CHUNK:(k + 1) * _CHUNK]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([part.tobytes()], pa.binary())],
                                             names=["chunk", "n", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total, n = np.zeros(_CHUNK, np.int64), sum(table["n"].to_pylist())
        for x in table["counts"]:
            total += np.frombuffer(x.as_buffer(), np.uint32)
        mask = np.packbits(total >= max(LEAST_FREQUENT, n // FREQUENT))
        return pa.table({"chunk": table["chunk"][:1], "mask": pa.array([mask.tobytes()], pa.binary())})

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "chunk int, n long, counts binary")
    out = np.zeros(SKETCH, bool)
    for r in counts.groupBy("chunk").applyInArrow(add, "chunk int, mask binary").collect():      # a bit a bucket
        out[r.chunk * _CHUNK:(r.chunk + 1) * _CHUNK] = np.unpackbits(np.frombuffer(r.mask, np.uint8)).astype(bool)
    return out


def cell_keys(items: np.ndarray, percent: int, ends: np.ndarray, frequent: np.ndarray | None = None) -> np.ndarray:
    """Keys of the cells of one set."""
    n = len(items)
    band = int(np.searchsorted(ends, n, "right")) - 1
    if band < 0 or percent >= 100:
        return np.zeros(0, np.uint64)
    bands = [band]
    if band and n * percent < 100 * ends[band]:      # a partner may be in the band below
        bands.append(band - 1)
    if percent < FEW_GROUPS:
        late = frequent[_bucket(items)] if frequent is not None else np.zeros(n, bool)
        first = mix(items)
        first = first[np.lexsort((first, late))][:n - -(-percent * n // 100) + 1]
        return np.concatenate([mix(first + mix(np.uint64([(b << 32) + 7]))) for b in bands])
    out = []
    for b in bands:
        allowed = (int(ends[b + 1]) - 1) * (100 - percent) // percent
        groups = allowed + 4 + allowed // 5
        for deal in range(_DEALS):
            mixed = mix(items ^ np.uint64((0x9E3779B97F4A7C15 * (deal + 1)) & ((1 << 64) - 1)))
            group = (mixed % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            count = np.bincount(group, minlength=groups)
            begin = np.cumsum(count) - count
            last = deal == _DEALS - 1
            strong = np.flatnonzero(count >= (0 if last else 3))[:allowed + 1]
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(mixed)[order], dtype=np.uint64)])
            content = sums[begin[strong] + count[strong]] - sums[begin[strong]]
            place = strong.astype(np.uint64) + np.uint64(((b * _DEALS + deal) << 32) + 1)
            out.append(mix(content + mix(place)))
            if len(strong) > allowed:
                break
    return np.concatenate(out)


def _fingerprint(items: np.ndarray) -> int:
    """Of a set, as a signed 64-bit number."""
    return int((mix(items ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(items))).view(np.int64))


def _profiles(size: int, percent: int, frequent: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = _band_ends(percent)
        met: set[int] = set()                 # members whose cells this task has given already
        for batch in slices(batches):
            sets = shingles(Words(batch["text"], SPACED, lower=True), size)
            members = [_fingerprint(x) for x in sets]
            keys = []
            for m, x in zip(members, sets):
                keys.append(np.zeros(0, np.uint64) if m in met else cell_keys(x, percent, ends, frequent))
                met.add(m)
            offs = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["k"], pa.array([len(x) for x in sets], pa.int64()), pa.array(members, pa.int64()),
                 long_list(np.concatenate(keys), offs)], names=["id", "k", "n", "m", "keys"])
    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [press.compress(t.as_buffer()) for t in batch["text"].cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch["k"], pa.array(packed, pa.binary())], names=["k", "z"])


def _sets(packed: pa.Array, size: int) -> list[np.ndarray]:
    press = zstandard.ZstdDecompressor()
    texts = pa.array([press.decompress(z.as_buffer()) for z in packed], pa.large_binary()).cast(pa.large_string())
    return shingles(Words(texts, SPACED, lower=True), size)


def point(items: np.ndarray) -> np.ndarray:
    return np.bincount((items >> np.uint64(56)).astype(np.int64), minlength=DIMENSIONS)


def _points(size: int):
    """Members with their text, set size and point; rows whose set is another one's (a hash met) are dropped."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "z", SLICE_BYTES // 3):
            sets = _sets(batch["z"], size)
            good = pa.array([_fingerprint(x) == m for x, m in zip(sets, batch["m"].to_pylist())], pa.bool_())
            out = pa.RecordBatch.from_arrays(
                [batch["m"], batch["z"], pa.array([len(x) for x in sets], pa.int64()),
                 pa.array([point(x) for x in sets], pa.list_(pa.int32()))], names=["m", "z", "n", "point"])
            yield out.filter(good)
    return run


def _verify(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "za", SLICE_BYTES // 3):
            a, b = _sets(batch["za"], size), _sets(batch["zb"], size)
            good = []
            for x, y in zip(a, b):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
    return run


class Tree:
    """R-tree of points: nodes hold the coordinate maxima, the least and largest size and the component (-1: several)."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, comps: np.ndarray):
        rows = np.arange(len(points))
        parts = [rows]
        while any(len(p) > LEAF for p in parts):     # halve along the coordinate that spreads most
            halves = []
            for p in parts:
                if len(p) <= LEAF:
                    halves.append(p)
                    continue
                wide = np.concatenate([sizes[p, None], points[p] * 4], 1)
                axis = wide[:, int(np.ptp(wide, axis=0).argmax())]
                order = p[np.argsort(axis, kind="stable")]
                halves += [order[:len(p) // 2], order[len(p) // 2:]]
            parts = halves
        self.points, self.sizes, self.comps, self.leaves = points, sizes, comps, parts
        self.levels = [self._boxes(parts, points, sizes, sizes, comps)]
        while len(self.levels[-1][0]) > 1:
            top, small, large, comp = self.levels[-1]
            groups = [np.arange(i, min(i + LEAF, len(top))) for i in range(0, len(top), LEAF)]
            self.levels.append(self._boxes(groups, top, small, large, comp))

    @staticmethod
    def _boxes(groups, top, small, large, comp):
        one = [comp[g][0] if (comp[g] == comp[g][0]).all() else -1 for g in groups]
        return (np.stack([top[g].max(axis=0) for g in groups]), np.array([small[g].min() for g in groups]),
                np.array([large[g].max() for g in groups]), np.array(one))

    @staticmethod
    def bound(level, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Pairs of nodes that may hold a linked pair of different components."""
        top, small, large, comp = level
        good = (100 * large[i] >= percent * small[j]) & (100 * large[j] >= percent * small[i]) & ~(
            (comp[i] == comp[j]) & (comp[i] >= 0))
        i, j = i[good], j[good]
        keep = np.zeros(len(i), bool)
        for s in range(0, len(i), 1 << 14):
            a, b = i[s:s + (1 << 14)], j[s:s + (1 << 14)]
            overlap = np.minimum(top[a], top[b]).sum(axis=1)
            # overlap >= t (|A| + |B|) / (100 + t) for a linked pair
            keep[s:s + (1 << 14)] = (100 + percent) * overlap >= percent * (small[a] + small[b])
        return np.flatnonzero(good)[keep]

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row pairs of different components that pass the bound, a chunk at a time."""
        i = j = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, 0, -1):
            keep = self.bound(self.levels[depth], i, j, percent)
            size = len(self.levels[depth - 1][0])
            i, j = self._children(i[keep], j[keep], size)
        keep = self.bound(self.levels[0], i, j, percent)
        points = (self.points, self.sizes, self.sizes, self.comps)
        for a, b in zip(i[keep].tolist(), j[keep].tolist()):
            x, y = np.meshgrid(self.leaves[a], self.leaves[b], indexing="ij")
            x, y = x.ravel(), y.ravel()
            if a == b:
                x, y = x[x < y], y[x < y]
            good = self.bound(points, x, y, percent)
            if len(good):
                yield x[good], y[good]

    @staticmethod
    def _children(i: np.ndarray, j: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        step = np.arange(LEAF)
        a = (i[:, None, None] * LEAF + step[None, :, None]) + np.zeros((1, 1, LEAF), np.int64)
        b = (j[:, None, None] * LEAF + step[None, None, :]) + np.zeros((1, LEAF, 1), np.int64)
        good = (a < size) & (b < size) & (a <= b)
        return a[good], b[good]


def _small_cells(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All row pairs of each of many small cells."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for n in np.unique(size).tolist():
        x, y = np.triu_indices(n, 1)
        at = begin[size == n][:, None]
        out.append(((at + x).ravel(), (at + y).ravel()))
    return np.concatenate([p[0] for p in out]), np.concatenate([p[1] for p in out])


def _forest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the edges of a spanning forest (Boruvka); edges come with the best first."""
    names, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = ends[:len(x)], ends[len(x):]
    label, left, taken = np.arange(len(names)), np.arange(len(x)), [np.zeros(0, np.int64)]
    while True:
        left = left[label[x[left]] != label[y[left]]]
        if not len(left):
            return np.unique(np.concatenate(taken))
        best = np.full(len(names), len(x))
        np.minimum.at(best, label[x[left]], left)
        np.minimum.at(best, label[y[left]], left)
        roots = np.flatnonzero(best < len(x))
        pick = best[roots]
        taken.append(pick)
        up = np.arange(len(names))
        up[roots] = label[x[pick]] + label[y[pick]] - roots      # the other end
        mutual = roots[(up[up[roots]] == roots) & (roots < up[roots])]
        up[mutual] = mutual
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def _forests(x: np.ndarray, y: np.ndarray, count: int) -> np.ndarray:
    """Mask of the edges of ``count`` spanning forests that share no edge, the best edges first."""
    keep, left = np.zeros(len(x), bool), np.arange(len(x))
    for _ in range(count):
        part = _forest(x[left], y[left])
        keep[left[part]] = True
        left = np.delete(left, part)
    return keep


def _best(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Mask of the pairs that are among the first ``most`` of either member; pairs come with the best first."""
    keep, places = np.zeros(len(a), bool), np.arange(len(a))
    ends, place = np.concatenate([a, b]), np.concatenate([places, places])
    order = np.lexsort((place, ends))
    ends = ends[order]
    keep[place[order][np.arange(len(ends)) - np.searchsorted(ends, ends) < most]] = True
    return keep


def _search(percent: int, forests: int, most: int):
    """Pairs (a, b, more) of the cells of a bucket: the edges of ``forests`` spanning forests of the components, or
    (``forests`` 0) of each member the ``most`` of the largest overlap bounds; ``more``: the bucket has others."""
    def run(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by([(c, "ascending") for c in ("key", "i", "j", "m", "block")]).combine_chunks()
        key, i, j, m, block, comps, sizes = (bucket[c].to_numpy() for c in ("key", "i", "j", "m", "block", "comp", "n"))
        comps = np.unique(comps, return_inverse=True)[1]          # fingerprints may be negative; -1 stands for several
        points = bucket["point"].combine_chunks().flatten().to_numpy().reshape(-1, DIMENSIONS).astype(np.int32)
        new = np.ones(len(m), bool)
        new[1:] = (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(m)))
        small = size <= LEAF
        found = []
        x, y = _small_cells(begin[small], size[small])
        for s in range(0, len(x), 1 << 16):
            a, b = x[s:s + (1 << 16)], y[s:s + (1 << 16)]
            good = Tree.bound((points, sizes, sizes, comps), a, b, percent)
            found.append((a[good], b[good]))
        for s, n in zip(begin[~small].tolist(), size[~small].tolist()):
            cell = slice(s, s + n)
            for a, b in Tree(points[cell], sizes[cell], comps[cell]).pairs(percent):
                found.append((a + s, b + s))
        x, y = (np.concatenate([p[k] for p in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        apart = (i[x] == j[x]) | (block[x] != block[y])      # of two blocks, pairs across only
        x, y = x[apart], y[apart]
        a, b = np.minimum(m[x], m[y]), np.maximum(m[x], m[y])
        order = np.lexsort((b, a))                           # a pair may share many cells of the bucket: once is enough
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
        x, y, a, b = (v[order[new]] for v in (x, y, a, b))
        overlap = np.concatenate([np.zeros(0), *[np.minimum(points[x[s:s + 65536]], points[y[s:s + 65536]]).sum(axis=1)
                                                 for s in range(0, len(x), 65536)]]) / (sizes[x] + sizes[y])
        order = np.lexsort((b, a, -overlap))                 # the best first
        x, y, a, b = (v[order] for v in (x, y, a, b))
        keep = _forests(comps[x], comps[y], forests) if forests else _best(a, b, most)
        more = np.full(int(keep.sum()), not keep.all())
        return pa.table({"a": a[keep], "b": b[keep], "more": more})
    return run


def _verified(pairs: DataFrame, members: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    side = [members.select(F.col("m").alias(x), F.col("z").alias(f"z{x}")) for x in "ab"]
    joined = pairs.join(side[0], "a").join(side[1], "b").select("a", "b", "za", "zb")
    return materialize(joined.mapInArrow(_verify(size, percent), "a long, b long"), name)


def jaccard_components(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id",
                       text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable by links, itself included).

    Texts are lower-cased (A-Z) and cut into words at ``[\\x20\\x09-\\x0D]+``; a text of fewer words than ``size`` is one
    shingle. Null, empty and wordless texts have no shingle and no link: their component is their own id. Repeated
    rows and copies have equal sets and so are linked. A null id is never the smallest of others. An empty table
    gives an empty result; other columns are not read. Shingles and sets are compared by 64-bit fingerprints."""
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("k"), text.alias("text"))
    frequent = frequent_buckets(docs, size, text_col) if percent < FEW_GROUPS else None
    profiles = materialize(keyed.mapInArrow(_profiles(size, percent, frequent), f"id {id_type}, k long, n long, m long, keys array<long>"),
                           "op7-profiles")
    rows = profiles.select(F.explode("keys").alias("key"), "m")
    cells = rows.groupBy("key").agg(F.min("m").alias("pivot"), F.max("m").alias("most")).filter("pivot < most").select(
        "key", "pivot")
    cells = materialize(rows.join(cells, "key").distinct(), "op7-cells")          # members of the cells that hold several
    copies = materialize(profiles.filter("n > 0").groupBy("m").agg(F.min("id").alias("least"), F.min("k").alias("k")),
                         "op7-members")
    needed = cells.select("m").distinct().join(copies.select("m", "k"), "m")
    texts = keyed.select("k", "text").mapInArrow(_pack, "k long, z binary").join(needed, "k").select("m", "z")
    members = materialize(texts.mapInArrow(_points(size), "m long, z binary, n long, point array<int>")
                          .groupBy("m").agg(F.any_value("z").alias("z"), F.any_value("n").alias("n"),
                                            F.any_value("point").alias("point")), "op7-points")

    first = cells.filter("m <> pivot").groupBy("m", "pivot").agg(F.count(F.lit(1)).alias("c"))
    first = first.groupBy("m").agg(F.max_by("pivot", F.struct("c", "pivot")).alias("pivot"))
    first = first.select(F.least("m", "pivot").alias("a"), F.greatest("m", "pivot").alias("b")).distinct()
    tried = materialize(first, "op7-new")
    comps = materialize(_merged(members.select(F.col("m").alias("node"), F.col("m").alias("comp")),
                                _verified(tried, members, size, percent, "op7-links")), "op7-comps")
    for forests, most in _rounds():
        found = materialize(_cell_pairs(cells, members, comps, percent, forests, most, block), "op7-found")
        new = materialize(found.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "op7-new")
        links = _verified(new, members, size, percent, "op7-links")
        if not links.isEmpty():
            comps = materialize(_merged(comps, links), "op7-comps")
        if found.filter("more").isEmpty():
            break
        tried = tried.unionByName(new)

    labelled = copies.join(comps.withColumnRenamed("node", "m"), "m", "left").select(
        "m", "least", F.coalesce("comp", "m").alias("comp"))
    least = labelled.groupBy("comp").agg(F.min("least").alias("component_id"))
    labelled = materialize(labelled.join(least, "comp").select("m", "component_id"), "op7-components")
    return profiles.select("id", "n", "m").join(labelled, "m", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _rounds() -> Iterator[tuple[int, int]]:
    """Forests of a round, then pairs of a member; without end."""
    yield 1, 0
    yield 8, 0
    most = 64
    while True:
        yield 0, most
        most *= 32


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (node, comp) after the links (a, b): components are joined as wholes, not node by node."""
    a, b = (comps.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    wholes = links.join(a, "a").join(b, "b").filter("ca <> cb").select("ca", "cb").distinct()
    joined = components(wholes, "ca", "cb").select(F.col("node").alias("comp"), F.col("comp").alias("whole"))
    return comps.join(joined, "comp", "left").select("node", F.coalesce("whole", "comp").alias("comp"))


def _cell_pairs(cells: DataFrame, members: DataFrame, comps: DataFrame, percent: int, forests: int, most: int,
                block: int) -> DataFrame:
    """Pairs (a, b, more) within the cells whose members lie in several components; of cells of the same members, one."""
    labelled = cells.select("key", "m").join(comps.withColumnRenamed("node", "m"), "m")
    mixed = labelled.groupBy("key").agg(
        F.count(F.lit(1)).alias("c"), F.min("comp").alias("x"), F.max("comp").alias("y"),
        F.bit_xor(F.xxhash64("m")).alias("h1"), F.bit_xor(F.xxhash64("m", F.lit(1))).alias("h2")).filter("x < y")
    mixed = mixed.groupBy("c", "h1", "h2").agg(F.min("key").alias("key"), F.min("x").alias("x"))
    mixed = materialize(mixed.select("key", "c", "x"), "op7-mixed")
    # Cells with the same least component mostly hold the same members: they are searched together, as far as
    # about BUCKET rows hold them, so that a pair which shares many cells is met once.
    parts = mixed.groupBy("x").agg(F.ceil(F.sum("c") / BUCKET).cast("int").alias("parts"))
    mixed = mixed.join(parts, "x").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts"))).select(
        "key", "x", "part", F.ceil(F.col("c") / block).cast("int").alias("blocks"))
    spread = labelled.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("m"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("against", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "x", "part", "m", "comp", "block", F.least("block", "against").alias("i"), F.greatest("block", "against").alias("j"))
    buckets = max(1, -(-spread.count() // BUCKET))
    return (spread.join(members.select("m", "n", "point"), "m")
            .groupBy(F.pmod(F.xxhash64("x", "part", "i", "j"), F.lit(buckets)).alias("bucket"))
            .applyInArrow(_search(percent, forests, most), "a long, b long, more boolean"))
