"""Gradient-boosted trees over binned columns as Spark jobs (M-03, M-04, M-07).

* Columns are binned once: code 0 is missing, the others count the cut points below a value. A row is its id, fold,
  label and one byte a feature.
* A pass over the rows gives, for every open leaf of every model, the gradient and Hessian sums by feature and bin.
  They are summed within each task, then by one shuffle on (model, feature), which also finds the best cut of each leaf;
  a row a leaf reaches the driver, whatever the number of rows. Missing values go to the side that gains more.
* Trees grow depth-wise (``max_depth``) or best leaf first (``max_leaves``). A pass opens the children of all leaves
  that could still be split, and the driver then takes the splits in the order of their gain, so the tree is the one
  that opens one leaf at a time while passes are about as many as the tree is deep.
* Many models share the passes: the folds of a cross-validation, or the folds of all trials of a search. A model
  leaves out its held-out fold, scores it after each tree, and stops after ``patience`` trees without a better AUC.
* Rows lie in executors as blocks of arrays with the scores so far; a new tree of each model is added to these once,
  with a checkpoint in the shared folder every ``LINEAGE`` additions. Where there are fewer blocks than cores, the models
  are dealt into groups with their own copies of the blocks, and a pass of one block needs no shuffle.
* Rows that fit a task many times over (``WHOLE_ROWS``, ``WHOLE_CODES``) need no passes: a task reads them all and grows
  all trees of one model by the same rules, so a round costs no job.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.operators.stages import fingerprint, run_slices, spec_hash
from riskflow.session import checkpoint_dir
from riskflow.sources.io import unique_path

MAX_BINS = 255          # with code 0 for missing values, one byte
REFRESH = 160           # most trees of all models that a pass walks before they are added to the scores; else one a model
LINEAGE = 50            # additions to the scores between two checkpoints of them
BLOCK_ROWS, LEAST_ROWS = 1 << 16, 1 << 14      # of a block of rows: most, and least where there are idle cores
KEPT = StorageLevel.MEMORY_AND_DISK
SCORE_BUCKETS = 4096    # of the AUC that ends the boosting
PASS_BYTES = 1 << 28    # of histograms held by a task
OPENS_LESS = 8          # within a task, this part of the leaves that there is room for is opened at once
WHOLE_ROWS, WHOLE_CODES = 1 << 21, 1 << 26      # most labelled rows, and rows times features, of which one task grows a whole model


@dataclass(frozen=True)
class BoostSpec:
    name: str
    n_trees: int = 100
    learning_rate: float = 0.1
    max_depth: int | None = 6
    max_leaves: int | None = None
    subsample: float = 1.0
    colsample_tree: float = 1.0
    colsample_level: float = 1.0
    min_child_weight: float = 0.0
    min_child_rows: int = 1
    alpha: float = 0.0
    lam: float = 1.0
    weights: str | None = None      # 'scale': positives weigh neg // pos; 'balanced': n / (2 n of the class)
    patience: int | None = None
    seed: int = 42


# The published configurations of the two boosted members.
BOOST_A = BoostSpec("boosted_depthwise", 1500, 0.02, 6, None, 0.8, 0.8, 0.6, 30.0, 1, 0.1, 1.0, "scale", 100)
BOOST_B = BoostSpec("boosted_leafwise", 2000, 0.02, None, 63, 0.8, 0.8, 1.0, 0.0, 30, 0.1, 1.0, "balanced", 100)


@dataclass
class Tree:
    """Nodes as parallel lists; ``feature`` is -1 at a leaf. Codes up to ``cut`` go left, missing ones if ``missing_left``."""
    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float = 0.0, cover: float = 0.0) -> int:
        for name, x in (("feature", -1), ("cut", 0), ("missing_left", False), ("left", -1), ("right", -1), ("value", value),
                        ("cover", cover), ("gain", 0.0)):
            getattr(self, name).append(x)
        return len(self.feature) - 1

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: np.asarray(v) for k, v in vars(self).items()}


def _walk(tree: dict[str, np.ndarray], codes: np.ndarray) -> np.ndarray:
    """Node that each row of codes ends in."""
    node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
    while True:
        f = tree["feature"][node]
        inner = f >= 0
        if not inner.any():
            return node
        c = codes[rows, np.where(inner, f, 0)]
        left = np.where(c == 0, tree["missing_left"][node], c <= tree["cut"][node])
        node = np.where(inner, np.where(left, tree["left"][node], tree["right"][node]), node)


def _values(tree: dict[str, np.ndarray], columns: np.ndarray) -> np.ndarray:
    """The tree's answer to each row, from its codes by [feature, row]: the rows of a node are dealt to its children."""
    out = np.empty(columns.shape[1])
    waiting = [(0, slice(None))]
    while waiting:
        v, rows = waiting.pop()
        f = tree["feature"][v]
        if f < 0:
            out[rows] = tree["value"][v]
            continue
        c, cut = columns[f][rows], int(tree["cut"][v])
        left = c <= cut if tree["missing_left"][v] else (c <= cut) & (c > 0)
        if isinstance(rows, slice):
            waiting += [(tree["left"][v], np.flatnonzero(left)), (tree["right"][v], np.flatnonzero(~left))]
        else:
            waiting += [(tree["left"][v], rows[left]), (tree["right"][v], rows[~left])]
    return out


@dataclass
class Ensemble:
    """Trees kept (up to the best round), the AUC of the held-out fold after each round, and what is needed to score."""
    spec: BoostSpec
    features: list[str]
    edges: list[list[float]]
    trees: list[Tree]
    history: list[float]
    held_out: int | None = None

    @property
    def best_auc(self) -> float | None:
        return max(self.history) if self.history else None

    def importances(self) -> dict[str, float]:
        """Share of the gain of all splits by feature."""
        total = dict.fromkeys(self.features, 0.0)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    total[self.features[f]] += g
        whole = sum(total.values())
        return {k: v / whole if whole else 0.0 for k, v in total.items()}

    def to_json(self) -> str:
        return json.dumps(self, default=vars)

    @staticmethod
    def from_json(text: str) -> Ensemble:
        d = json.loads(text)
        return Ensemble(BoostSpec(**d["spec"]), d["features"], d["edges"], [Tree(**t) for t in d["trees"]], d["history"], d["held_out"])


# ------------------------------------------------------------------ rows

def bin_edges(df: DataFrame, features: Sequence[str], bins: int = MAX_BINS) -> list[list[float]]:
    """Cut points of each feature from its quantiles, in one aggregate; at most ``bins`` - 1 each reach the driver."""
    levels = [i / (bins - 1) for i in range(bins - 1)]
    got = df.agg(*[F.percentile_approx(_number(c), levels, 100_000).alias(f"c{i}") for i, c in enumerate(features)]).first()
    return [sorted(set(x or ())) for x in got]


def _number(c: str):
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x), x)


def _codes(columns: list[np.ndarray], edges: list[list[float]]) -> np.ndarray:
    out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.uint8)
    for j, x in enumerate(columns):
        out[:, j] = np.where(np.isnan(x), 0, np.searchsorted(np.asarray(edges[j], float), x, "left") + 1)
    return out


def _doubles(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch[name].to_numpy(zero_copy_only=False).astype(np.float64)    # null is NaN


def _binary(codes: np.ndarray) -> pa.Array:
    n, width = codes.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width),
                                                  pa.py_buffer(np.ascontiguousarray(codes))])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    _, offsets, data = column.buffers()
    lo, hi = np.frombuffer(offsets, np.int32)[[column.offset, column.offset + len(column)]]
    return np.frombuffer(data, np.uint8)[lo:hi].reshape(len(column), width)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = unique_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def binned(df: DataFrame, features: Sequence[str], edges: list[list[float]], id_col: str, label: str,
           fold: str | None = None) -> DataFrame:
    """Row table (id, draw, fold, label, codes) in the shared folder; rows without a label are kept for scoring."""
    features = list(features)
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *T.StructType.fromDDL(
        "draw long, fold int, label double, codes binary")])
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("draw"),
                     (F.coalesce(F.col(fold).cast("int"), F.lit(-1)) if fold else F.lit(-1)).alias("fold"),
                     F.col(label).cast("double").alias("label"), *[_number(c).alias(f"c{i}") for i, c in enumerate(features)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = _codes([_doubles(b, f"c{i}") for i in range(len(features))], edges)
            yield pa.RecordBatch.from_arrays([b["id"], b["draw"], b["fold"], b["label"], _binary(codes)],
                                             names=["id", "draw", "fold", "label", "codes"])

    return _stored(rows.mapInArrow(run, schema).hint("rebalance"), "boost-rows")


# ------------------------------------------------------------------ one pass

def _uniform(draw: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) of each row and seed."""
    x = draw.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def _margin(state: dict, codes: np.ndarray, base: np.ndarray) -> np.ndarray:
    out, columns = base.copy(), np.ascontiguousarray(codes.T) if state["pending"] else codes
    for tree in state["pending"]:
        out += _values(tree, columns)
    return out


def _packed(rows: DataFrame, blocks: int, width: int) -> RDD:
    """The labelled rows as one row (draw, fold, label, codes) a block, kept in executors."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if whole:
            parts = [np.concatenate(x).tobytes() for x in zip(*[(b["draw"].to_numpy(), b["fold"].to_numpy(), _doubles(b, "label"), _matrix(b["codes"], width))
                                                                for b in whole], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], names=["draw", "fold", "label", "codes"])

    labelled = rows.filter("label IS NOT NULL").select("draw", "fold", "label", "codes")
    return labelled.repartition(blocks).mapInArrow(packed, "draw binary, fold binary, label binary, codes binary").rdd.persist(KEPT)


def _unpacked(r, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    draw = np.frombuffer(r.draw, np.int64)
    return draw, np.frombuffer(r.fold, np.int32), np.frombuffer(r.label, np.float64), np.frombuffer(r.codes, np.uint8).reshape(len(draw), width)


def _blocks(rows: DataFrame, n: int, models: int, width: int) -> tuple[RDD, int, int]:
    """The ``n`` labelled rows as blocks of arrays (group, draw, fold, label, codes, margins) in executors, the number of groups
    and of blocks a group. A block holds at most about ``BLOCK_ROWS``; where there are fewer blocks than cores, every
    group of models has its own copies, so that models of one block run in tasks of their own."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-n // BLOCK_ROWS), min(cores // models, -(-n // LEAST_ROWS)), 1)
    groups = max(1, min(models, cores // blocks))
    table = _packed(rows, blocks, width)

    def of_group(g: int):
        size = len(range(g, models, groups))

        def run(it):
            for r in it:
                block = _unpacked(r, width)
                yield g, *block, np.zeros((len(block[0]), size))
        return run

    copies = [table.mapPartitions(of_group(g)) for g in range(groups)]
    return (rows.sparkSession.sparkContext.union(copies) if groups > 1 else copies[0]), groups, blocks


def _own(states: list[dict], group: int, groups: int) -> list[dict]:
    return [s for s in states if s["model"] % groups == group]


def _advanced(groups: int, states: list[dict]):
    """Margins with the waiting trees of all models added."""
    def run(it):
        for g, draw, fold, label, codes, base in it:
            base = base.copy()
            for s in _own(states, g, groups):
                k = s["model"] // groups
                base[:, k] = _margin(s, codes, base[:, k])
            yield g, draw, fold, label, codes, base
    return run


def _sums(block: tuple, s: dict, groups: int) -> Iterator[tuple]:
    """((model, feature), sums of g, h and n by leaf and bin) of the rows of a block; at feature -1 the scores of the
    held-out rows by class."""
    _, draw, fold, label, codes, base = block
    p = 1 / (1 + np.exp(-_margin(s, codes, base[:, s["model"] // groups])))
    held = fold == s["held_out"] if s["held_out"] is not None else np.zeros(len(fold), bool)
    if s["score"]:
        at = np.minimum((p[held] * SCORE_BUCKETS).astype(np.int64), SCORE_BUCKETS - 1)
        yield (s["model"], -1), np.stack([np.bincount(at[label[held] == y], minlength=SCORE_BUCKETS) for y in (0, 1)]).astype(float)
    if not len(s["open"]):
        return
    own = ~held
    if s["subsample"] < 1:
        own &= _uniform(draw, s["seed"]) < s["subsample"]
    rows = np.flatnonzero(own)
    slot = s["slot"][_walk(s["tree"], codes[rows])]
    if (slot < 0).any():
        rows, slot = rows[slot >= 0], slot[slot >= 0]
    y, q = label[rows], p[rows]
    w = np.where(y == 1, s["weights"][1], s["weights"][0])
    g, h, leaves = w * (q - y), w * q * (1 - q), len(s["open"])
    for f in s["columns"]:
        at = slot * 256 + codes[rows, f]
        yield (s["model"], f), np.stack([np.bincount(at, x, leaves * 256).reshape(leaves, 256) for x in (g, h, None)])


def _auc(pos: np.ndarray, neg: np.ndarray) -> float:
    below = np.cumsum(neg) - neg
    pairs = pos.sum() * neg.sum()
    return float((pos * (below + neg / 2)).sum() / pairs) if pairs else 0.5


def best_cuts(g: np.ndarray, h: np.ndarray, n: np.ndarray, spec: BoostSpec) -> list[tuple[float, int, bool, float, float, float]]:
    """(gain, cut, missing left, and the left side's sums) of each row of [leaf and feature, bin]; gain 0 without a cut."""
    return list(zip(*[x.tolist() for x in _best_cuts(g, h, n, spec)], strict=True))


def _best_cuts(g: np.ndarray, h: np.ndarray, n: np.ndarray, spec: BoostSpec) -> list[np.ndarray]:
    def score(gs, hs):
        a, b = np.abs(gs), hs + spec.lam
        a -= spec.alpha
        np.maximum(a, 0, out=a)
        a *= a
        a /= np.maximum(b, 1e-12, out=b)
        return a

    def found(missing_left: bool, sums: list[np.ndarray]) -> list[np.ndarray]:
        rows, total = np.arange(len(sums[0])), [x.sum(axis=1, keepdims=True) for x in sums]
        left = [np.cumsum(x[:, 1:], axis=1) + (x[:, :1] if missing_left else 0) for x in sums]
        right = [t - x for t, x in zip(total, left, strict=True)]
        gain = score(*left[:2])
        gain += score(*right[:2])
        gain -= score(*total[:2])
        allowed = (left[2] >= least) & (right[2] >= least) & (left[1] >= spec.min_child_weight) & (right[1] >= spec.min_child_weight)
        gain[~allowed] = 0
        k = gain.argmax(axis=1)
        return [gain[rows, k], k + 1, np.full(len(rows), missing_left), *[x[rows, k] for x in left]]

    least = max(spec.min_child_rows, 1)
    best = found(False, [g, h, n])
    some = np.flatnonzero(n[:, 0] > 0)          # where values are missing, the other side is tried too
    if len(some):
        other = found(True, [x[some] for x in (g, h, n)])
        more = other[0] > best[0][some] + 1e-12
        for x, y in zip(best, other, strict=True):
            x[some[more]] = y[more]
    return best


class Cut(NamedTuple):
    """The best cut of a leaf by one feature: its gain (0 without one), where, the left side's sums and the leaf's."""
    gain: float
    cut: int
    missing_left: bool
    gl: float
    hl: float
    nl: float
    g: float
    h: float
    n: float
    feature: int


def _cuts(key: tuple[int, int], sums: np.ndarray, states: dict[int, dict], specs: dict[int, BoostSpec]) -> tuple:
    """(model, best cut by leaf that has rows and may be cut by the feature) from whole sums; at feature -1 the AUC."""
    m, f = key
    if f < 0:
        return m, _auc(sums[1], sums[0]) if sums.any() else None
    at = [i for i, columns in enumerate(states[m]["allowed"]) if f in columns and sums[2, i].any()]
    if not at:
        return m, {}
    g, h, n = sums[0, at], sums[1, at], sums[2, at]
    totals = zip(*[x.sum(axis=1).tolist() for x in (g, h, n)], strict=True)
    return m, {i: Cut(*cut, *t, f) for i, cut, t in zip(at, best_cuts(g, h, n, specs[m]), totals, strict=True)}


def _best(found: list[tuple]) -> list[tuple]:
    """The same by model: the best feature of each leaf; equal gains go to the first feature."""
    out: dict[int, tuple] = {}
    for m, x in found:
        auc, leaves = out.setdefault(m, [None, {}])
        if isinstance(x, dict):
            for i, c in x.items():
                if i not in leaves or (-round(c.gain, 9), c.feature) < (-round(leaves[i].gain, 9), leaves[i].feature):
                    leaves[i] = c
        else:
            out[m][0] = x
    return [(m, auc, leaves) for m, (auc, leaves) in out.items()]


# ------------------------------------------------------------------ growing

class _Model:
    """One model's trees so far, and the tree that grows."""

    def __init__(self, number: int, spec: BoostSpec, held_out: int | None, weights: tuple[float, float], width: int):
        self.number, self.spec, self.held_out, self.weights, self.width = number, spec, held_out, weights, width
        self.opens_less = 1         # where a pass costs little: fewer leaves are opened that are not split in the end
        self.trees: list[Tree] = []
        self.pending: list[dict] = []
        self.history: list[float] = []
        self.done = False
        self.begin()

    def begin(self) -> None:
        rng = np.random.default_rng([self.spec.seed, len(self.trees)])
        self.columns = self._draw(rng, np.arange(self.width), self.spec.colsample_tree)
        self.rng = rng
        self.tree, self.sums, self.depth, self.cuts = Tree(), {}, {}, {}
        self.tree.add()
        self.depth[0] = 0
        self.open = [0]
        self.by_level: dict[int, np.ndarray] = {}

    def _draw(self, rng, columns: np.ndarray, share: float) -> np.ndarray:
        return columns if share >= 1 else np.sort(rng.choice(columns, max(1, int(share * len(columns))), replace=False))

    def allowed(self, node: int) -> np.ndarray:
        level = self.depth[node]
        if level not in self.by_level:
            self.by_level[level] = self._draw(self.rng, self.columns, self.spec.colsample_level)
        return self.by_level[level]

    @property
    def draw_seed(self) -> int:
        """Of the rows that the growing tree is made from."""
        return self.spec.seed * 100_003 + len(self.trees)

    @property
    def last(self) -> bool:
        """All trees are grown; only the score of the last is missing."""
        return len(self.trees) >= self.spec.n_trees

    def state(self) -> dict:
        opened = [] if self.last else self.open
        allowed = [self.allowed(v).tolist() for v in opened]
        slot = np.full(len(self.tree.feature), -1, np.int64)
        slot[opened] = np.arange(len(opened))
        return {"model": self.number, "held_out": self.held_out, "pending": self.pending, "open": opened, "allowed": allowed,
                "columns": sorted({f for a in allowed for f in a}), "slot": slot, "tree": self.tree.arrays(), "weights": self.weights,
                "score": self.held_out is not None and len(self.history) < len(self.trees) and (self.open == [0] or self.last),
                "subsample": self.spec.subsample, "seed": self.draw_seed}

    def take(self, auc: float | None, leaves: dict[int, Cut]) -> None:
        """The result of a pass: the score of the trees so far, and the best cut of each open leaf."""
        if self.scored(auc):
            return
        for i, v in enumerate(self.open):
            if i in leaves:
                c = leaves[i]
                self.sums.setdefault(v, (c.g, c.h, c.n))
                if c.gain > 1e-12:
                    self.cuts[v] = c
        self.sums.setdefault(0, (0.0, 0.0, 0.0))
        chosen = self._chosen()
        if isinstance(chosen, list):
            self._finish(chosen)

    def scored(self, auc: float | None) -> bool:
        """Takes the score of the trees so far; whether the boosting ends with it."""
        if auc is not None:
            self.history.append(auc)
        self.done = self._over() or (auc is None and self.last)      # no score of the last tree: no row is held out
        return self.done

    def _over(self) -> bool:
        if self.spec.patience and len(self.history) - 1 - int(np.argmax(self.history or [0])) >= self.spec.patience:
            return True
        return self.last and (self.held_out is None or len(self.history) >= len(self.trees))

    def _chosen(self) -> list[int] | None:
        """Nodes to split, best first; or None after opening more leaves."""
        most = self.spec.max_leaves or math.inf
        ready = [(-self.cuts[0].gain, 0)] if 0 in self.cuts else []      # the best first; equal gains in the order of the nodes
        chosen = []
        while ready and len(chosen) + 1 < most:
            v = ready[0][1]
            while self.tree.feature[v] < 0:        # leaves below others may come before it
                room = most - 1 - len(chosen)
                self._expand(room if room == math.inf else max(1, room // self.opens_less))
                if self.open:
                    return None
            heapq.heappop(ready)
            chosen.append(v)
            for child in (self.tree.left[v], self.tree.right[v]):
                if child in self.cuts:
                    heapq.heappush(ready, (-self.cuts[child].gain, child))
        return chosen

    def _expand(self, room: float) -> None:
        """Split the best leaves, as many as there is room for, and open those children that may be split again."""
        leaves = sorted((v for v in self.cuts if self.tree.feature[v] < 0), key=lambda v: -self.cuts[v].gain)
        self.open = []
        for v in leaves[:int(min(room, len(leaves)))]:
            c, t = self.cuts[v], self.tree
            t.feature[v], t.cut[v], t.missing_left[v], t.gain[v] = c.feature, c.cut, c.missing_left, c.gain
            total = self.sums[v]
            for side, part in (("left", (c.gl, c.hl, c.nl)), ("right", tuple(a - b for a, b in zip(total, (c.gl, c.hl, c.nl), strict=True)))):
                child = t.add()
                getattr(t, side)[v] = child
                self.sums[child], self.depth[child] = part, self.depth[v] + 1
                if self.spec.max_depth is None or self.depth[child] < self.spec.max_depth:
                    self.open.append(child)

    def _finish(self, chosen: list[int]) -> None:
        """The tree of the chosen splits alone, with its leaf values."""
        kept, out = set(chosen), Tree()

        def copy(v: int) -> int:
            g, h, n = self.sums[v]
            new = out.add(-self.spec.learning_rate * math.copysign(max(abs(g) - self.spec.alpha, 0), g) / max(h + self.spec.lam, 1e-12), n)
            if v in kept:
                t = self.tree
                out.feature[new], out.cut[new], out.missing_left[new], out.gain[new] = t.feature[v], t.cut[v], t.missing_left[v], t.gain[v]
                out.left[new] = copy(t.left[v])
                out.right[new] = copy(t.right[v])
            return new

        copy(0)
        self.trees.append(out)
        self.pending.append(out.arrays())
        if self.last and self.held_out is None:
            self.done = True
        else:
            self.begin()

    def ensemble(self, features: list[str], edges: list[list[float]]) -> Ensemble:
        kept = int(np.argmax(self.history)) + 1 if self.history else len(self.trees)
        return Ensemble(self.spec, features, edges, self.trees[:kept], self.history, self.held_out)


def _class_weights(rows: DataFrame, jobs: Sequence[tuple[BoostSpec, int | None]]) -> list[tuple[float, float]]:
    counts = [(r.fold, r.label, r.n) for r in rows.filter("label IS NOT NULL").groupBy("fold", "label").agg(
        F.count(F.lit(1)).alias("n")).collect()]                    # a row a fold and class
    out = []
    for spec, held in jobs:
        neg, pos = (sum(n for f, y, n in counts if y == c and (held is None or f != held)) for c in (0, 1))
        if spec.weights == "scale":
            out.append((1.0, float(neg // pos) if pos else 1.0))
        elif spec.weights == "balanced":
            out.append(tuple((neg + pos) / (2.0 * c) if c else 1.0 for c in (neg, pos)))
        else:
            out.append((1.0, 1.0))
    return out


def fit_many(rows: DataFrame, features: Sequence[str], edges: list[list[float]],
             jobs: Sequence[tuple[BoostSpec, int | None]]) -> list[Ensemble]:
    """Fit a model for each (spec, held-out fold or None) over ``binned`` rows, all in the same passes."""
    width, features = len(features), list(features)
    weights = _class_weights(rows, jobs)
    models = [_Model(k, spec, held, weights[k], width) for k, (spec, held) in enumerate(jobs)]
    checkpoint_dir(rows.sparkSession)
    n = rows.filter("label IS NOT NULL").count()
    if n <= WHOLE_ROWS and n * width <= WHOLE_CODES:
        return _fit_whole(rows, n, models, features, edges)
    current, groups, blocks = _blocks(rows, n, len(models), width)
    kept, refreshed = [current.persist(KEPT)], 0
    while live := [m for m in models if not m.done]:
        if sum(len(m.pending) for m in live) >= min(REFRESH, len(live)):
            current = current.mapPartitions(_advanced(groups, [m.state() for m in live]), preservesPartitioning=True).persist(KEPT)
            kept.append(current)
            refreshed += 1
            if refreshed % LINEAGE == 0:
                current.checkpoint()
                current.count()
            for m in live:
                m.pending = []
        live.sort(key=lambda m: (len(m.trees), m.number))          # those behind go first
        turn, size = [], dict.fromkeys(range(groups), 0)
        for m in live:
            size[m.number % groups] += (len(m.open) + 1) * width * 256 * 24
            if turn and max(size.values()) > PASS_BYTES:
                break
            turn.append(m)
        states, specs = [m.state() for m in turn], {m.number: m.spec for m in turn}
        by_number = {s["model"]: s for s in states}

        def sums(it, states=states):
            for block in it:
                for s in _own(states, block[0], groups):
                    yield from _sums(block, s, groups)

        def cuts(it, by_number=by_number, specs=specs):
            return _best([_cuts(key, x, by_number, specs) for key, x in it])

        partial = current.mapPartitions(sums)
        if blocks > 1:                                              # else a task has read all rows of its models
            partial = partial.reduceByKey(np.add, min(blocks * groups, len(turn) * width))
        got: dict[int, list] = {}
        for m, auc, leaves in partial.mapPartitions(cuts).collect():
            got.setdefault(m, []).extend([(m, auc)] if auc is not None else [])
            got[m].append((m, leaves))
        for m in turn:
            (_, auc, leaves), = _best(got.get(m.number, [])) or [(m.number, None, {})]
            m.take(auc, leaves)
        while len(kept) > 1:                                        # the last is in executors now
            kept.pop(0).unpersist()
    for r in kept:
        r.unpersist()
    return [m.ensemble(features, edges) for m in models]


def _grow(model: _Model, draw: np.ndarray, fold: np.ndarray, label: np.ndarray, columns: np.ndarray) -> None:
    """All trees of a model from all labelled rows, with their codes by [feature, row]: what passes give it, without passes."""
    spec, base, model.opens_less = model.spec, np.zeros(len(label)), OPENS_LESS
    held = fold == model.held_out if model.held_out is not None else np.zeros(len(fold), bool)
    by_class, train = [np.flatnonzero(held & (label == y)) for y in (0, 1)], np.flatnonzero(~held)
    bins = int(columns.max(initial=1)) + 1
    while not model.done:
        for tree in model.pending:
            base += _values(tree, columns)
        model.pending = []
        q, auc = 1 / (1 + np.exp(-base)), None
        if model.held_out is not None and len(model.history) < len(model.trees):
            at = np.minimum((q * SCORE_BUCKETS).astype(np.int64), SCORE_BUCKETS - 1)
            neg, pos = (np.bincount(at[own], minlength=SCORE_BUCKETS).astype(float) for own in by_class)
            auc = _auc(pos, neg) if held.any() else None
            if model.scored(auc):
                break
        rows = train
        if spec.subsample < 1:
            rows = train[_uniform(draw[train], model.draw_seed) < spec.subsample]
        y, q = label[rows], q[rows]
        w = np.where(y == 1, model.weights[1], model.weights[0])
        _grow_tree(model, w * (q - y), w * q * (1 - q), columns[model.columns].take(rows, axis=1), bins)


def _grow_tree(model: _Model, g: np.ndarray, h: np.ndarray, codes: np.ndarray, bins: int) -> None:
    """One tree from the rows of its subsample and their codes by [column of the tree, row]. Of two children the one with
    fewer rows is summed, the other is what their parent has beyond it."""
    tree, grown, place = model.tree, len(model.trees), {int(f): i for i, f in enumerate(model.columns)}
    members: dict[int, np.ndarray] = {0: np.arange(len(g))}
    sums: dict[int, np.ndarray] = {}                   # by leaf: [g h n, column, bin]

    def add_sums(leaves: list[int]) -> None:
        rows, slot = np.concatenate([members[v] for v in leaves]), np.repeat(np.arange(len(leaves)) * bins, [len(members[v]) for v in leaves])
        own, out = (g[rows], h[rows], None), np.empty((3, len(codes), len(leaves), bins))
        for i, column in enumerate(codes):
            at = slot + column[rows]
            for k, x in enumerate(own):
                out[k, i] = np.bincount(at, x, len(leaves) * bins).reshape(-1, bins)
        sums.update({v: out[:, :, i] for i, v in enumerate(leaves)})

    add_sums([0])
    model.take(None, _leaf_cuts(model, sums, place))
    while len(model.trees) == grown:
        opened, pairs = set(model.open), []
        for v in list(members):
            f, cut, rows = tree.feature[v], tree.cut[v], members[v]
            if f >= 0:
                left, right = tree.left[v], tree.right[v]
                if left in opened:
                    c = codes[place[f]][rows]
                    goes = c <= cut if tree.missing_left[v] else (c <= cut) & (c > 0)
                    members[left], members[right] = rows[goes], rows[~goes]
                    pairs.append((v, *sorted((left, right), key=lambda x: len(members[x]))))
            if f >= 0 or v not in model.cuts:          # split, or never to be
                del members[v]
        add_sums([few for _, few, _ in pairs])
        for v, few, many in pairs:
            rest = sums[v] - sums[few]
            rest[:2] *= rest[2] > 0                    # nothing is left of a bin without rows
            sums[many] = rest
        sums = {v: sums[v] for v in members}
        model.take(None, _leaf_cuts(model, sums, place))


def _leaf_cuts(model: _Model, sums: dict[int, np.ndarray], place: dict[int, int]) -> dict[int, Cut]:
    """The best cut of each open leaf that has rows, by its place among the open ones."""
    opened, leaves = model.open, len(model.open)
    may = np.zeros((model.width, leaves), bool)
    for i, v in enumerate(opened):
        may[model.allowed(v), i] = True
    columns = np.flatnonzero(may.any(axis=1)).tolist()
    own = [place[f] for f in columns]
    flat = np.stack([sums[v][:, own] for v in opened], axis=2).reshape(3, len(columns) * leaves, -1)
    found = _best_cuts(*flat, model.spec)
    totals = [x.sum(axis=1) for x in flat]
    may = may[columns] & (totals[2].reshape(len(columns), leaves) > 0)
    gain = np.where(may, np.round(found[0].reshape(len(columns), leaves), 9), -1)
    first = gain.argmax(axis=0)                       # equal gains go to the first feature
    at = np.flatnonzero(may.any(axis=0))
    best = first[at] * leaves + at
    values = [x[best].tolist() for x in (*found, *totals)]
    return {i: Cut(*x, columns[first[i]]) for i, x in zip(at.tolist(), zip(*values, strict=True), strict=True)}


def _fit_whole(rows: DataFrame, n: int, models: list[_Model], features: list[str], edges: list[list[float]]) -> list[Ensemble]:
    """``fit_many`` of rows that fit a task: each model is grown by a task of its own that reads all ``n`` rows."""
    width, table = len(features), _packed(rows, max(-(-n // BLOCK_ROWS), 1), len(features))
    whole = table.coalesce(1)

    def of_model(state: dict, spec: BoostSpec):                         # a task is told what a pass is told
        def run(it):
            model = _Model(state["model"], spec, state["held_out"], state["weights"], width)
            none = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0), np.empty((0, width), np.uint8)
            draw, fold, label, codes = (np.concatenate(x) for x in zip(none, *(_unpacked(r, width) for r in it), strict=True))
            _grow(model, draw, fold, label, np.ascontiguousarray(codes.T))
            yield model.number, model.trees, model.history
        return run

    for number, trees, history in rows.sparkSession.sparkContext.union([whole.mapPartitions(of_model(m.state(), m.spec)) for m in models]).collect():
        models[number].trees, models[number].history = trees, history        # the size of the model
    table.unpersist()
    return [m.ensemble(features, edges) for m in models]


# ------------------------------------------------------------------ scoring

def score(df: DataFrame, models: Sequence[Ensemble], keep: Sequence[str], out: Sequence[str]) -> DataFrame:
    """``keep`` and the probability of each model, from the raw columns; null and NaN are missing."""
    features, edges = models[0].features, models[0].edges
    trees = [[t.arrays() for t in m.trees] for m in models]
    schema = T.StructType([*[df.schema[k] for k in keep], *[T.StructField(o, T.DoubleType()) for o in out]])
    rows = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)], *[_number(c).alias(f"c{i}") for i, c in enumerate(features)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = _codes([_doubles(b, f"c{i}") for i in range(len(features))], edges)
            probs = [1 / (1 + np.exp(-_margin({"pending": t}, codes, np.zeros(b.num_rows)))) for t in trees]
            yield pa.RecordBatch.from_arrays([*[b[f"k{i}"] for i in range(len(keep))], *map(pa.array, probs)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _oof(rows: DataFrame, fitted: Sequence[Ensemble], name: str) -> DataFrame:
    """(id, label, fold, model, prob) of the rows that each model left out."""
    trees, width = {m.held_out: [t.arrays() for t in m.trees] for m in fitted}, len(fitted[0].features)
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL("label int, fold int, prob double")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, held = _matrix(b["codes"], width), b["fold"].to_numpy()
            prob = np.zeros(b.num_rows)
            for i, own in trees.items():
                at = np.flatnonzero(held == i)
                prob[at] = 1 / (1 + np.exp(-_margin({"pending": own}, codes[at], np.zeros(len(at)))))
            yield pa.RecordBatch.from_arrays([b["id"], b["label"].cast(pa.int32()), b["fold"], pa.array(prob)], names=schema.names)

    oof = rows.filter(F.col("fold").isin(list(trees)) & F.col("label").isNotNull()).mapInArrow(run, schema)
    return oof.select("id", "label", "fold", F.lit(name).alias("model"), "prob")


def cross_validate(df: DataFrame, spec: BoostSpec, features: Sequence[str], id_col: str, label: str, fold: str = "fold",
                   k: int = 5) -> tuple[DataFrame, list[Ensemble]]:
    """M-06 with M-03 / M-04: OOF table (id, label, fold, model, prob) and the model of each fold. Every fold's rows are
    scored by the model that left them out and stopped by them; all folds are fitted in the same passes."""
    edges = bin_edges(df.filter(F.col(label).isNotNull()), features)
    rows = binned(df, features, edges, id_col, label, fold)
    fitted = fit_many(rows, features, edges, [(spec, i) for i in range(k)])
    return _oof(rows, fitted, spec.name), fitted


def cross_validate_stage(df: DataFrame, spec: BoostSpec, features: Sequence[str], id_col: str, label: str, root: str,
                         fold: str = "fold", k: int = 5, at_once: int | None = None) -> tuple[DataFrame, list[Ensemble], list[int]]:
    """M-12: ``cross_validate`` as a stage below ``root``: folds that are finished there for the same specification and
    the same rows are read, the others fitted ``at_once`` (all) in shared passes. The last value lists these."""
    key = spec_hash(spec, list(features), k, fingerprint(df, [id_col, label, fold, *features]))
    edges = bin_edges(df.filter(F.col(label).isNotNull()), features)
    shared: list[DataFrame] = []

    def compute(folds: list[int]):
        if not shared:
            shared.append(binned(df, features, edges, id_col, label, fold))
        for m in fit_many(shared[0], features, edges, [(spec, i) for i in folds]):
            yield m.held_out, _oof(shared[0], [m], spec.name), m.to_json()

    oof, notes, fitted_now = run_slices(df.sparkSession, root, spec.name, key, range(k), compute, at_once)
    return oof, [Ensemble.from_json(notes[i]) for i in range(k)], fitted_now


def runs(fitted: Sequence[Ensemble]) -> list[tuple]:
    """IO-11 rows (run_id, name, tags, params, metrics, step) of fitted models: what was asked and what was kept."""
    out = []
    for m in fitted:
        params = {n: str(v) for n, v in asdict(m.spec).items() if v is not None}
        metrics = {"n_trees": float(len(m.trees)), "n_rounds": float(len(m.history) or len(m.trees))}
        if m.history:
            metrics |= {"best_iteration": float(len(m.trees) - 1), "auc_roc": m.best_auc}
        out.append((f"{m.spec.name}-fold{m.held_out}", m.spec.name, {"model_type": "boosted", "fold": str(m.held_out)}, params, metrics,
                    m.held_out))
    return out


def search(df: DataFrame, specs: Sequence[BoostSpec], features: Sequence[str], id_col: str, label: str, fold: str = "fold",
           k: int = 3) -> tuple[DataFrame, BoostSpec]:
    """M-07: (trial, name, params, fold_auc, trees, mean_auc) of each spec over k folds, and the spec of the best mean AUC.

    All folds of all trials are fitted side by side, each stopped by its held-out fold. Ties go to the earlier trial."""
    edges = bin_edges(df.filter(F.col(label).isNotNull()), features)
    rows = binned(df, features, edges, id_col, label, fold)
    fitted = fit_many(rows, features, edges, [(s, i) for s in specs for i in range(k)])
    table = []
    for t, s in enumerate(specs):
        own = fitted[t * k:(t + 1) * k]
        aucs = [float(m.best_auc) for m in own]
        params = {n: str(v) for n, v in asdict(s).items() if n != "name" and v is not None}
        table.append((t, s.name, params, aucs, [len(m.trees) for m in own], float(np.mean(aucs))))
    best = min(table, key=lambda r: (-r[-1], r[0]))
    out = df.sparkSession.createDataFrame(table, "trial int, name string, params map<string,string>, fold_auc array<double>, "
                                                 "trees array<int>, mean_auc double")
    return out, specs[best[0]]


def fit(df: DataFrame, spec: BoostSpec, features: Sequence[str], id_col: str, label: str, n_trees: int | None = None) -> Ensemble:
    """M-10: one model of all labelled rows, of ``n_trees`` trees where given."""
    return fit_all(df, [replace(spec, n_trees=n_trees or spec.n_trees)], features, id_col, label)[0]


def fit_all(df: DataFrame, specs: Sequence[BoostSpec], features: Sequence[str], id_col: str, label: str) -> list[Ensemble]:
    """M-10: a model of all labelled rows for each specification, binned alike and fitted side by side."""
    labelled = df.filter(F.col(label).isNotNull())
    edges = bin_edges(labelled, features)
    return fit_many(binned(labelled, features, edges, id_col, label), features, edges, [(s, None) for s in specs])
