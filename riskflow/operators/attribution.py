"""Per-row attributions for tree ensembles (M-13, S-05).

Shapley values (``shapley_attributions``): the value of a set of features is the mean over the training rows of the
tree's answer when only these features of the row are known. For one leaf, the features on its path are independent
factors: known, a feature lets the row through or not; unknown, it lets the share of rows through that went this way in
training. The product of these factors as a polynomial (one degree a known feature) gives the weights of all subsets
at once; taking one factor out again gives those without that feature. So a leaf costs the square of its path's length,
not the number of subsets, and whole batches of rows are done together.

Path attribution: walking a row down a tree, every split moves the node value
from the parent's to the child's; the change is credited to the split's
feature. Summed over the trees (times the tree weights), the contributions
plus the weighted root values equal the ensemble margin exactly (local
accuracy), which the tests check against Spark's ``rawPrediction``.

The fitted forest is flattened once on the driver into a few numpy arrays
(its size is fixed by the model - trees x nodes - not by the data), shipped
with the task closure, and applied per Arrow batch in ``mapInPandas``: a
vectorized walk, ``depth`` numpy steps per tree for the whole batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import factorial

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def _flatten_tree(root) -> dict[str, list]:
    feat, thr, left, right, val, cover = [], [], [], [], [], []

    def add(node) -> int:
        i = len(feat)
        feat.append(-1)
        thr.append(0.0)
        left.append(-1)
        right.append(-1)
        val.append(float(node.prediction()))
        cover.append(float(node.impurityStats().count()))
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            feat[i] = int(split.featureIndex())
            thr[i] = float(split.threshold())
            left[i] = add(node.leftChild())
            right[i] = add(node.rightChild())
        return i

    add(root)
    return {"feature": feat, "threshold": thr, "left": left, "right": right, "value": val, "cover": cover}


def flatten_forest(model) -> dict:
    """Tree ensemble (GBT or random forest classifier/regressor) -> numpy arrays per tree.
    Forest probabilities average class distributions; only GBT margins are attributed here."""
    trees = [_flatten_tree(t._java_obj.rootNode()) for t in model.trees]
    weights = [float(w) for w in model.treeWeights]
    depth = max(int(t.depth) for t in model.trees)
    return {"trees": [{k: np.asarray(v) for k, v in t.items()} for t in trees], "weights": weights, "depth": depth}


def _contributions(x: np.ndarray, forest: dict) -> tuple[np.ndarray, np.ndarray]:
    n, m = x.shape
    phi = np.zeros((n, m))
    base = 0.0
    rows = np.arange(n)
    for t, w in zip(forest["trees"], forest["weights"]):
        base += w * t["value"][0]
        node = np.zeros(n, dtype=np.int64)
        for _ in range(forest["depth"]):
            f = t["feature"][node]
            internal = f >= 0
            if not internal.any():
                break
            fi = np.where(internal, f, 0)
            go_left = x[rows, fi] <= t["threshold"][node]
            child = np.where(go_left, t["left"][node], t["right"][node])
            child = np.where(internal, child, node)
            delta = np.where(internal, t["value"][child] - t["value"][node], 0.0)
            np.add.at(phi, (rows, fi), w * delta)
            node = child
    return phi, np.full(n, base)


def tree_attributions(df: DataFrame, model: PipelineModel, features: Sequence[str], keep: Sequence[str],
                      fill: float = -999.0) -> DataFrame:
    """Wide output: keep..., base, phi_<feature>..., margin (= base + sum of phi)."""
    forest = flatten_forest(model.stages[-1])
    feats = list(features)
    out_schema = StructType([df.schema[k] for k in keep]
                            + [StructField("base", DoubleType())]
                            + [StructField(f"phi_{f}", DoubleType()) for f in feats]
                            + [StructField("margin", DoubleType())])
    src = df.select(*keep, *[F.coalesce(F.col(f).cast("double"), F.lit(float(fill))).alias(f) for f in feats])

    def run(batches):
        for b in batches:
            x = b[feats].to_numpy(dtype=np.float64)
            phi, base = _contributions(x, forest)
            out = b[list(keep)].copy()
            out["base"] = base
            for j, f in enumerate(feats):
                out[f"phi_{f}"] = phi[:, j]
            out["margin"] = base + phi.sum(axis=1)
            yield out

    return src.mapInPandas(run, out_schema)


def leaf_paths(tree: dict[str, np.ndarray]) -> list[tuple[float, list[tuple[int, float, list[tuple[int, bool]]]]]]:
    """(value, [(feature, share of the training rows it lets through, [(node, goes left)])]) of each leaf."""
    out = []

    def down(node: int, steps: dict[int, tuple[float, list]]) -> None:
        f = int(tree["feature"][node])
        if f < 0:
            out.append((float(tree["value"][node]), [(k, z, way) for k, (z, way) in steps.items()]))
            return
        for child, left in ((int(tree["left"][node]), True), (int(tree["right"][node]), False)):
            z, way = steps.get(f, (1.0, []))
            share = tree["cover"][child] / tree["cover"][node] if tree["cover"][node] else 0.0
            down(child, {**steps, f: (z * float(share), [*way, (node, left)])})

    down(0, {})
    return out


#: Steps of a path of which all ways through are worked out once for each leaf: 2 to the power of them.
TABLE_STEPS = 8


def _shares(value: float, shares: Sequence[float], through: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Shapley values of the features on the path to a leaf, for rows that each of its steps lets through (1) or not (0)."""
    d, out = len(shares), []
    product = np.zeros((d + 1, len(through[0])))
    product[0] = 1.0
    for k, (z, o) in enumerate(zip(shares, through, strict=True)):
        product[1:k + 2] = z * product[1:k + 2] + o * product[:k + 1]
        product[0] *= z
    weight = [factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)]
    for z, o in zip(shares, through, strict=True):
        known = o > 0
        rest, total = product[d].copy(), np.zeros(len(o))      # the product without this factor, from the top
        for s in range(d - 1, -1, -1):
            unknown = product[s] / z if z else 0.0
            total += weight[s] * np.where(known, rest, unknown)
            rest = product[s] - z * rest
        out.append(value * (o - z) * total)
    return out


def leaf_tables(paths: list) -> list[np.ndarray | None]:
    """Of each leaf with at most ``TABLE_STEPS`` features on its path, the Shapley values [way through, feature of the path]:
    bit k of the way says whether step k lets a row through."""
    out = []
    for value, steps in paths:
        if 0 < len(steps) <= TABLE_STEPS:
            ways = np.arange(1 << len(steps))
            out.append(np.stack(_shares(value, [z for _, z, _ in steps], [(ways >> k & 1).astype(float) for k in range(len(steps))]), axis=1))
        else:
            out.append(None)
    return out


def shapley(goes_left: np.ndarray, paths: list, n_features: int, tables: list | None = None) -> np.ndarray:
    """Shapley values [row, feature] of one tree, given for each row and node whether it goes left there."""
    phi, by_node = np.zeros((n_features, len(goes_left))), np.ascontiguousarray(goes_left.T)
    for (value, steps), table in zip(paths, tables or leaf_tables(paths), strict=True):
        if not value or not steps:
            continue
        through = [np.logical_and.reduce([by_node[v] if left else ~by_node[v] for v, left in way]) for _, _, way in steps]
        if table is None:
            shares = _shares(value, [z for _, z, _ in steps], [o.astype(float) for o in through])
        else:
            way = sum(o.astype(np.intp) << k for k, o in enumerate(through))
            shares = [table[:, k][way] for k in range(len(steps))]
        for (f, _, _), x in zip(steps, shares, strict=True):
            phi[f] += x
    return phi.T


def _boosted(model) -> tuple[list[dict], list[list[float]] | None]:
    """Trees as arrays with their weights taken in, and the cut points of binned columns (None: raw thresholds)."""
    if hasattr(model, "edges"):
        return [t.arrays() for t in model.trees], model.edges
    forest = flatten_forest(model.stages[-1])
    return [{**t, "value": t["value"] * w} for t, w in zip(forest["trees"], forest["weights"], strict=True)], None


def shapley_attributions(df: DataFrame, model, features: Sequence[str], keep: Sequence[str], fill: float = -999.0,
                         rows_at_once: int = 4096) -> DataFrame:
    """M-13: keep..., base, phi_<feature>..., margin (= base + sum of phi) of a boosted ``Ensemble`` (missing values as
    it learned them) or of an MLlib boosted pipeline (missing values filled with ``fill``). ``base`` is the mean margin of
    the training rows. The flattened trees travel with the tasks; their size is that of the model."""
    trees, edges = _boosted(model)
    paths = [leaf_paths(t) for t in trees]
    tables: list[list] = []
    base = float(sum(v * np.prod([z for _, z, _ in steps]) for p in paths for v, steps in p))
    feats = list(features)
    schema = StructType([*[df.schema[k] for k in keep], StructField("base", DoubleType()),
                         *[StructField(f"phi_{f}", DoubleType()) for f in feats], StructField("margin", DoubleType())])
    number = [F.col(f"`{f}`").cast("double") for f in feats]
    src = df.select(*keep, *[(x if edges else F.coalesce(x, F.lit(float(fill)))).alias(f"x{i}") for i, x in enumerate(number)])

    def left(x: np.ndarray, tree: dict) -> np.ndarray:
        f = np.maximum(tree["feature"], 0)
        if edges is None:
            return x[:, f] <= tree["threshold"]
        return np.where(x[:, f] == 0, tree["missing_left"], x[:, f] <= tree["cut"])

    def run(batches):
        for whole in batches:
            if not tables:
                tables.extend(leaf_tables(p) for p in paths)          # once a task
            for at in range(0, len(whole), rows_at_once):
                b = whole.iloc[at:at + rows_at_once]
                x = b[[f"x{i}" for i in range(len(feats))]].to_numpy(dtype=np.float64)
                if edges is not None:
                    x = np.stack([np.where(np.isnan(c), 0, np.searchsorted(np.asarray(e, float), c, "left") + 1)
                                  for c, e in zip(x.T, edges, strict=True)], axis=1)
                phi = np.zeros((len(b), len(feats)))
                for tree, p, t in zip(trees, paths, tables, strict=True):
                    phi += shapley(left(x, tree), p, len(feats), t)
                out = b[list(keep)].copy()
                out["base"] = base
                for j, f in enumerate(feats):
                    out[f"phi_{f}"] = phi[:, j]
                out["margin"] = base + phi.sum(axis=1)
                yield out

    return src.mapInPandas(run, schema)


def contributions(features: Sequence[str]):
    """array<feature, contribution> of a wide row."""
    return F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`phi_{f}`").alias("contribution")) for f in features])


def to_long(wide: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep..., feature, contribution) from the wide attribution table (for reason codes)."""
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"phi_{f}").alias("contribution")) for f in features])
    return wide.select(*keep, F.explode(arr).alias("x")).select(*keep, "x.feature", "x.contribution")


def mean_abs(long: DataFrame) -> DataFrame:
    """Global importance: mean |contribution| per feature."""
    return long.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))


__all__ = ["contributions", "flatten_forest", "leaf_paths", "shapley", "shapley_attributions", "tree_attributions", "to_long", "mean_abs"]
