"""Isolation forest (Liu, Ting, Zhou 2008) on Spark.

* Sampling: one Bernoulli pass draws a pool of about ``2·T·ψ`` rows (bounded,
  independent of the table size); each pooled row is copied to
  ``k = ceil(2·T·ψ / n)`` trees (k = 1 for big tables) chosen by hash. Every
  tree then sees ~2ψ random rows and keeps the ψ with the smallest hash.
* Building: ``groupBy(tree).applyInPandas`` grows each tree from its ≤ 2ψ rows
  (one small task per tree, never a large group).
* Scoring: the forest has at most ``T·(2ψ−1)`` nodes (a proven bound, a few MB),
  so it ships inside an Arrow-batched pandas UDF that walks all trees with
  vectorised NumPy; score = 2^(−E[h(x)] / c(ψ)).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EULER_GAMMA = 0.5772156649015329


def c_factor(n: np.ndarray | float) -> np.ndarray:
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    out = np.where(n == 2, 1.0, out)
    big = n > 2
    nb = np.where(big, n, 3.0)
    out = np.where(big, 2.0 * (np.log(nb - 1.0) + EULER_GAMMA) - 2.0 * (nb - 1.0) / nb, out)
    return out


@dataclass
class Forest:
    feature: np.ndarray    # (T, M) int, -1 for leaves
    threshold: np.ndarray  # (T, M) float
    left: np.ndarray       # (T, M) int
    right: np.ndarray      # (T, M) int
    size: np.ndarray       # (T, M) int
    depth: np.ndarray      # (T, M) int
    psi: int
    max_depth: int


NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, size int, depth int")


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    nodes: list[list] = []

    def build(idx: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, len(idx), depth])
        if depth >= limit or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.nonzero(hi > lo)[0]
        if len(cand) == 0:
            return me
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < t
        nodes[me][0], nodes[me][1] = f, t
        nodes[me][2] = build(idx[go_left], depth + 1)
        nodes[me][3] = build(idx[~go_left], depth + 1)
        return me

    build(np.arange(len(x)), 0)
    return [tuple(n) for n in nodes]


def fit(df: DataFrame, features: list[str], n_trees: int = 400, max_samples: int = 256,
        seed: int = 42, key: str | None = None) -> Forest:
    n = df.count()
    if n == 0:
        raise ValueError("no rows to fit")
    psi = min(max_samples, n)
    limit = int(math.ceil(math.log2(max(psi, 2))))
    want = 2 * n_trees * psi
    frac = min(1.0, want / n)
    copies = max(1, math.ceil(want / n))
    rid = F.xxhash64(*([F.col(key)] if key else [F.col(c) for c in features]), F.lit(seed))
    pool = df.select(*features, rid.alias("_rid"))
    if frac < 1.0:
        pool = pool.sample(withReplacement=False, fraction=frac, seed=seed)
    pool = (pool.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
            .withColumn("tree", F.pmod(F.xxhash64("_rid", "_copy", F.lit(seed + 1)), F.lit(n_trees)).cast("int"))
            .withColumn("_h", F.xxhash64("_rid", "tree", F.lit(seed + 2))))
    feats = list(features)

    def grow_tree(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        pdf = pdf.drop_duplicates("_rid").sort_values("_h").head(psi)
        x = pdf[feats].to_numpy(dtype=np.float64)
        x = np.nan_to_num(x, nan=0.0)
        rng = np.random.default_rng(seed * 100_003 + t)
        rows = _grow(x, rng, limit)
        out = pd.DataFrame(rows, columns=["feature", "threshold", "left", "right", "size", "depth"])
        out.insert(0, "node", np.arange(len(out), dtype=np.int32))
        out.insert(0, "tree", t)
        return out

    nodes = pool.groupBy("tree").applyInPandas(grow_tree, NODE_SCHEMA).toPandas()
    return forest_of(nodes, n_trees, psi, limit)


def forest_of(nodes: pd.DataFrame, n_trees: int, psi: int, max_depth: int) -> Forest:
    """A forest from its node rows (at most trees × (2ψ − 1) of them)."""
    width = int(nodes["node"].max()) + 1 if len(nodes) else 1
    arr = {k: np.full((n_trees, width), -1 if k != "threshold" else 0.0,
                      dtype=np.float64 if k == "threshold" else np.int64)
           for k in ("feature", "threshold", "left", "right", "size", "depth")}
    ti, ni = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
    for k in arr:
        arr[k][ti, ni] = nodes[k].to_numpy()
    # trees that received no rows: a single empty leaf
    empty = ~np.isin(np.arange(n_trees), np.unique(ti))
    arr["size"][empty, 0] = 0
    arr["depth"][empty, 0] = 0
    return Forest(arr["feature"], arr["threshold"], arr["left"], arr["right"], arr["size"], arr["depth"],
                  psi, max_depth)


def nodes_frame(spark, forest: Forest) -> DataFrame:
    """The node rows of a forest, as ``forest_of`` takes them."""
    t, n = np.nonzero(forest.depth >= 0)
    return spark.createDataFrame(pd.DataFrame({"tree": t, "node": n} | {
        k: getattr(forest, k)[t, n] for k in ("feature", "threshold", "left", "right", "size", "depth")}), NODE_SCHEMA)


def path_lengths(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Mean path length over trees for each row of x (vectorised per tree)."""
    n = x.shape[0]
    total = np.zeros(n)
    T = forest.feature.shape[0]
    rows = np.arange(n)
    for t in range(T):
        node = np.zeros(n, dtype=np.int64)
        for _ in range(forest.max_depth + 1):
            f = forest.feature[t, node]
            inner = f >= 0
            if not inner.any():
                break
            fv = x[rows, np.where(inner, f, 0)]
            go_left = fv < forest.threshold[t, node]
            nxt = np.where(go_left, forest.left[t, node], forest.right[t, node])
            node = np.where(inner, nxt, node)
        total += forest.depth[t, node] + c_factor(forest.size[t, node])
    return total / T


def score(df: DataFrame, forest: Forest, features: list[str], out: str = "anomaly") -> DataFrame:
    """Anomaly score 2^(−E[h]/c(ψ)) in (0, 1]; higher is more anomalous."""
    cpsi = float(c_factor(forest.psi)) or 1.0

    @F.pandas_udf("double")
    def _score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=np.float64) for c in cols])
        x = np.nan_to_num(x, nan=0.0)
        return pd.Series(np.power(2.0, -path_lengths(forest, x) / cpsi))

    return df.withColumn(out, _score(*[F.col(c).cast("double") for c in features]))
