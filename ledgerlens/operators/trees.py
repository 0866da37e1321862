"""Forests as a table of tree nodes: grown tree by tree in tasks, united over fits, scored in one projection.

A node is a row (tree, node, left, right, feature, threshold, p): inner nodes send a row left
if its feature is at most the threshold (a missing value goes right), leaves (left = -1) hold
the probability of the positive class. The probability of a forest is the mean of its trees, so
forests of several fits unite by numbering their trees anew, and a united forest of equally many
trees per fit gives the mean of the fits.

``Forest`` grows the trees of ``RandomForestClassifier`` (same parameters, impurity, bootstrap counts, feature choice of
every node, merged leaves) from counted cells (:mod:`ledgerlens.operators.cells`): every task takes some trees and the
cells, at most ``MOST_CELLS``, and grows its trees level by level. More cells go to Spark's own forest, whose every open node is a
histogram summed over all parts, in batches of ``BATCH`` trees as concurrent jobs with cached node ids.
Node tables are written to the shared folder. A projection (``probability``) carries the trees to the rows, at most ``MAX_NODES`` nodes
at a time. Beyond ``NEAR_NODES`` nodes ``packed`` and ``scored`` leave the trees where they are: the distinct cells of the rows meet packs of
trees in pairs of bounded size, and the rows take the mean of their cell.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ledgerlens.operators import cells as C
from ledgerlens.session import scratch_path

NODES = "tree int, node int, left int, right int, feature int, threshold double, p double"
BATCH = 100
#: Nodes that one scorer carries: about 28 bytes each in a task.
MAX_NODES = 8_000_000
#: Nodes that a projection carries to the rows, nodes of a pack of trees and cells of a block; one tree is never divided.
NEAR_NODES, PACK_NODES, BLOCK_CELLS = 1_000_000, 500_000, 50_000
#: Cells from which a task grows a tree: about 100 bytes each while it does.
MOST_CELLS = 1_000_000
#: Histogram bins that a task holds at a time.
MOST_BINS = 2_000_000


def stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nodes_of(model: RandomForestClassificationModel | ForestModel, like: DataFrame) -> DataFrame:
    """The node table of a fitted two-class forest, by way of its stored form (nothing comes to the driver)."""
    if isinstance(model, ForestModel):
        return model.nodes
    path = scratch_path(like.sparkSession, "forest")
    model.write().save(path)
    return nodes_in(like.sparkSession, path)


def nodes_in(spark: SparkSession, path: str) -> DataFrame:
    """The node table of a two-class forest in Spark's stored form."""
    raw = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    return raw.select(F.col("tree").cast("int"), F.col("id").cast("int").alias("node"), F.col("leftChild").cast("int").alias("left"),
                      F.col("rightChild").cast("int").alias("right"), F.col("split.featureIndex").cast("int").alias("feature"),
                      F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
                      (F.get("impurityStats", F.lit(1)) / (F.get("impurityStats", F.lit(0)) + F.get("impurityStats", F.lit(1)))).alias("p"))


def grow(train: DataFrame, make: Callable[[int, int], RandomForestClassifier], n_trees: int, batch: int | None = None, at_once: int = 4) -> DataFrame:
    """The node table of ``n_trees`` trees grown on ``train``, written once.

    ``make(n, k)`` is the estimator of n trees with a seed of its own for each k; ``train`` is read by every batch, so it
    should be a stored table. Without ``batch`` one estimator grows them all.
    """
    batch = batch or n_trees
    sizes = [min(batch, n_trees - at) for at in range(0, n_trees, batch)]

    def one(k: int) -> DataFrame:
        return nodes_of(make(sizes[k], 1_000_003 * k).fit(train), train)

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        parts = list(pool.map(one, range(len(sizes))))
    return parts[0] if len(parts) == 1 and isinstance(parts[0], DataFrame) else stored(_numbered(parts, sizes), "forest-nodes")

class ForestModel:
    """A fitted forest: its node table."""

    def __init__(self, nodes: DataFrame, features_col: str):
        self.nodes, self.features_col = nodes, features_col

    def transform(self, df: DataFrame) -> DataFrame:
        p = _mean(self.nodes, vector_to_array(self.features_col))
        return df.withColumn("probability", array_to_vector(F.array(1.0 - p, p)))


class Forest(RandomForestClassifier):
    """``RandomForestClassifier`` for two classes whose trees grow in tasks, from the counted cells of the training rows."""

    def _fit(self, dataset: DataFrame) -> ForestModel:
        label, weight = self.getLabelCol(), self.getWeightCol() if self.isSet("weightCol") else None
        cuts = C.edges(dataset, self.getMaxBins(), self.getFeaturesCol())
        by = [c for c in (label, weight) if c]
        found = stored(C.counted(dataset, cuts, by, self.getFeaturesCol()), "cells")
        if found.filter(~F.col(label).isin(0.0, 1.0) | F.col(label).isNull() | F.isnan(label)).limit(1).count():
            raise ValueError(f"labels other than 0 and 1 in {label}")
        n = found.count()
        nodes = self._by_tree(found, n, cuts, label, weight) if n <= MOST_CELLS else self._by_histograms(dataset)
        return ForestModel(nodes, self.getFeaturesCol())

    def _by_tree(self, found: DataFrame, n: int, cuts: list[list[float]], label: str, weight: str | None) -> DataFrame:
        spark, n_trees = found.sparkSession, self.getNumTrees()
        rows = found.orderBy(*found.columns).toArrow()  # at most MOST_CELLS; in one order, so that a seed gives one forest
        x = rows["cell"].combine_chunks().flatten().to_numpy().reshape(n, -1).astype(np.uint8 if self.getMaxBins() <= 256 else np.uint16)
        y, count = rows[label].to_numpy() > 0, rows["n"].to_numpy()
        w = rows[weight].to_numpy() if weight else np.ones(n)
        choose, depth, least, seed = math.ceil(math.sqrt(len(cuts))), self.getMaxDepth(), self.getMinInstancesPerNode(), self.getSeed()

        def trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for t in batch["id"]:
                    one = _grown(x, y, count, w, cuts, choose, depth, least, np.random.default_rng([abs(seed), int(seed < 0), t]))
                    one.insert(0, "tree", np.int32(t))
                    yield one

        tasks = max(1, min(n_trees, 4 * spark.sparkContext.defaultParallelism))
        return stored(spark.range(0, n_trees, 1, tasks).mapInPandas(trees, NODES), "forest")

    def _by_histograms(self, dataset: DataFrame) -> DataFrame:
        def plain(n: int, k: int) -> RandomForestClassifier:
            own = {p.name: v for p, v in self.extractParamMap().items() if self.isSet(p)}
            return RandomForestClassifier(**own | {"numTrees": n, "seed": self.getSeed() + k})

        return grow(dataset, plain, self.getNumTrees(), BATCH)


def unbinned(model: GBTClassificationModel, cuts: Sequence[Sequence[float]], spark: SparkSession) -> GBTClassificationModel:
    """The model with the edges of bins as thresholds, by way of its stored form."""
    binned, path = scratch_path(spark, "boosting"), scratch_path(spark, "boosting")
    model.write().save(binned)
    edge = F.create_map(*(v for i, values in enumerate(cuts) for v in (F.lit(i), F.array(*map(F.lit, values)).cast("array<double>"))))
    split = F.col("nodeData.split")
    at = F.floor(F.get(split["leftCategoriesOrThreshold"], F.lit(0))).cast("int")
    raw = F.when(split["featureIndex"] >= 0, F.array(F.get(edge[split["featureIndex"]], at))).otherwise(split["leftCategoriesOrThreshold"])
    data = spark.read.parquet(f"{binned}/data")
    data.withColumn("nodeData", F.col("nodeData").withField("split.leftCategoriesOrThreshold", raw)).write.parquet(f"{path}/data")
    spark.read.parquet(f"{binned}/treesMetadata").write.parquet(f"{path}/treesMetadata")
    spark.read.text(f"{binned}/metadata").coalesce(1).write.text(f"{path}/metadata")
    return GBTClassificationModel.load(path)


def _grown(x: np.ndarray, y: np.ndarray, count: np.ndarray, w: np.ndarray, cuts: Sequence[Sequence[float]], choose: int, depth: int, least: int,
           rng: np.random.Generator) -> pd.DataFrame:
    """The nodes of one tree grown on a bootstrap of counted cells: bins x, class y, and the number and weight of a cell's rows."""
    drawn = rng.poisson(count)
    drawn = drawn if drawn.any() else count  # few rows may all be left out
    x, y, n = x[drawn > 0], y[drawn > 0], drawn[drawn > 0].astype(float)
    both = n * w[drawn > 0]
    pos, nb = np.where(y, both, 0.0), max(len(c) for c in cuts) + 1
    at, size, base, levels = np.zeros(len(x), dtype=np.int64), 1, 0, []
    for level in range(depth + 1):
        s, p, c = (np.bincount(at, v, size) for v in (both, pos, n))
        feature, cut = np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=np.int32)
        if level < depth:
            open_ = np.flatnonzero((p > 0) & (p < s) & (c >= 2 * least))
            rank = np.full(size, -1)
            rank[open_] = np.arange(len(open_))
            keep = rank[at] >= 0
            order = np.flatnonzero(keep)[np.argsort(rank[at[keep]], kind="stable")]
            x, n, both, pos, at = x[order], n[order], both[order], pos[order], at[order]
            begin = np.append(np.searchsorted(at, open_), len(at))
            step = max(1, MOST_BINS // nb)
            for a in range(0, len(open_), step):
                b = min(a + step, len(open_))
                rows = slice(begin[a], begin[b])
                feature[open_[a:b]], cut[open_[a:b]] = _best(x[rows], n[rows], both[rows], pos[rows], rank[at[rows]] - a, b - a, nb, choose, least, rng)
        split = feature >= 0
        left = np.where(split, base + size + 2 * (np.cumsum(split) - 1), -1)
        levels.append((left, feature, cut, s, p))
        base += size
        if not split.any():
            break
        stay = split[at]
        x, n, both, pos, at = x[stay], n[stay], both[stay], pos[stay], at[stay]
        at = left[at] - base + (x[np.arange(len(x)), feature[at]] > cut[at])
        size = 2 * int(split.sum())
    left, feature, cut, s, p = (np.concatenate(v) for v in zip(*levels, strict=True))
    left, kept = _merged(left, p > s - p, np.cumsum([0] + [len(v[0]) for v in levels]))
    number = np.cumsum(kept) - 1
    left, feature, cut, s, p = (v[kept] for v in (left, feature, cut, s, p))
    inner = left >= 0
    flat = np.full((len(cuts), nb), np.nan)
    for i, values in enumerate(cuts):
        flat[i, :len(values)] = values
    down = np.where(inner, number[left], -1).astype(np.int32)
    return pd.DataFrame({"node": np.arange(len(left), dtype=np.int32), "left": down, "right": np.where(inner, down + 1, -1).astype(np.int32),
                         "feature": np.where(inner, feature, -1).astype(np.int32), "threshold": np.where(inner, flat[feature, cut], np.nan), "p": p / s})


def _best(x: np.ndarray, n: np.ndarray, both: np.ndarray, pos: np.ndarray, at: np.ndarray, size: int, nb: int, choose: int, least: int,
          rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(feature, last bin to the left) of the split of every node that lowers the Gini impurity most, of features drawn for it; -1 if none does."""
    d = x.shape[1]
    drawn = np.argpartition(rng.random((size, d)), min(choose, d) - 1, axis=1)[:, :choose]
    feature, cut, row = np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=np.int32), np.arange(len(x))
    s, p = (np.bincount(at, v, size) for v in (both, pos))
    now = p * (s - p) / s
    best = now * (1 - 1e-12)
    for j in range(drawn.shape[1]):
        key = at * nb + x[row, drawn[at, j]]
        ls, lp, lc = (np.bincount(key, v, size * nb).reshape(size, nb).cumsum(axis=1) for v in (both, pos, n))
        rs, rp, rc = ls[:, -1:] - ls, lp[:, -1:] - lp, lc[:, -1:] - lc
        with np.errstate(divide="ignore", invalid="ignore"):
            impurity = lp * (ls - lp) / ls + rp * (rs - rp) / rs
        impurity[(lc < least) | (rc < least)] = np.inf
        k = impurity.argmin(axis=1)
        found = impurity[np.arange(size), k]
        better = found < best
        best[better], feature[better], cut[better] = found[better], drawn[better, j], k[better]
    return feature, cut


def _merged(left: np.ndarray, positive: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two leaves that predict one class become their parent, from below, as in Spark's forests: (left children, nodes that stay)."""
    left = left.copy()
    for a, b in reversed(list(zip(ends[:-1], ends[1:], strict=True))):
        inner = a + np.flatnonzero(left[a:b] >= 0)
        child = left[inner]
        left[inner[(left[child] < 0) & (left[child + 1] < 0) & (positive[child] == positive[child + 1])]] = -1
    kept = np.zeros(len(left), dtype=bool)
    kept[0] = True
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        inner = a + np.flatnonzero((left[a:b] >= 0) & kept[a:b])
        kept[left[inner]] = kept[left[inner] + 1] = True
    return left, kept


def _numbered(parts: Sequence[DataFrame], sizes: Sequence[int]) -> DataFrame:
    """The first ``sizes[k]`` trees of each part under numbers of their own."""
    out, base = None, 0
    for part, size in zip(parts, sizes, strict=True):
        part = part.filter(F.col("tree") < size).withColumn("tree", (F.col("tree") + base).cast("int"))
        out, base = part if out is None else out.unionByName(part), base + size
    return out


def unite(forests: Sequence[DataFrame], max_trees: int | None = None) -> DataFrame:
    """One forest of all trees; beyond ``max_trees`` every forest gives equally many of its first trees."""
    sizes = [f.agg(F.max("tree")).first()[0] + 1 for f in forests]
    if max_trees and sum(sizes) > max_trees:
        sizes = [min(s, max(1, max_trees // len(forests))) for s in sizes]
    return stored(_numbered(forests, sizes), "forest-union")


def _chunks(nodes: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of trees whose nodes fit in one scorer."""
    sizes = sorted((r["tree"], r["n"]) for r in nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per tree
    if max(n for _, n in sizes) > most:
        raise ValueError(f"a tree of more than {most} nodes: raise the least number of rows of a leaf")
    out, held = [[sizes[0][0], sizes[0][0]]], 0
    for tree, n in sizes:
        if held + n > most:
            out.append([tree, tree])
            held = 0
        out[-1][1], held = tree, held + n
    return [tuple(x) for x in out]


def _arrays(nodes: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """(feature, threshold, left, right, p, roots) of trees one after the other; leaves have no children (-1)."""
    nodes = nodes.sort_values(["tree", "node"], kind="stable")
    tree, base = np.unique(nodes["tree"].to_numpy(), return_index=True)
    start = np.repeat(base, np.diff(np.append(base, len(nodes)))).astype(np.int32)
    if not (nodes["node"].to_numpy() == np.arange(len(nodes)) - start).all():
        raise ValueError("the nodes of a tree must be numbered from 0 without gaps")
    leaf = nodes["left"].to_numpy() < 0
    left = np.where(leaf, -1, nodes["left"].to_numpy() + start).astype(np.int32)
    right = np.where(leaf, -1, nodes["right"].to_numpy() + start).astype(np.int32)
    feature = np.where(leaf, 0, nodes["feature"].to_numpy()).astype(np.int32)
    threshold = np.where(leaf, 0.0, nodes["threshold"].fillna(0.0).to_numpy())
    return feature, threshold, left, right, nodes["p"].to_numpy(), base.astype(np.int32)


def _scorer(nodes: pd.DataFrame):
    """A projection that sums the leaf probabilities of these trees over a row of features."""
    feature, threshold, left, right, p, roots = _arrays(nodes)

    @pandas_udf("double")
    def total(xs: pd.Series) -> pd.Series:
        out = np.zeros(len(xs))
        for at in range(0, len(xs), 1024):
            x = np.stack(xs.iloc[at:at + 1024].to_numpy()).astype(float)
            row, node = np.repeat(np.arange(len(x)), len(roots)), np.tile(roots, len(x))
            while len(node):
                down = left[node] >= 0
                done = ~down
                out[at:at + len(x)] += np.bincount(row[done], p[node[done]], len(x))
                row, node = row[down], node[down]
                node = np.where(x[row, feature[node]] <= threshold[node], left[node], right[node])
        return pd.Series(out)

    return total


def probability(nodes: DataFrame, features: Sequence[str], most: int | None = None) -> Column:
    """The mean leaf probability of the trees of a node table for a row of ``features``."""
    return _mean(nodes, F.array(*(F.col(c).cast("double") for c in features)), most)


def _mean(nodes: DataFrame, x: Column, most: int | None = None) -> Column:
    chunks = _chunks(nodes, most or MAX_NODES)
    trees = nodes.select("tree").distinct().count()
    parts = [_scorer(nodes.filter(F.col("tree").between(a, b)).toPandas())(F.transform(x, lambda v: F.coalesce(v, F.lit(float("nan"))))) for a, b in chunks]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total / F.lit(float(trees))


def packed(nodes: DataFrame, n_features: int) -> tuple[list[list[float]], int, DataFrame] | None:
    """(edges between the bins of every feature, trees, packs of trees) of a node table; None if it is small enough for a projection."""
    n, trees = nodes.agg(F.count(F.lit(1)), F.max("tree") + 1).first()
    if n <= NEAR_NODES:
        return None
    cuts, found = [[] for _ in range(n_features)], nodes.filter("left >= 0").groupBy("feature").agg(F.sort_array(F.collect_set("threshold")).alias("t")).collect()
    for r in found:  # one row per feature
        cuts[r["feature"]] = r["t"]
    if max(len(c) for c in cuts) >= np.iinfo(np.int16).max:
        return None
    return cuts, trees, _packs(nodes, cuts, max(1, int(PACK_NODES * trees / n)))


def scored(df: DataFrame, held: tuple[list[list[float]], int, DataFrame], features: Sequence[str], out: str = "p_hat") -> DataFrame:
    """``df`` with the mean leaf probability of all trees of ``packed`` for the ``features`` of each row."""
    cuts, trees, packs = held

    @pandas_udf("array<smallint>")
    def cell(xs: pd.Series) -> pd.Series:
        return pd.Series(list(C.binned(np.stack(xs.to_numpy()).astype(float), cuts)), dtype=object) if len(xs) else pd.Series([], dtype=object)

    x = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features))
    df = df.withColumn("_cell", cell(x))
    blocks = _blocks(stored(df.select("_cell").distinct(), "cells"), len(cuts))
    means = stored(_block_means(packs.crossJoin(blocks), len(cuts), trees, out), "cell-scores")
    return df.join(means, "_cell").drop("_cell")


def _blocks(cells: DataFrame, d: int) -> DataFrame:
    """(block, cells): at most ``BLOCK_CELLS`` distinct cells in one value."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for at in range(0, len(x), BLOCK_CELLS):
                if n + len(x[at:at + BLOCK_CELLS]) > BLOCK_CELLS:
                    yield one(held)
                    held, n = [], 0
                held.append(x[at:at + BLOCK_CELLS])
                n += len(held[-1])
        if held:
            yield one(held)

    def one(held: list[np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([uuid.uuid4().hex]), pa.array([np.concatenate(held).astype(np.int16).tobytes()])], names=["block", "cells"])

    return stored(cells.mapInArrow(pack, "block string, cells binary"), "cell-blocks")


def _packs(nodes: DataFrame, cuts: Sequence[Sequence[float]], trees: int) -> DataFrame:
    """(pack, roots, left, feature, cut, p): so many trees in arrays; a leaf leads to itself."""
    def pack(of: pd.DataFrame) -> pd.DataFrame:
        feature, threshold, left, right, p, roots = _arrays(of)
        inner, base = np.flatnonzero(left >= 0), np.repeat(roots, np.diff(np.append(roots, len(left))))
        place = np.arange(len(left))  # the k-th inner node of a tree has its children side by side, at 1 + 2 k
        rank = np.arange(len(inner)) - np.searchsorted(inner, base[inner])
        place[left[inner]] = base[inner] + 1 + 2 * rank
        place[right[inner]] = place[left[inner]] + 1
        back = np.argsort(place)
        left = np.where(left < 0, -1, place[left])[back]
        feature, threshold, p = feature[back], threshold[back], p[back]
        cut = np.full(len(left), np.iinfo(np.int16).max, dtype=np.int16)
        for i, values in enumerate(cuts):
            mine = (left >= 0) & (feature == i)
            cut[mine] = np.searchsorted(values, threshold[mine])
        left = np.where(left < 0, np.arange(len(left)), left).astype(np.int32)
        return pd.DataFrame({"pack": [int(of["tree"].iloc[0]) // trees], **{k: [v.tobytes()] for k, v in (
            ("roots", roots), ("lefts", left), ("features", feature.astype(np.int16)), ("cuts", cut), ("ps", p.astype(float)))}})

    grouped = nodes.groupBy(F.floor(F.col("tree") / trees))
    return stored(grouped.applyInPandas(pack, "pack long, roots binary, lefts binary, features binary, cuts binary, ps binary"), "tree-packs")


def _block_means(pairs: DataFrame, d: int, trees: int, out: str) -> DataFrame:
    """(_cell, mean over all trees) from the pairs of packs and blocks."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {name: b.column(name)[r].as_py() for name in b.schema.names}
                x = np.frombuffer(row["cells"], dtype=np.int16)
                sums = _walked(x, d, *(np.frombuffer(row[k], dtype=t) for k, t in (
                    ("roots", np.int32), ("lefts", np.int32), ("features", np.int16), ("cuts", np.int16), ("ps", float))))
                yield pa.record_batch([pa.array([row["block"]]), pa.array([row["pack"]]), pa.array([sums.tobytes()]),
                                       pa.array([row["cells"] if row["pack"] == 0 else None], pa.binary())], names=["block", "pack", "sums", "cells"])

    def mean(of: pd.DataFrame) -> pd.DataFrame:
        of = of.sort_values("pack")
        x = np.frombuffer(of["cells"].iloc[0], dtype=np.int16).reshape(-1, d)
        return pd.DataFrame({"_cell": list(x), out: sum(np.frombuffer(v, dtype=float) for v in of["sums"]) / trees})

    sums = pairs.mapInArrow(walk, "block string, pack long, sums binary, cells binary")
    return sums.groupBy("block").applyInPandas(mean, f"_cell array<smallint>, `{out}` double")


def _walked(x: np.ndarray, d: int, roots: np.ndarray, left: np.ndarray, feature: np.ndarray, cut: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The sum over trees of the leaf probabilities of cells, given one after the other."""
    n = len(x) // d
    out, rows = np.zeros(n), np.arange(n, dtype=np.int64)
    for root in roots:
        node, who, at = np.full(n, root, dtype=np.int32), rows, rows * d
        while len(node):
            for _ in range(4):
                node = left[node] + (x[at + feature[node]] > cut[node])
            inner = left[node] != node
            done = ~inner
            out[who[done]] += p[node[done]]
            node, who, at = node[inner], who[inner], at[inner]
    return out
