"""Model training and scoring with ``pyspark.ml``, plus feature ranking.

Families (reference → Spark): logistic regression (L2, weighted) →
``LogisticRegression``; random forest → ``trees.Forest``, a ``RandomForestClassifier`` whose trees grow
in tasks; histogram gradient boosting → ``Boosting``, a ``GBTClassifier`` on counted cells, with validation-based early stopping;
isolation forest → :mod:`ledgerlens.operators.iforest`. Per-party ("federated")
ensembles train one model per party and average their probabilities.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import cells as C
from ledgerlens.operators import iforest as IF
from ledgerlens.operators import linear as L
from ledgerlens.operators import metrics as M
from ledgerlens.operators import trees as TR
from ledgerlens.operators import weights as W
from ledgerlens.operators.ranking import running_sums
from ledgerlens.session import scratch_path

FAMILIES = ("lr", "rf", "gbt", "iforest")
FORESTS = ("rf", "rf_shallow")
# The reference grows unlimited trees; 30 is the most that Spark allows.
RF_MAX_DEPTH = 30
MAX_PARTIES = 1_000
#: Rows that a task of tree training has at least and at most, if there are so many.
TASK_ROWS, MOST_ROWS = 10_000, 250_000


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def dealt(df: DataFrame) -> DataFrame:
    """The rows in equal parts, at least one for every core; fewer than two tasks' rows stay as they are.

    Every level of every tree waits for its largest part, and the few MB that hold many rows are read in few parts of unlike sizes.
    """
    rows = df.count()
    if rows < 2 * TASK_ROWS:
        return df
    return df.repartition(min(rows // TASK_ROWS, max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // MOST_ROWS))))


class Boosting(GBTClassifier):
    """``GBTClassifier`` on the counted cells of the training rows.

    A regression tree sees bins, residuals and weights only, and rows of a cell, label and fold have one residual at
    every iteration: a cell weighted by its rows is as good as the rows.
    """

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        features, label, weight, fold = (self.getOrDefault(p) if self.hasDefault(p) or self.isSet(p) else None for p in (
            self.featuresCol, self.labelCol, self.weightCol, self.validationIndicatorCol))
        cuts = C.edges(dataset, self.getMaxBins(), features)
        found = TR.stored(C.counted(dataset, cuts, [c for c in (label, weight, fold) if c], features), "cells")
        rows = found.select(C.as_vector().alias(features), label, (F.col("n") * (F.col(weight) if weight else F.lit(1.0))).alias("_rows"),
                            *((F.col(fold) > 0).alias(c) for c in (fold,) if c))
        model = super(Boosting, self.copy({self.weightCol: "_rows"}))._fit(dealt(rows))
        return TR.unbinned(model, cuts, dataset.sparkSession)


def build(family: str, label: str = "y", weight: str | None = None, n_rows: int = 1, seed: int = 42,
          n_trees: int = 400, validation_col: str | None = None):
    extra = {"weightCol": weight} if weight else {}
    if family == "lr":
        # liblinear-style L2 with C = 1 ⇔ regParam = 1/n on the mean loss; liblinear's tol 1e-4
        return LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / max(n_rows, 1),
                                  elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-4, **extra)
    if family == "rf":
        # cached node ids, where Spark's own forest grows the trees: no job ships the trees grown so far to its tasks
        return TR.Forest(featuresCol="features", labelCol=label, numTrees=n_trees, minInstancesPerNode=2, maxDepth=RF_MAX_DEPTH,
                         maxMemoryInMB=1024, cacheNodeIds=True, featureSubsetStrategy="sqrt", seed=seed, **extra)
    if family == "rf_shallow":  # the blend's forest: 600 trees, depth 8, min leaf 4
        return TR.Forest(featuresCol="features", labelCol=label, numTrees=n_trees, minInstancesPerNode=4, maxDepth=8,
                         maxMemoryInMB=1024, featureSubsetStrategy="sqrt", seed=seed, **extra)
    if family == "gbt":
        if validation_col:
            extra["validationIndicatorCol"] = validation_col
        return Boosting(featuresCol="features", labelCol=label, stepSize=0.06, maxIter=n_trees,
                        maxMemoryInMB=1024, seed=seed, **extra)
    raise ValueError(f"unknown family {family!r}")


class Fitted:
    """A fitted model of any family; ``score`` adds ``p_hat`` to a frame.

    ``model`` is a ``pyspark.ml`` model, the node table of a forest (``FORESTS``), a forest of
    isolation trees, a list of coefficients (``theta``), (boosting, forest, α) of a blend, or
    (share, model) pairs of an ``ensemble``.
    """

    def __init__(self, family: str, features: Sequence[str], model, id_col: str):
        self.family, self.features, self.model, self.id_col = family, list(features), model, id_col
        self._packed: tuple | None = None

    def score(self, df: DataFrame) -> DataFrame:
        if self.family == "iforest":
            s = IF.score(df, self.model, self.features, out="_anom")
            # written once: ranking reads it several times and the trees are not to be walked again
            path = scratch_path(df.sparkSession, "anomaly")
            s.write.parquet(path)
            s = df.sparkSession.read.schema(s.schema).parquet(path)
            # rank form inside the scored set (batch semantics of the reference)
            return M.rank_to_prob(s, "_anom", self.id_col, out="p_hat").drop("_anom")
        if self.family == "theta":
            return L.score(df, self.features, self.model, out="p_hat")
        if self.family == "blend":
            gbm, rf, a = self.model
            s = rf.score(gbm.score(df).withColumnRenamed("p_hat", "_p_gbm")).withColumnRenamed("p_hat", "_p_rf")
            return s.withColumn("p_hat", F.lit(a) * F.col("_p_gbm") + F.lit(1.0 - a) * F.col("_p_rf")).drop("_p_gbm", "_p_rf")
        if self.family == "ensemble":
            s = df.withColumn("_p_all", F.lit(0.0))
            for share, m in self.model:
                s = m.score(s).withColumn("_p_all", F.col("_p_all") + F.lit(share) * F.col("p_hat")).drop("p_hat")
            return s.withColumnRenamed("_p_all", "p_hat")
        if self.family in FORESTS:
            if self._packed is None:  # once for all scored frames
                self._packed = (TR.packed(self.model, len(self.features)),)
            held = self._packed[0]
            return TR.scored(df, held, self.features) if held else df.withColumn("p_hat", TR.probability(self.model, self.features))
        sc = self.model.transform(assemble(df, self.features))
        return sc.withColumn("p_hat", vector_to_array("probability")[1]).drop(
            "features", "rawPrediction", "probability", "prediction")

    def save(self, spark: SparkSession, path: str, threshold: float | None = None) -> None:
        """Writes the model and its tuned threshold under ``path`` (a shared folder): small parquet files and Spark's own model format."""
        extra: list[float] = []
        if self.family == "theta":
            extra = [float(t) for t in self.model]
        elif self.family == "blend":
            extra = [float(self.model[2])]
            self.model[0].save(spark, f"{path}/gbm")
            self.model[1].save(spark, f"{path}/rf")
        elif self.family == "iforest":
            extra = [float(self.model.psi), float(self.model.max_depth), float(self.model.feature.shape[0])]
            IF.nodes_frame(spark, self.model).write.mode("overwrite").parquet(f"{path}/trees")
        elif self.family == "ensemble":
            extra = [float(share) for share, _ in self.model]
            for k, (_, m) in enumerate(self.model):
                m.save(spark, f"{path}/part-{k}")
        elif self.family in FORESTS:
            self.model.write.mode("overwrite").parquet(f"{path}/nodes")
        else:
            self.model.write().overwrite().save(f"{path}/model")
        spark.createDataFrame([(self.family, self.features, self.id_col, threshold, extra)], META_SCHEMA).coalesce(1) \
            .write.mode("overwrite").parquet(f"{path}/meta")


META_SCHEMA = "family string, features array<string>, id_col string, threshold double, extra array<double>"


def load(spark: SparkSession, path: str) -> tuple[Fitted, float | None]:
    """A stored model and its threshold."""
    m = spark.read.schema(META_SCHEMA).parquet(f"{path}/meta").first()
    if m["family"] == "theta":
        model = list(m["extra"])
    elif m["family"] == "blend":
        model = (load(spark, f"{path}/gbm")[0], load(spark, f"{path}/rf")[0], m["extra"][0])
    elif m["family"] == "iforest":
        psi, depth, trees = (int(x) for x in m["extra"])
        model = IF.forest_of(spark.read.parquet(f"{path}/trees").toPandas(), trees, psi, depth)
    elif m["family"] == "ensemble":
        model = [(share, load(spark, f"{path}/part-{k}")[0]) for k, share in enumerate(m["extra"])]
    elif m["family"] in FORESTS:
        try:
            model = spark.read.schema(TR.NODES).parquet(f"{path}/nodes")
        except AnalysisException:  # a blend's forest that was stored as Spark's own
            model = TR.nodes_in(spark, f"{path}/model")
    else:
        model = {"lr": LogisticRegressionModel, "gbt": GBTClassificationModel}[m["family"]].load(f"{path}/model")
    return Fitted(m["family"], m["features"], model, m["id_col"]), m["threshold"]


def evaluate_stored(spark: SparkSession, path: str, df: DataFrame, label: str = "y", tune: bool = False) -> DataFrame:
    """One metrics row of a stored model on ``df``: at its stored threshold (0.5 without one), or tuned on ``df`` itself."""
    model, thr = load(spark, path)
    return M.evaluate(model.score(df), label, "p_hat", tune_on_test=tune, default_threshold=0.5 if thr is None else thr)


def fit(train: DataFrame, features: Sequence[str], family: str, label: str = "y", weight: str | None = None,
        seed: int = 42, n_trees: int = 400, validation_col: str | None = None,
        id_col: str = "txn_id", n_rows: int | None = None) -> Fitted:
    if family == "iforest":
        return Fitted(family, features, IF.fit(train, list(features), n_trees=n_trees, seed=seed, key=id_col),
                      id_col)
    tr = assemble(train, features)
    if family != "lr":
        tr = tr.select("features", label, *(c for c in (weight, validation_col) if c))
        tr = dealt(TR.stored(tr, "forest-rows") if family in FORESTS else tr)  # a forest's rows are read several times, so written once
    if family in FORESTS:
        return Fitted(family, features, TR.grow(tr, lambda n, k: build(family, label, weight, seed=seed + k, n_trees=n), n_trees), id_col)
    n = (n_rows if n_rows is not None else train.count()) if family == "lr" else 1
    return Fitted(family, features, build(family, label, weight, n, seed, n_trees, validation_col).fit(tr), id_col)


def balanced(df: DataFrame, label: str = "y") -> DataFrame:
    """Adds column ``weight``: rows / (classes × rows of the class), from the rows of ``df``."""
    counts = {int(r["label"]): r["n"] for r in W.class_counts(df, label).collect() if r["label"] is not None}  # one row per class
    total = sum(counts.values())
    return W.sample_weights(df, label, {c: total / (len(counts) * n) for c, n in counts.items()})


def train_job(df: DataFrame, features: Sequence[str], family: str, label: str = "y", split: str = "split", n_trees: int = 400,
              seed: int = 42, id_col: str = "txn_id", val_frac: float = 0.2, rf_trees: int = 600) -> tuple[Fitted, float]:
    """A model of the training window and its best-F1 threshold on rows it was not fitted on.

    Those rows are the calibration window; boosting then runs all its iterations. Without
    one, a stratified ``val_frac`` of TRAIN is held out, and boosting may stop early on it
    (in a blend it never does).
    An isolation forest needs no labels and takes all of TRAIN either way.
    """
    full = df.filter(F.col(split) == "train")
    val = df.filter(F.col(split) == "cal")
    fitted_on, early = full, val.isEmpty()
    if early:
        parts = W.stratified_split(full, id_col, label, frac=val_frac, seed=seed, out="_part")
        fitted_on, val = (parts.filter(F.col("_part") == p).drop("_part") for p in ("fit", "val"))
    if family == "blend":
        model = train_blend(fitted_on, val, features, label, seed, gbt_iters=n_trees, rf_trees=rf_trees, id_col=id_col)
    elif family == "iforest":
        model = fit(full, features, family, label, seed=seed, n_trees=n_trees, id_col=id_col)
    else:
        rows, stop = balanced(fitted_on, label), None
        if family == "gbt" and early:
            stop = "_val"
            rows = rows.withColumn(stop, F.lit(False)).unionByName(val.withColumn("weight", F.lit(1.0)).withColumn(stop, F.lit(True)))
        model = fit(rows, features, family, label, "weight", seed, n_trees, stop, id_col)
    return model, tuned_threshold(model.score(val), label)


def train_metrics(model: Fitted, threshold: float, test: DataFrame, label: str = "y") -> DataFrame:
    """The metrics row of a training job: model, scores, confusion counts at the tuned threshold, and a blend's α and features."""
    m = M.evaluate(model.score(test), label, "p_hat", tune_on_test=False, default_threshold=threshold)
    blend = model.family == "blend"
    return m.withColumns({"model": F.lit(model.family), "alpha": F.lit(model.model[2] if blend else None).cast("double"),
                          "topk_features": F.lit(len(model.model[1].features) if blend else None).cast("int")})


def fit_predict(train: DataFrame, score_on: DataFrame, features: Sequence[str], family: str,
                label: str = "y", weight: str | None = None, seed: int = 42, n_trees: int = 400,
                validation_col: str | None = None, id_col: str = "txn_id") -> DataFrame:
    """Fit on ``train``, return ``score_on`` with ``p_hat`` (positive-class probability)."""
    return fit(train, features, family, label, weight, seed, n_trees, validation_col, id_col).score(score_on)


def tuned_threshold(pred: DataFrame, label: str = "y", p: str = "p_hat", mode: str = "train") -> float:
    """Best-F1 threshold on validation predictions (one small aggregate)."""
    t = M.best_f1_threshold(M.curve(pred, label, p), None, mode).first()
    return 0.5 if t is None or t["threshold"] is None else float(t["threshold"])


def predictions(scored: DataFrame, thr: float, id_col: str = "txn_id", label: str = "y") -> DataFrame:
    """Prediction sink layout: (id, y_true, p_hat, y_pred)."""
    return scored.select(F.col(id_col).cast("string").alias("id"), F.col(label).cast("int").alias("y_true"),
                         "p_hat", (F.col("p_hat") >= F.lit(thr)).cast("int").alias("y_pred"))


def party_sizes(train: DataFrame, party: str = "party") -> list[tuple[str, int]]:
    """(party, rows) of the parties of a table, size-checked; null parties don't count."""
    rows = train.groupBy(party).agg(F.count(F.lit(1)).alias("n")).limit(MAX_PARTIES + 1).collect()
    if len(rows) > MAX_PARTIES:
        raise ValueError(f"more than {MAX_PARTIES} parties: one model per party is not meant for this")
    return sorted((r[party], r["n"]) for r in rows if r[party] is not None)


def fit_party(part: DataFrame, features: Sequence[str], family: str, label: str = "y", n_trees: int = 400, seed: int = 42,
              id_col: str = "txn_id", rf_trees: int = 600) -> Fitted:
    """The model of one party's rows, classes weighted by its own counts."""
    stop = None
    if family == "iforest":
        return fit(part, features, family, label, None, seed, n_trees, None, id_col)
    if family == "blend":
        parts = W.stratified_split(part, id_col, label, frac=0.2, seed=seed, out="_part")
        mine, val = (parts.filter(F.col("_part") == p).drop("_part") for p in ("fit", "val"))
        return train_blend(mine, val, features, label, seed, gbt_iters=n_trees, rf_trees=rf_trees, id_col=id_col, early_stop=True)
    part = balanced(part, label)
    if family == "gbt":  # early stopping on a seeded 10% hold-out
        stop = "_val"
        part = part.withColumn(stop, F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(10)) == 0)
    return fit(part, features, family, label, "weight", seed, n_trees, stop, id_col)


def party_models(train: DataFrame, features: Sequence[str], family: str, party: str = "party", label: str = "y", n_trees: int = 400,
                 max_trees: int | None = None, seed: int = 42, id_col: str = "txn_id", rf_trees: int = 600) -> list[tuple[str, int, Fitted]]:
    """(party, rows, model) for every party.

    ``max_trees`` caps the trees of all parties by splitting them evenly. The fits are independent and run as concurrent jobs.
    """
    sizes = party_sizes(train, party)
    per = n_trees if not max_trees else max(1, min(n_trees, max_trees // max(1, len(sizes))))

    def one(pt) -> Fitted:
        return fit_party(train.filter(F.col(party) == pt), features, family, label, per, seed, id_col, rf_trees)

    with ThreadPoolExecutor(max_workers=max(1, min(4, len(sizes)))) as pool:
        models = list(pool.map(one, [pt for pt, _ in sizes]))
    return [(pt, n, m) for (pt, n), m in zip(sizes, models, strict=True)]


def party_forest(train: DataFrame, features: Sequence[str], party: str = "party", label: str = "y", n_trees: int = 400,
                 max_trees: int | None = 800, seed: int = 42, id_col: str = "txn_id") -> Fitted:
    """One forest of the trees of all party forests, at most ``max_trees``: its probability is the mean of theirs."""
    models = party_models(train, features, "rf", party, label, n_trees, max_trees, seed, id_col)
    return Fitted("rf", features, TR.unite([m.model for _, _, m in models], max_trees), id_col)


def party_ensemble(train: DataFrame, score_on: DataFrame, features: Sequence[str], family: str,
                   party: str = "party", label: str = "y", n_trees: int = 400, max_trees: int | None = None,
                   weighted: bool = True, seed: int = 42, id_col: str = "txn_id", round_no: int = 0,
                   diversify: bool = False, rf_trees: int = 600) -> DataFrame:
    """One model per party, probabilities averaged (n-weighted, or by tree count): (id, label, p_hat), a row per scored row.

    ``diversify`` adds the round to the seed of every party. Forests by tree count unite to one model (``party_forest``).
    All models score in one projection; only isolation forests, whose probability is a
    rank within the scored rows, need a pass each.
    """
    seed = seed + (round_no if diversify else 0)
    acc = score_on.select(id_col, label, *features)
    if family == "rf" and not weighted:
        return party_forest(train, features, party, label, n_trees, max_trees, seed, id_col).score(acc).select(id_col, label, "p_hat")
    models = party_models(train, features, family, party, label, n_trees, max_trees, seed, id_col, rf_trees)
    total = float(sum(n for _, n, _ in models))
    shares = [(n / total if weighted else 1.0 / len(models), m) for _, n, m in models]
    return Fitted("ensemble", features, shares, id_col).score(acc).select(id_col, label, "p_hat")


# ---------------------------------------------------------------- feature ranking


def long_features(df: DataFrame, vec: str, label: str | None = None) -> DataFrame:
    cols = [F.col(label).alias("label")] if label else []
    return df.select(*cols, F.posexplode(vec).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def variance_ranking(long: DataFrame, k: int | None = None, n_features: int | None = None) -> DataFrame:
    """Population variance per feature; top ``k = max(1, int(d * 0.5))`` by variance."""
    v = long.groupBy("pos").agg(F.var_pop("x").alias("variance"))
    d = n_features if n_features is not None else v.count()
    k = k if k is not None else max(1, int(d * 0.5))
    ranked = v.orderBy(F.col("variance").desc(), F.col("pos")).limit(k)
    return ranked


def mutual_info_binned(long: DataFrame, bins: int = 10) -> DataFrame:
    """MI (nats) between an equal-width binned feature and the label, per feature.

    ``pyspark.ml`` has no MI estimator; this binned plug-in form is ours. Work is
    three aggregations keyed by (feature, bin, label) – map-side combined.
    """
    rng = long.groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    # rng has one row per feature: a proven bound, so it is broadcast rather than
    # shuffling the long table on only d keys
    b = (long.join(F.broadcast(rng), "pos")
         .withColumn("bin", F.when(F.col("hi") > F.col("lo"),
                                   F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins),
                                           F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")))
    return _information(b.groupBy("pos", "bin", "label").agg(F.count(F.lit(1)).alias("nbl")))


def mutual_info_quantile(long: DataFrame, bins: int = 10) -> DataFrame:
    """MI (nats) between a feature in bins of equal row counts and the label, per feature.

    A value's bin follows from the rows below it, so equal values share one. Values collapse to counts
    map-side; null and NaN values count in no bin.
    """
    x = F.col("x")
    counts = long.filter(x.isNotNull() & ~F.isnan(x)).groupBy("pos", "x", "label").agg(F.count(F.lit(1)).alias("nbl"))
    run = running_sums(counts.groupBy("pos", "x").agg(F.sum("nbl").alias("c")), "x", ["c"], ["pos"], descending=False, totals=True)
    binned = run.select("pos", "x", F.floor((F.col("cum_c") - F.col("c")) * bins / F.col("tot_c")).cast("int").alias("bin"))
    return _information(counts.join(binned, ["pos", "x"]).groupBy("pos", "bin", "label").agg(F.sum("nbl").alias("nbl")))


def _information(joint: DataFrame) -> DataFrame:
    """MI per feature of the counts ``nbl`` by (pos, bin, label)."""
    pb = joint.groupBy("pos", "bin").agg(F.sum("nbl").alias("nb"))
    pl = joint.groupBy("pos", "label").agg(F.sum("nbl").alias("nl"))
    n = joint.groupBy("pos").agg(F.sum("nbl").alias("n"))
    j = joint.join(pb, ["pos", "bin"]).join(pl, ["pos", "label"]).join(n, "pos")
    term = (F.col("nbl") / F.col("n")) * F.log((F.col("nbl") * F.col("n")) / (F.col("nb") * F.col("nl")))
    return j.groupBy("pos").agg(F.sum(term).alias("mi"))


def wide_to_long(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(label, pos, x) rows from wide feature columns."""
    st = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.col(c).cast("double").alias("x"))
                             for i, c in enumerate(features)]))
    return df.select(F.col(label).alias("label"), st.alias("_s")).select("label", "_s.pos", "_s.x")


def top_features(train: DataFrame, features: Sequence[str], label: str, ratio: float = 0.5,
                 by: str = "mi", bins: int = 10) -> list[str]:
    """Top ``max(1, int(d * ratio))`` features by MI in quantile bins (or variance), ties by position."""
    long = wide_to_long(train, features, label)
    ranked = mutual_info_quantile(long, bins).withColumnRenamed("mi", "score") if by == "mi" else \
        long.groupBy("pos").agg(F.var_pop("x").alias("score"))
    k = max(1, int(len(features) * ratio))
    order = [r["pos"] for r in ranked.orderBy(F.col("score").desc(), F.col("pos")).limit(k).collect()]
    return [features[i] for i in order]


def train_blend(train: DataFrame, val: DataFrame, features: Sequence[str], label: str = "y", seed: int = 42,
                steps: int = 51, mode: str = "train", gbt_iters: int = 400, rf_trees: int = 600,
                id_col: str = "txn_id", early_stop: bool = False) -> Fitted:
    """Boosting on all features + shallow forest on the top-half features; α comes
    from the grid search on ``val``. ``early_stop`` lets boosting stop on a seeded
    tenth of ``train``, never on ``val``, which tunes α."""
    keep = top_features(train, list(features), label)
    stop = "_val" if early_stop else None
    rows = train.withColumn("_val", F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(10)) == 0) if early_stop else train
    with ThreadPoolExecutor(max_workers=2) as pool:  # independent fits, concurrent jobs
        fg = pool.submit(fit, rows, features, "gbt", label, None, seed, gbt_iters, stop, id_col)
        fr = pool.submit(fit, train, keep, "rf_shallow", label, None, seed, rf_trees, None, id_col)
        gbm, rf = fg.result(), fr.result()
    both = rf.score(gbm.score(val).withColumnRenamed("p_hat", "p_gbm")).withColumnRenamed("p_hat", "p_rf")
    best = M.blend_search(both, label, "p_gbm", "p_rf", steps, mode).first()
    return Fitted("blend", features, (gbm, rf, float(best["alpha"])), id_col)
