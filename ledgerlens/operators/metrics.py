"""Exact ranking metrics: PR curve, best-F1 thresholds, AP, ROC AUC, confusion.

Plan shape: rows → (group, score) → (pos, neg) with a partial aggregation (one
shuffle, a hot score costs one row per partition) → distributed running sums over
distinct scores (``ranking.running_sums``; no unpartitioned window) → per-group
aggregates. All metrics of a group come from that one curve table.

Threshold alignments of the best-F1 search (thresholds ascending t_0..t_{m-1},
F1_i the F1 of ``p >= t_i``, F1_m = 0 for the final (recall 0) point):

* ``exact``: first max over i in 0..m-1, threshold t_i (default);
* ``train``: first max over i in 1..m, threshold t_{i-1}; one score → t_0;
* ``eval``:  first max over i in 0..m, threshold t_{i-1}, or 0.5 when i = 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ranking import row_number, running_sums

MODES = ("exact", "train", "eval")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def checked_score(score: Column | str) -> Column:
    """The score as a double; a null or NaN score stops the job, as no metric can place it."""
    x = _c(score).cast("double")
    return F.when(x.isNull() | F.isnan(x), F.raise_error(F.lit("a row has a null or NaN score"))).otherwise(x)


def score_counts(df: DataFrame, y: Column | str, p: Column | str, group_cols: list[str] | None = None) -> DataFrame:
    g = list(group_cols or [])
    yy = _c(y).cast("int")
    return (df.select(*g, checked_score(p).alias("score"), yy.alias("_y"))
            .groupBy(*g, "score")
            .agg(F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") != 1).alias("neg")))


def curve(df: DataFrame | None, y: Column | str | None = None, p: Column | str | None = None,
          group_cols: list[str] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """One row per (group, distinct score): counts at and above the score."""
    g = list(group_cols or [])
    sc = counts if counts is not None else score_counts(df, y, p, g)
    c = running_sums(sc, "score", ["pos", "neg"], g, descending=True, totals=True, lower_col="prev_score", lower_values=True)
    tp, fp, P = F.col("cum_pos"), F.col("cum_neg"), F.col("tot_pos")
    return c.select(
        *g, "score", "pos", "neg", "prev_score", "prev_score_pos", "prev_score_neg",
        tp.alias("tp"), fp.alias("fp"), P.alias("P"), F.col("tot_neg").alias("N"),
        (tp / (tp + fp)).alias("precision"),
        F.when(P == 0, F.lit(1.0)).otherwise(tp / P).alias("recall"),
        F.when(P == 0, F.lit(0.0)).otherwise(2.0 * tp / (tp + fp + P)).alias("f1"),
    )


def pr_curve(cv: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """(threshold, precision, recall) per distinct score plus the final (1, 0) point."""
    g = list(group_cols or [])
    pts = cv.select(*g, F.col("score").alias("threshold"), "precision", "recall")
    final = cv.select(*g).distinct() if g else cv.limit(1).select()
    final = final.select(*g, F.lit(None).cast("double").alias("threshold"),
                         F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(final)


def _key() -> Column:
    return F.struct(F.col("f1"), -F.col("score"))  # max F1, first (lowest score) on ties


def threshold_aggs(mode: str = "exact") -> list[Column]:
    """Aggregate expressions over a curve giving ``threshold`` and ``best_f1``."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "exact":
        return [F.max_by("score", _key()).alias("threshold"), F.max("f1").alias("best_f1")]
    if mode == "eval":
        # argmax at the lowest score (no lower neighbour) → 0.5
        return [F.coalesce(F.max_by("prev_score", _key()), F.lit(0.5)).alias("threshold"),
                F.max("f1").alias("best_f1")]
    # train form: candidates are rows with a lower neighbour, paired with it; with
    # a single distinct score only the final point remains (threshold t_0, F1 0).
    has_prev = F.col("prev_score").isNotNull()
    return [F.coalesce(F.max_by("prev_score", F.when(has_prev, _key())), F.min("score")).alias("threshold"),
            F.coalesce(F.max(F.when(has_prev, F.col("f1"))), F.lit(0.0)).alias("best_f1")]


def ap_agg() -> Column:
    """Step-rule AP = Σ (pos/P) · precision at each distinct score; 0 without positives."""
    return F.sum(F.when(F.col("P") > 0, F.col("pos") / F.col("P") * F.col("precision"))
                 .otherwise(F.lit(0.0))).alias("auprc")


def auc_agg() -> Column:
    """Mann-Whitney form, ties count half; null when only one class is present."""
    term = F.col("neg") * ((F.col("tp") - F.col("pos")) + F.col("pos") / 2.0)
    P, N = F.max("P"), F.max("N")
    return F.when((P > 0) & (N > 0), F.sum(term) / (P.cast("double") * N)).alias("roc_auc")


def best_f1_threshold(cv: DataFrame, group_cols: list[str] | None = None, mode: str = "exact") -> DataFrame:
    return cv.groupBy(*(group_cols or [])).agg(*threshold_aggs(mode))


def average_precision(cv: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    return cv.groupBy(*(group_cols or [])).agg(ap_agg())


def roc_auc(cv: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    return cv.groupBy(*(group_cols or [])).agg(auc_agg())


def predict(df: DataFrame, p: Column | str, thr: Column | float, out: str = "y_pred") -> DataFrame:
    t = thr if isinstance(thr, Column) else F.lit(float(thr))
    return df.withColumn(out, (_c(p) >= t).cast("int"))


def confusion(df: DataFrame, y: Column | str, y_pred: Column | str, group_cols: list[str] | None = None) -> DataFrame:
    """2x2 counts (labels 0, 1; rows = truth) and precision/recall/F1 (0 on 0/0)."""
    g = list(group_cols or [])
    yy, pp = _c(y).cast("int"), _c(y_pred).cast("int")
    cm = df.groupBy(*g).agg(
        F.count_if((yy == 0) & (pp == 0)).alias("tn"), F.count_if((yy == 0) & (pp == 1)).alias("fp"),
        F.count_if((yy == 1) & (pp == 0)).alias("fn"), F.count_if((yy == 1) & (pp == 1)).alias("tp"),
        F.count(F.lit(1)).alias("n"))
    return with_prf(cm)


def with_prf(cm: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cm.withColumns({
        "precision": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0)),
        "recall": F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0)),
        "f1": F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0)),
    })


def confusion_at(threshold: float | None, mode: str) -> Column:
    """Aggregate over a curve: (threshold, tp, fp) at a given threshold, or at the best-F1 one of ``mode``."""
    def point(t, tp, fp) -> Column:
        return F.struct(t.cast("double").alias("threshold"), tp.cast("bigint").alias("tp"), fp.cast("bigint").alias("fp"))

    def at(t: float) -> Column:
        hit = F.col("score") >= F.lit(float(t))
        return point(F.lit(float(t)), F.coalesce(F.sum(F.when(hit, F.col("pos"))), F.lit(0)), F.coalesce(F.sum(F.when(hit, F.col("neg"))), F.lit(0)))

    if threshold is not None:
        return at(threshold)
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "exact":
        return F.max_by(point(F.col("score"), F.col("tp"), F.col("fp")), _key())
    has_prev = F.col("prev_score").isNotNull()
    lower = F.when(has_prev, point(F.col("prev_score"), F.col("tp") + F.col("prev_score_pos"), F.col("fp") + F.col("prev_score_neg")))
    if mode == "eval":
        return F.coalesce(F.max_by(lower, _key()), at(0.5))
    return F.coalesce(F.max_by(lower, F.when(has_prev, _key())), point(F.min("score"), F.max("P"), F.max("N")))


def evaluate(df: DataFrame, y: str, p: str, group_cols: list[str] | None = None,
             tune_on_test: bool = True, mode: str = "eval", default_threshold: float = 0.5) -> DataFrame:
    """Per-group metric rows: n, auprc, roc_auc, threshold, confusion counts, P/R/F1; a null group is a group.

    All of them come from ONE aggregation over the curve: it holds the counts at and above each
    score, so the confusion counts are those of the row at the threshold.
    ``tune_on_test`` picks each group's best-F1 threshold on the same rows and
    flags the result as leaked (the reference's ``tune_on=test``).
    """
    g = list(group_cols or [])
    none = F.lit(0).cast("bigint")
    aggs = [ap_agg(), auc_agg(), confusion_at(None if tune_on_test else default_threshold, mode).alias("_at"),
            F.coalesce(F.max("P"), none).alias("_P"), F.coalesce(F.max("N"), none).alias("_N")]
    if tune_on_test:
        aggs.append(threshold_aggs(mode)[1])
    s = curve(df, y, p, g).groupBy(*g).agg(*aggs)
    tp, fp = F.coalesce(F.col("_at.tp"), none), F.coalesce(F.col("_at.fp"), none)
    cm = s.withColumns({"threshold": F.col("_at.threshold"), "tn": F.col("_N") - fp, "fp": fp, "fn": F.col("_P") - tp, "tp": tp,
                        "n": F.col("_P") + F.col("_N")})
    return with_prf(cm.drop("_at", "_P", "_N")).withColumn("leakage", F.lit(bool(tune_on_test)))


def macro(per_group: DataFrame, cols=("auprc", "roc_auc", "f1", "precision", "recall"),
          first_rule_order: str | None = None) -> DataFrame:
    """Mean over groups, skipping nulls (nan-skipping mean).

    ``first_rule_order`` reproduces the reference's rule instead: a metric is null
    when the first group (by that column) has a null value for it.
    """
    if not first_rule_order:
        return per_group.agg(*[F.avg(c).alias(c) for c in cols])
    first = {c: F.min_by(F.col(c).isNull(), F.col(first_rule_order)) for c in cols}
    return per_group.agg(*[F.when(~first[c], F.avg(c)).alias(c) for c in cols])


def rank_to_prob(df: DataFrame, score: str, id_col: str, out: str = "prob") -> DataFrame:
    """``rank / (n - 1 + 1e-9)`` with a 0-based rank by (score, id) (exact, distributed).

    The id spreads a score that many rows share.
    """
    r = row_number(df.withColumn(score, checked_score(score)), [score, id_col], out="_rk", total="_n")
    return r.withColumn(out, (F.col("_rk") - 1) / (F.col("_n") - 1 + 1e-9)).drop("_rk", "_n")


def blend_search(df: DataFrame, y: str, p1: str, p2: str, steps: int = 51, mode: str = "train") -> DataFrame:
    """Blend weight α on a grid of ``steps`` values in [0, 1] maximising best F1 of
    ``α·p1 + (1−α)·p2``; the first α with the maximum wins.

    All α run in ONE plan: rows collapse to distinct score pairs with their counts, each pair expands
    to ``steps`` blended scores (a constant factor), whose counts are added per (α, score) before the
    curve; no cross join and no per-α job. Returns one row (alpha, best_f1, threshold).
    """
    yy = F.col(y).cast("int")
    pairs = df.select(checked_score(p1).alias("_a"), checked_score(p2).alias("_b"), yy.alias("_y")).groupBy("_a", "_b").agg(
        F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") != 1).alias("neg"))
    a = F.col("_i").cast("double") * F.lit(1.0 / (steps - 1))
    grid = pairs.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("_i"))
    counts = (grid.select(a.alias("alpha"), (a * F.col("_a") + (F.lit(1.0) - a) * F.col("_b")).alias("score"), "pos", "neg")
              .groupBy("alpha", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    best = best_f1_threshold(curve(None, counts=counts, group_cols=["alpha"]), ["alpha"], mode)
    top = best.agg(F.max_by(F.struct("alpha", "best_f1", "threshold"),
                            F.struct(F.col("best_f1"), -F.col("alpha"))).alias("b"))
    return top.select("b.*")
