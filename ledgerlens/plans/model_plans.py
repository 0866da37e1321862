"""Registered queries: model training/scoring jobs and feature ranking.

Training jobs fit on the training window, tune the best-F1 threshold on the
calibration window and score the test window; their output is the prediction
layout (id, y_true, p_hat, y_pred). Random model fits have no SQL twin.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import federated as FD, models as MD, prep
from ledgerlens.plans.prep_plans import NUMERIC, split_txn
from ledgerlens.plans.registry import TXN_SQL, register, rnd
from ledgerlens.session import scratch_path
from ledgerlens.sources import tables as T

EMB_LONG_SQL = """
l as (select vec_id, label, cast(i - 1 as integer) as pos, cast(v as double) as x
      from (select vec_id, label, unnest(embedding) as v, unnest(range(1, len(embedding) + 1)) as i
            from embeddings) z)"""
MI_BINS = 10


def feature_frame(spark, sf):
    """Scaled numerics + one-hot type, fitted on the training window; ML-safe names."""
    s = split_txn(spark, sf)
    tr = s.filter(F.col("split") == "train")
    p, vocab = prep.fit_scale_and_vocab(tr, NUMERIC, ["type"])
    oh = prep.onehot_exprs(vocab)
    names = [f"type_{i}" for i in range(len(oh))]
    df = s.select("txn_id", "party", "split", F.col("isFraud").alias("y"), *prep.scale_exprs(p),
                  *[e.alias(n) for e, n in zip(oh, names)])
    return df, NUMERIC + names


def _fitted(spark, sf, family, n_trees=400):
    """(model, threshold, feature frame); the frame is written once, as every eager step reads it."""
    df, feats = feature_frame(spark, sf)
    path = scratch_path(spark, "features")
    df.write.parquet(path)
    df = spark.read.schema(df.schema).parquet(path)
    return *MD.train_job(df, feats, family, n_trees=n_trees), df


def _train_job(spark, sf, family):
    model, thr, df = _fitted(spark, sf, family)
    return MD.predictions(model.score(df.filter(F.col("split") == "test")), thr)


@register("train_lr")
def train_lr(spark, sf):
    return _train_job(spark, sf, "lr")


@register("train_rf")
def train_rf(spark, sf):
    return _train_job(spark, sf, "rf")


@register("train_gbt")
def train_gbt(spark, sf):
    return _train_job(spark, sf, "gbt")


@register("train_iforest")
def train_iforest(spark, sf):
    return _train_job(spark, sf, "iforest")


@register("train_blend")
def train_blend(spark, sf):
    """Two-model blend: α and threshold tuned on the calibration window."""
    return _train_job(spark, sf, "blend")


@register("train_metrics")
def train_metrics(spark, sf):
    """Metrics rows of the logistic and the isolation-forest training job on the test window."""
    rows = None
    for family in ("lr", "iforest"):
        model, thr, df = _fitted(spark, sf, family)
        one = MD.train_metrics(model, thr, df.filter(F.col("split") == "test"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


STORED_THETA = (0.9, -0.4, 0.2, -0.1)  # coefficients of the stored model that is evaluated
STORED_COLS = ("amount", "oldbalanceOrg", "newbalanceOrig", "newbalanceDest")


@register("eval_stored_lr", sql=f"""
with {TXN_SQL},
s as (select isFraud as y, {" + ".join(f"({t!r}e0 * {c} / 100000.0e0)" for t, c in zip(STORED_THETA, STORED_COLS))} as z from txn),
p as (select y, case when 1.0e0 / (1.0e0 + exp(-greatest(-35.0e0, least(35.0e0, z)))) >= 0.6 then 1 else 0 end as h from s)
select count(*) as n, count(*) filter (y = 0 and h = 0) as tn, count(*) filter (y = 0 and h = 1) as fp,
       count(*) filter (y = 1 and h = 0) as fn, count(*) filter (y = 1 and h = 1) as tp from p""")
def eval_stored_lr(spark, sf):
    """A stored coefficient vector is loaded and evaluated on all transactions at its stored threshold."""
    path = scratch_path(spark, "stored-model")
    feats = [f"s_{c}" for c in STORED_COLS]
    MD.Fitted("theta", feats, list(STORED_THETA), "txn_id").save(spark, path, 0.6)
    t = T.txn(spark, sf).select("txn_id", F.col("isFraud").alias("y"), *[(F.col(c) / 100000.0).alias(f"s_{c}") for c in STORED_COLS])
    return MD.evaluate_stored(spark, path, t).select("n", "tn", "fp", "fn", "tp")


@register("eval_stored_clients", sql=f"""
with {TXN_SQL},
s as (select party, isFraud as y, {" + ".join(f"({t!r}e0 * {c} / 100000.0e0)" for t, c in zip(STORED_THETA, STORED_COLS))} as z from txn),
p as (select party, y, case when 1.0e0 / (1.0e0 + exp(-greatest(-35.0e0, least(35.0e0, z)))) >= 0.5 then 1 else 0 end as h from s),
c as (select party, count(*) as n, count(*) filter (y = 0 and h = 0) as tn, count(*) filter (y = 0 and h = 1) as fp,
             count(*) filter (y = 1 and h = 0) as fn, count(*) filter (y = 1 and h = 1) as tp from p group by grouping sets ((party), ())),
f as (select *, case when tp + fp > 0 then tp / (tp + fp)::double else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn)::double else 0 end as recall from c)
select case when party is null then 'micro' else 'client' end as scope, party, 2 as round, n, tn, fp, fn, tp, round(precision, 9) as precision, round(recall, 9) as recall from f
union all
select 'macro', null, 2, null, null, null, null, null, round(avg(precision), 9), round(avg(recall), 9) from f where party is not null""")
def eval_stored_clients(spark, sf):
    """The last of two stored rounds of coefficients, evaluated per client, over all rows and on average."""
    base = scratch_path(spark, "stored-rounds")
    feats = [f"s_{c}" for c in STORED_COLS]
    for r, theta in ((1, [0.0] * len(feats)), (2, list(STORED_THETA))):
        FD.record(spark, base, r, None, 0, 0, MD.Fitted("theta", feats, theta, "txn_id"))
    t = T.party_txn(spark, sf).select("party", F.col("isFraud").alias("y"), *[(F.col(c) / 100000.0).alias(f"s_{c}") for c in STORED_COLS])
    rows = FD.evaluate_clients(spark, base, t)
    return rows.select("scope", "party", "round", "n", "tn", "fp", "fn", "tp", rnd("precision", 9).alias("precision"), rnd("recall", 9).alias("recall"))


@register("fed_rounds_forest")
def fed_rounds_forest(spark, sf):
    """Two diversified rounds of party forests with a ledger; the last united forest on the test window."""
    df, feats = feature_frame(spark, sf)
    path = scratch_path(spark, "features")
    df.write.parquet(path)
    df = spark.read.schema(df.schema).parquet(path)
    model = FD.run_rounds(df.filter(F.col("split") == "train"), feats, "rf", 2, scratch_path(spark, "rounds"), n_trees=60, diversify=True)
    return MD.predictions(model.score(df.filter(F.col("split") == "test")), 0.5)


def _fed_job(spark, sf, family, max_trees=None, weighted=True):
    df, feats = feature_frame(spark, sf)
    path = scratch_path(spark, "features")
    df.write.parquet(path)
    df = spark.read.schema(df.schema).parquet(path)
    tr, te = df.filter(F.col("split") == "train"), df.filter(F.col("split") == "test")
    p = MD.party_ensemble(tr, te, feats, family, max_trees=max_trees, weighted=weighted)
    return MD.predictions(p, 0.5)


@register("fed_forest")
def fed_forest(spark, sf):
    """Per-party forests united under an 800-tree cap (mean probability)."""
    return _fed_job(spark, sf, "rf", max_trees=800, weighted=False)


@register("fed_ensemble")
def fed_ensemble(spark, sf):
    """Per-party boosted models, probabilities averaged with weights n_party / n."""
    return _fed_job(spark, sf, "gbt", weighted=True)


@register("fed_iforest")
def fed_iforest(spark, sf):
    """Per-party isolation forests; rank probabilities averaged with weights n_party / n."""
    return _fed_job(spark, sf, "iforest", weighted=True)


@register("topk_features", sql=f"""
with {EMB_LONG_SQL}
select pos, round(var_pop(x), 9) as variance from l group by pos
order by var_pop(x) desc, pos limit 32""")
def topk_features(spark, sf):
    """Top half of the embedding dimensions by population variance."""
    e = T.table(spark, sf, "embeddings")
    long = MD.long_features(e, "embedding")
    top = MD.variance_ranking(long)
    return top.select(F.col("pos").cast("int").alias("pos"), rnd("variance", 9).alias("variance"))


@register("mutual_info_binned", sql=f"""
with {EMB_LONG_SQL},
r as (select pos, min(x) as lo, max(x) as hi from l group by pos),
b as (select l.pos, label, case when hi > lo then least(floor((x - lo) / (hi - lo) * {MI_BINS}), {MI_BINS - 1})
                                else 0 end as bin from l join r on l.pos = r.pos),
j as (select pos, bin, label, count(*) as nbl from b group by all),
pb as (select pos, bin, sum(nbl) as nb from j group by all),
pl as (select pos, label, sum(nbl) as nl from j group by all),
nn as (select pos, sum(nbl) as n from j group by pos)
select j.pos, round(sum((nbl * 1.0e0 / n) * ln((nbl * n * 1.0e0) / (nb * nl))), 9) as mi
from j join pb on j.pos = pb.pos and j.bin = pb.bin join pl on j.pos = pl.pos and j.label = pl.label
       join nn on j.pos = nn.pos
group by j.pos""")
def mutual_info_binned(spark, sf):
    e = T.table(spark, sf, "embeddings")
    mi = MD.mutual_info_binned(MD.long_features(e, "embedding", "label"), MI_BINS)
    return mi.select(F.col("pos").cast("int").alias("pos"), rnd("mi", 9).alias("mi"))


@register("mutual_info_quantile", sql=f"""
with {EMB_LONG_SQL},
b as (select pos, label, ((rank() over (partition by pos order by x) - 1) * {MI_BINS}) // count(*) over (partition by pos) as bin from l),
j as (select pos, bin, label, count(*) as nbl from b group by all),
pb as (select pos, bin, sum(nbl) as nb from j group by all),
pl as (select pos, label, sum(nbl) as nl from j group by all),
nn as (select pos, sum(nbl) as n from j group by pos)
select j.pos, round(sum((nbl * 1.0e0 / n) * ln((nbl * n * 1.0e0) / (nb * nl))), 9) as mi
from j join pb on j.pos = pb.pos and j.bin = pb.bin join pl on j.pos = pl.pos and j.label = pl.label
       join nn on j.pos = nn.pos
group by j.pos""")
def mutual_info_quantile(spark, sf):
    """Mutual information of every embedding dimension, in bins of equal row counts, with the label."""
    mi = MD.mutual_info_quantile(MD.long_features(T.table(spark, sf, "embeddings"), "embedding", "label"), MI_BINS)
    return mi.select(F.col("pos").cast("int").alias("pos"), rnd("mi", 9).alias("mi"))
