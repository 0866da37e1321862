"""Registered queries: class weights, fitted scaling and one-hot, row order helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import prep, weights as W
from ledgerlens.plans.prep_plans import NUMERIC, split_txn
from ledgerlens.plans.registry import SPLIT_SQL, TXN_SQL, register, rnd
from ledgerlens.sources import tables as T

DL_SQL = """dl as (select d.doc_id, l.quality as label
                   from documents d left join labels l on d.doc_id = l.doc_id),
cc as (select label, count(*) as n from dl group by label)"""

TYPE_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]  # TPC-H priorities


def _std_sql(expr: str) -> str:
    return f"case when stddev_pop({expr}) = 0 or stddev_pop({expr}) is null then 1.0 else stddev_pop({expr}) end"


SCALE_PARAMS_SQL = SPLIT_SQL + ",\nparams as (\n" + "\n  union all\n".join(
    f"  select '{c}' as feature, avg({c}) as mean, {_std_sql(c)} as std from split_txn where split = 'train'"
    for c in NUMERIC) + ")"

ZERO_FILL_COLS = ["amount", "balance_pos", "type_num"]
ZF_SQL = SPLIT_SQL + """,
zf as (select txn_id, split, amount,
              case when oldbalanceOrg < 0 then null else oldbalanceOrg end as balance_pos,
              try_cast(type as double) as type_num from split_txn where split = 'train')"""


def _zf_frame(spark, sf):
    s = split_txn(spark, sf).filter(F.col("split") == "train")
    return s.select("txn_id", "split", "amount",
                    F.when(F.col("oldbalanceOrg") < 0, F.lit(None)).otherwise(F.col("oldbalanceOrg"))
                    .alias("balance_pos"),
                    prep.try_double("type").alias("type_num"))


# ------------------------------------------------------------------ classes and weights


@register("class_counts", sql=f"with {DL_SQL} select label, n from cc")
def class_counts(spark, sf):
    return W.class_counts(T.doc_labels(spark, sf), "label")


@register("class_weights_balanced", sql=f"""
with {DL_SQL}
select label, round((select sum(n) from cc) * 1.0e0 /
                    ((select count(*) from cc where label is not null) * n), 6) as weight
from cc where label is not null""")
def class_weights_balanced(spark, sf):
    w = W.balanced_weights(T.doc_labels(spark, sf), "label")
    return w.select("label", rnd("weight").alias("weight"))


@register("class_weights_inverse", sql=f"""
with {DL_SQL}
select label, round(case when n = 0 then 0.0 else (select sum(n) from cc) * 1.0e0 / n end, 6) as weight
from cc""")
def class_weights_inverse(spark, sf):
    w = W.inverse_weights(W.class_counts(T.doc_labels(spark, sf), "label"))
    return w.select("label", rnd("weight").alias("weight"))


@register("sample_weights", sql=f"""
with {SPLIT_SQL},
tr as (select * from split_txn where split = 'train'),
c2 as (select isFraud, count(*) as n from tr group by isFraud),
w as (select isFraud, (select count(*) from tr) * 1.0e0 / ((select count(*) from c2) * n) as weight from c2)
select tr.txn_id, tr.isFraud, round(coalesce(w.weight, 1.0), 6) as weight
from tr left join w on tr.isFraud = w.isFraud""")
def sample_weights(spark, sf):
    tr = split_txn(spark, sf).filter(F.col("split") == "train")
    wm = W.weight_map(W.balanced_weights(tr, "isFraud"))
    out = W.sample_weights(tr.select("txn_id", "isFraud"), "isFraud", wm)
    return out.select("txn_id", "isFraud", rnd("weight").alias("weight"))


@register("stratified_split", sql=f"""
with {SPLIT_SQL},
tr as (select txn_id, isFraud from split_txn where split = 'train'),
r as (select txn_id, isFraud,
             row_number() over (partition by isFraud
                                order by md5(concat(cast(txn_id as varchar), '|42')), txn_id) as rn,
             count(*) over (partition by isFraud) as n
      from tr)
select txn_id, isFraud, case when rn <= floor(0.2 * n + 0.5) then 'val' else 'fit' end as part from r""")
def stratified_split(spark, sf):
    tr = split_txn(spark, sf).filter(F.col("split") == "train").select("txn_id", "isFraud")
    return W.stratified_split(tr, "txn_id", "isFraud", frac=0.2, seed=42)


@register("row_index", sql=f"""
with {TXN_SQL} select txn_id, row_number() over (order by txn_id) - 1 as row_idx from txn""")
def row_index(spark, sf):
    return W.row_index(T.txn(spark, sf).select("txn_id"), "txn_id")


# ------------------------------------------------------------------ fit on train / apply to all


@register("scale_params", sql=f"""
with {SCALE_PARAMS_SQL}
select feature, round(mean, 6) as mean, round(std, 6) as std from params""")
def scale_params(spark, sf):
    tr = split_txn(spark, sf).filter(F.col("split") == "train")
    p = prep.fit_scale(tr, NUMERIC)
    return prep.scale_params_frame(spark, p).select("feature", rnd("mean").alias("mean"), rnd("std").alias("std"))


@register("scale_params_zero_fill", sql=f"""
with {ZF_SQL},
params as (""" + "\n  union all\n".join(
    f"  select '{c}' as feature, avg(coalesce({c}, 0.0)) as mean, "
    f"case when count(*) <= 1 then 1.0 else greatest(1e-12, stddev_pop(coalesce({c}, 0.0))) end as std from zf"
    for c in ZERO_FILL_COLS) + """)
select feature, round(mean, 6) as mean, round(std, 6) as std from params""")
def scale_params_zero_fill(spark, sf):
    p = prep.fit_scale(_zf_frame(spark, sf), ZERO_FILL_COLS, zero_fill=True, std_floor=1e-12)
    return prep.scale_params_frame(spark, p).select("feature", rnd("mean").alias("mean"), rnd("std").alias("std"))


@register("category_vocab", sql=f"""
with {SPLIT_SQL},
lv as (select distinct 'type' as feature, type as level from split_txn where split = 'train' and type is not null
       union select distinct 'nameDest', nameDest from split_txn where split = 'train' and nameDest is not null)
select feature, level, cast(row_number() over (partition by feature order by level) - 1 as integer) as pos from lv""")
def category_vocab(spark, sf):
    tr = split_txn(spark, sf).filter(F.col("split") == "train")
    return prep.vocab_frame(spark, prep.fit_vocab(tr, ["type", "nameDest"]))


def _scaled_select_sql(suffix: str = "") -> str:
    return ", ".join(
        f"round(({c} - (select mean from params where feature = '{c}')) / "
        f"(select std from params where feature = '{c}'), 6) as {c}{suffix}" for c in NUMERIC)


@register("standard_scale", sql=f"""
with {SCALE_PARAMS_SQL}
select txn_id, split, {_scaled_select_sql()} from split_txn""")
def standard_scale(spark, sf):
    s = split_txn(spark, sf)
    p = prep.fit_scale(s.filter(F.col("split") == "train"), NUMERIC)
    out = prep.apply_scale(s, p, ["txn_id", "split"])
    return out.select("txn_id", "split", *[rnd(c).alias(c) for c in NUMERIC])


def _onehot_sql(col: str, levels: list[str]) -> str:
    return ", ".join(f'cast(coalesce({col} = \'{lv}\', false) as tinyint) as "{col}__{lv}"' for lv in levels)


@register("onehot", sql=f"""
with {SPLIT_SQL}
select txn_id, split, {_onehot_sql('type', TYPE_LEVELS)} from split_txn""")
def onehot(spark, sf):
    s = split_txn(spark, sf)
    vocab = prep.fit_vocab(s.filter(F.col("split") == "train"), ["type"])
    return prep.apply_onehot(s, vocab, ["txn_id", "split"])


@register("onehot_unseen", sql=f"""
with {SPLIT_SQL},
v as (select distinct nameDest as level from split_txn where split = 'train' and party = 0)
select txn_id, party,
       cast(case when nameDest in (select level from v) then 1 else 0 end as integer) as row_sum,
       case when nameDest in (select level from v) then nameDest end as active_level
from split_txn""")
def onehot_unseen(spark, sf):
    """Vocabulary fitted on one party's training rows, applied to every party:
    levels unseen in training give all-zero rows (row sum 0)."""
    s = split_txn(spark, sf)
    vocab = prep.fit_vocab(s.filter((F.col("split") == "train") & (F.col("party") == 0)), ["nameDest"])
    enc = prep.apply_onehot(s, vocab, ["txn_id", "party"])
    names = [f"nameDest__{lv}" for lv in vocab["nameDest"]]
    row_sum = sum((F.col(f"`{n}`").cast("int") for n in names), F.lit(0))
    active = F.concat_ws(",", *[F.when(F.col(f"`{n}`") == 1, F.lit(n.split("__", 1)[1])) for n in names])
    return enc.select("txn_id", "party", row_sum.alias("row_sum"),
                      F.when(active == "", F.lit(None)).otherwise(active).alias("active_level"))


@register("prepared_features", sql=f"""
with {SCALE_PARAMS_SQL}
select txn_id, split, isFraud, {_scaled_select_sql()}, {_onehot_sql('type', TYPE_LEVELS)} from split_txn""")
def prepared_features(spark, sf):
    """Flagship slice: split → fit scaling + vocabulary on train → one projection."""
    s = split_txn(spark, sf)
    tr = s.filter(F.col("split") == "train")
    p, vocab = prep.fit_scale_and_vocab(tr, NUMERIC, ["type"])
    return s.select("txn_id", "split", "isFraud",
                    *[rnd(e).alias(c) for e, c in zip(prep.scale_exprs(p), NUMERIC)],
                    *prep.onehot_exprs(vocab))


@register("preprocess_txn", sql=f"""
with {SCALE_PARAMS_SQL}
select cast(txn_id as varchar) as txn_id, split, isFraud, {_scaled_select_sql()}, {_onehot_sql('type', TYPE_LEVELS)}
from split_txn""")
def preprocess_txn(spark, sf):
    """The one-call preprocessing job on the transaction view (types discovered
    from the schema, id columns excluded, label coerced)."""
    from ledgerlens.plans.registry import CALIB, EMBARGO, TEST
    out, schema = prep.preprocess(T.txn(spark, sf), id_col="txn_id", label="isFraud", step_col="step",
                                  calib_frac=CALIB, test_frac=TEST, embargo=EMBARGO,
                                  id_columns=["nameOrig", "nameDest"])
    return out.select("txn_id", "split", "isFraud", *[rnd(c).alias(c) for c in schema["numeric"]],
                      *[c for c in out.columns if "__" in c])


DIRTY_SQL = TXN_SQL + """,
raw as (select txn_id, case when txn_id % 7 = 0 then 'NaN' when txn_id % 11 = 0 then 'n/a' else cast(amount as varchar) end as a from txn),
num as (select txn_id, case when isnan(try_cast(a as double)) then null else try_cast(a as double) end as x from raw)"""


@register("scale_dirty_text", sql=f"""
with {DIRTY_SQL},
p as (select avg(x) as m, stddev_pop(x) as s, avg(coalesce(x, 0)) as zm, stddev_pop(coalesce(x, 0)) as zs from num)
select txn_id, round((x - m) / s, 6) as skipped, round((coalesce(x, 0) - zm) / zs, 6) as filled from num, p""")
def scale_dirty_text(spark, sf):
    """Amounts read as text with NaN and words among them, scaled in both modes: missing is the same in the fit and the projection."""
    bad = F.when(F.col("txn_id") % 7 == 0, "NaN").when(F.col("txn_id") % 11 == 0, "n/a").otherwise(F.col("amount").cast("string"))
    raw = T.txn(spark, sf).select("txn_id", bad.alias("a"))
    plain, zero = prep.fit_scale(raw, ["a"]), prep.fit_scale(raw, ["a"], zero_fill=True)
    (skipped,), (filled,) = prep.scale_exprs(plain), prep.scale_exprs(zero, zero_fill=True)
    return raw.select("txn_id", rnd(skipped).alias("skipped"), rnd(filled).alias("filled"))
