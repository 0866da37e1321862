"""Registered queries: curves, thresholds and metrics per party, pooled and averaged.

Scores (ours): ``p = round(amount / 1000)`` against ``isFraud``; many ties on
purpose. Blend inputs ``pa = amount / 600000`` and ``pb = (oldbalanceOrg + 1000)
/ 11000`` lie in [0, 1].
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import metrics as M
from ledgerlens.plans.prep_plans import split_txn
from ledgerlens.plans.registry import SPLIT_SQL, TXN_SQL, register, rnd
from ledgerlens.sources import tables as T

THR = 200.0
BLEND_ALPHA = 0.3
ALPHA_STEPS = 51

AMOUNT_SCORE_SQL = "round(amount / 1000.0)"


def scored_sql(score_expr: str = AMOUNT_SCORE_SQL) -> str:
    return TXN_SQL + f""",
scored as (select txn_id, party, isFraud as y, {score_expr} as p from txn)"""


SCORED_SQL = scored_sql()


def sql_curve(src: str, g: list[str], prefix: str = "") -> str:
    """CTEs ``{prefix}sc`` and ``{prefix}cv`` over ``src(g..., score, y)``."""
    gl = "".join(f"{c}, " for c in g)
    part = f"partition by {', '.join(g)}" if g else ""
    return f"""{prefix}sc as (
  select {gl}score, count(*) filter (where y = 1) as pos, count(*) filter (where y <> 1) as neg
  from {src} group by {gl}score),
{prefix}cv0 as (
  select {gl}score, pos, neg,
         sum(pos) over (partition by {', '.join(g + ['1=1'])} order by score desc) as tp,
         sum(neg) over (partition by {', '.join(g + ['1=1'])} order by score desc) as fp,
         sum(pos) over ({part}) as P, sum(neg) over ({part}) as N,
         lag(score) over (partition by {', '.join(g + ['1=1'])} order by score) as prev_score
  from {prefix}sc),
{prefix}cv as (
  select *, tp * 1.0e0 / (tp + fp) as precision,
         case when P = 0 then 1.0e0 else tp * 1.0e0 / P end as recall,
         case when P = 0 then 0.0e0 else 2.0e0 * tp / (tp + fp + P) end as f1
  from {prefix}cv0)"""


def sql_threshold(cv: str, g: list[str], mode: str) -> str:
    """SELECT giving (g..., threshold, best_f1) for a curve CTE."""
    gl = "".join(f"{c}, " for c in g)
    part = f"partition by {', '.join(g)}" if g else ""
    if mode == "exact":
        return f"""select {gl}threshold, best_f1 from (
  select {gl}score as threshold, max(f1) over ({part}) as best_f1,
         row_number() over ({part} order by f1 desc, score) as rn from {cv}) z where rn = 1"""
    if mode == "eval":
        return f"""select {gl}coalesce(prev_score, 0.5) as threshold, best_f1 from (
  select {gl}prev_score, max(f1) over ({part}) as best_f1,
         row_number() over ({part} order by f1 desc, score) as rn from {cv}) z where rn = 1"""
    gsel = ", ".join(f"a.{c}" for c in g)
    on = " and ".join(f"a.{c} = b.{c}" for c in g) or "true"
    return f"""select {gsel + ', ' if g else ''}coalesce(b.prev_score, a.min_score) as threshold,
       coalesce(b.f1, 0.0) as best_f1
from (select {gl}min(score) as min_score from {cv} group by all) a
left join (select * from (select {gl}prev_score, f1,
                 row_number() over ({part} order by f1 desc, score) as rn
          from {cv} where prev_score is not null) z where rn = 1) b on {on}"""


def scored(spark, sf):
    return T.scored_txn(spark, sf).select("txn_id", "party", F.col("isFraud").alias("y"), "p")


def _curve(spark, sf, g=None):
    return M.curve(scored(spark, sf), "y", "p", g)


@register("threshold_predict", sql=f"""
with {SCORED_SQL}
select cast(txn_id as varchar) as id, y as y_true, p as p_hat, cast(p >= {THR} as integer) as y_pred from scored""")
def threshold_predict(spark, sf):
    s = scored(spark, sf)
    return M.predict(s, "p", THR).select(F.col("txn_id").cast("string").alias("id"),
                                         F.col("y").alias("y_true"), F.col("p").alias("p_hat"), "y_pred")


@register("pr_curve", sql=f"""
with {SCORED_SQL}, {sql_curve('scored s2', [], '') .replace('from scored s2', 'from (select p as score, y from scored) s2')}
select score as threshold, round(precision, 9) as precision, round(recall, 9) as recall from cv
union all select null, 1.0, 0.0""")
def pr_curve(spark, sf):
    pc = M.pr_curve(_curve(spark, sf))
    return pc.select("threshold", rnd("precision", 9).alias("precision"), rnd("recall", 9).alias("recall"))


_CV_ALL = f"with {SCORED_SQL}, src as (select p as score, y from scored), {sql_curve('src', [])}"


def _thr_query(mode):
    def q(spark, sf):
        b = M.best_f1_threshold(_curve(spark, sf), None, mode)
        return b.select(rnd("threshold", 9).alias("threshold"), rnd("best_f1", 9).alias("best_f1"))
    return q


for _name, _mode in (("best_f1_threshold", "train"), ("best_f1_threshold_eval", "eval"),
                     ("best_f1_threshold_exact", "exact")):
    register(_name, sql=f"""{_CV_ALL}
select round(threshold, 9) as threshold, round(best_f1, 9) as best_f1 from ({sql_threshold('cv', [], _mode)}) t""")(
        _thr_query(_mode))


@register("confusion_matrix", sql=f"""
with {SCORED_SQL}
select count(*) filter (where y = 0 and p < {THR}) as tn, count(*) filter (where y = 0 and p >= {THR}) as fp,
       count(*) filter (where y = 1 and p < {THR}) as fn, count(*) filter (where y = 1 and p >= {THR}) as tp
from scored""")
def confusion_matrix(spark, sf):
    cm = M.confusion(M.predict(scored(spark, sf), "p", THR), "y", "y_pred")
    return cm.select("tn", "fp", "fn", "tp")


@register("prf_metrics", sql=f"""
with {SCORED_SQL},
c as (select count(*) filter (where y = 0 and p >= {THR}) as fp,
             count(*) filter (where y = 1 and p < {THR}) as fn, count(*) filter (where y = 1 and p >= {THR}) as tp
      from scored)
select round(case when tp + fp > 0 then tp * 1.0e0 / (tp + fp) else 0.0 end, 9) as precision,
       round(case when tp + fn > 0 then tp * 1.0e0 / (tp + fn) else 0.0 end, 9) as recall,
       round(case when 2 * tp + fp + fn > 0 then 2.0e0 * tp / (2 * tp + fp + fn) else 0.0 end, 9) as f1 from c""")
def prf_metrics(spark, sf):
    cm = M.confusion(M.predict(scored(spark, sf), "p", THR), "y", "y_pred")
    return cm.select(*[rnd(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@register("average_precision", sql=f"""{_CV_ALL}
select round(sum(case when P > 0 then pos * 1.0e0 / P * precision else 0.0 end), 9) as auprc from cv""")
def average_precision(spark, sf):
    return M.average_precision(_curve(spark, sf)).select(rnd("auprc", 9).alias("auprc"))


@register("roc_auc", sql=f"""{_CV_ALL}
select round(case when max(P) > 0 and max(N) > 0
             then sum(neg * ((tp - pos) + pos / 2.0e0)) / (max(P) * 1.0e0 * max(N)) end, 9) as roc_auc from cv""")
def roc_auc(spark, sf):
    return M.roc_auc(_curve(spark, sf)).select(rnd("roc_auc", 9).alias("roc_auc"))


@register("rank_to_prob", sql=f"""
with {SCORED_SQL}
select txn_id, round((row_number() over (order by p, txn_id) - 1) / ((select count(*) from scored) - 1 + 1e-9), 9)
       as prob from scored""")
def rank_to_prob(spark, sf):
    r = M.rank_to_prob(scored(spark, sf).select("txn_id", "p"), "p", "txn_id")
    return r.select("txn_id", rnd("prob", 9).alias("prob"))


_METRIC_COLS = ["n", "auprc", "roc_auc", "threshold", "tn", "fp", "fn", "tp", "precision", "recall", "f1", "leakage"]


def _metric_sql(g: list[str], score_expr: str = AMOUNT_SCORE_SQL) -> str:
    gl = "".join(f"{c}, " for c in g)
    on = " and ".join(f"s.{c} = t.{c}" for c in g) or "true"
    gsel = "".join(f"s.{c}, " for c in g)
    return f"""with {scored_sql(score_expr)}, src as (select {gl}p as score, y from scored), {sql_curve('src', g)},
m as (select {gl}sum(case when P > 0 then pos * 1.0e0 / P * precision else 0.0 end) as auprc,
             case when max(P) > 0 and max(N) > 0
                  then sum(neg * ((tp - pos) + pos / 2.0e0)) / (max(P) * 1.0e0 * max(N)) end as roc_auc
      from cv group by all),
t as ({sql_threshold('cv', g, 'eval')}),
c as (select {gsel}t.threshold,
             sum(case when s.score < t.threshold then s.neg else 0 end) as tn,
             sum(case when s.score >= t.threshold then s.neg else 0 end) as fp,
             sum(case when s.score < t.threshold then s.pos else 0 end) as fn,
             sum(case when s.score >= t.threshold then s.pos else 0 end) as tp,
             sum(s.pos + s.neg) as n
      from sc s join t on {on} group by all)
select {''.join(f'c.{x}, ' for x in g)}cast(n as bigint) as n, round(auprc, 9) as auprc, round(roc_auc, 9) as roc_auc,
       round(threshold, 9) as threshold, cast(tn as bigint) as tn, cast(fp as bigint) as fp,
       cast(fn as bigint) as fn, cast(tp as bigint) as tp,
       round(case when tp + fp > 0 then tp * 1.0e0 / (tp + fp) else 0.0 end, 9) as precision,
       round(case when tp + fn > 0 then tp * 1.0e0 / (tp + fn) else 0.0 end, 9) as recall,
       round(case when 2 * tp + fp + fn > 0 then 2.0e0 * tp / (2 * tp + fp + fn) else 0.0 end, 9) as f1,
       true as leakage
from c {'join m on ' + ' and '.join(f'c.{x} = m.{x}' for x in g) if g else ', m'}"""


def _metric_frame(spark, sf, g):
    ev = M.evaluate(scored(spark, sf), "y", "p", g, tune_on_test=True, mode="eval")
    cols = []
    for c in _METRIC_COLS:
        if c in ("auprc", "roc_auc", "threshold", "precision", "recall", "f1"):
            cols.append(rnd(c, 9).alias(c))
        else:
            cols.append(F.col(c))
    return ev.select(*g, *cols)


@register("per_client_metrics", sql=_metric_sql(["party"]))
def per_client_metrics(spark, sf):
    return _metric_frame(spark, sf, ["party"])


@register("micro_metrics", sql=_metric_sql([]))
def micro_metrics(spark, sf):
    return _metric_frame(spark, sf, [])


@register("macro_metrics", sql="with pc as (" + _metric_sql(["party"]).replace("with ", "with ", 1) + """)
select round(avg(auprc), 9) as auprc, round(avg(roc_auc), 9) as roc_auc, round(avg(f1), 9) as f1,
       round(avg(precision), 9) as precision, round(avg(recall), 9) as recall from pc""")
def macro_metrics(spark, sf):
    mac = M.macro(_metric_frame(spark, sf, ["party"]))  # mean of the reported per-party rows
    return mac.select(*[rnd(c, 9).alias(c) for c in mac.columns])


BLEND_SQL = TXN_SQL + """,
bsrc as (select txn_id, isFraud as y, amount / 600000.0 as pa, (oldbalanceOrg + 1000.0) / 11000.0 as pb from txn)"""


def _blend_inputs(df):
    return df.select("txn_id", F.col("isFraud").alias("y"), (F.col("amount") / 600000.0).alias("pa"),
                     ((F.col("oldbalanceOrg") + 1000.0) / 11000.0).alias("pb"))


@register("blend_scores", sql=f"""
with {BLEND_SQL}
select txn_id, round({BLEND_ALPHA} * pa + (1 - {BLEND_ALPHA}) * pb, 9) as p_blend from bsrc""")
def blend_scores(spark, sf):
    b = _blend_inputs(T.txn(spark, sf))
    a = F.lit(BLEND_ALPHA)
    return b.select("txn_id", rnd(a * F.col("pa") + (F.lit(1.0) - a) * F.col("pb"), 9).alias("p_blend"))


@register("alpha_search", sql=f"""
with {SPLIT_SQL},
v as (select isFraud as y, amount / 600000.0 as pa, (oldbalanceOrg + 1000.0) / 11000.0 as pb
      from split_txn where split = 'cal'),
al as (select i * cast(0.02 as double) as alpha from range(0, {ALPHA_STEPS}) t(i)),
bl as (select alpha, alpha * pa + (1 - alpha) * pb as score, y from v, al),
{sql_curve('bl', ['alpha'])},
best as ({sql_threshold('cv', ['alpha'], 'train')}),
pick as (select alpha, best_f1, threshold, row_number() over (order by best_f1 desc, alpha) as rn from best)
select round(alpha, 6) as alpha, round(best_f1, 9) as best_f1, round(threshold, 9) as threshold
from pick where rn = 1""")
def alpha_search(spark, sf):
    """51-step blend weight search on the calibration window, all α in one plan:
    each row is expanded to 51 blended scores, one curve per α (group key)."""
    v = _blend_inputs(split_txn(spark, sf).filter(F.col("split") == "cal"))
    top = M.blend_search(v, "y", "pa", "pb", ALPHA_STEPS, mode="train")
    return top.select(rnd("alpha", 6).alias("alpha"), rnd("best_f1", 9).alias("best_f1"),
                      rnd("threshold", 9).alias("threshold"))
