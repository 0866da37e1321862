"""Registered queries: scoreboard over written metric records, membership probe."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from ledgerlens.operators import linear as L, metrics as M, report as RP
from ledgerlens.plans.fed_plans import FEATURES, LRF_SQL, THETA, _sig_sql, _z_sql, lr_frame
from ledgerlens.plans.metric_plans import _metric_sql
from ledgerlens.plans.registry import register, rnd
from ledgerlens.session import scratch_path
from ledgerlens.sources import tables as T
from ledgerlens.sources.io import write_json

# Score families of the scoreboard (ours): name → (Spark expression, SQL expression).
FAMILIES = {
    "amount": (lambda: F.round(F.col("amount") / 1000.0), "round(amount / 1000.0)"),
    "balance": (lambda: F.round((F.col("oldbalanceOrg") + 1000.0) / 100.0), "round((oldbalanceOrg + 1000.0) / 100.0)"),
}


FIELDS = ["auprc", "roc_auc", "f1", "precision", "recall", "threshold"]


def _family_sql(name: str, expr: str) -> str:
    cols = ", ".join(FIELDS)
    return f"""select 'single' as source, '{name}' as family, '{name}' as run, party, {cols}, 'test' as notes from ({_metric_sql(['party'], expr)}) x
union all
select 'fl_clients', '{name}', '{name}-clients', null, {cols}, 'micro aggregation of clients' from ({_metric_sql([], expr)}) x"""


@register("scoreboard", sql="\nunion all\n".join(_family_sql(n, e[1]) for n, e in FAMILIES.items()))
def scoreboard(spark, sf):
    """Per-party metric records of each score family and a report of its clients (per-client list and micro metrics)
    are written as JSON run artefacts, discovered recursively, normalised and ranked."""
    root = scratch_path(spark, "runs")
    base = T.party_txn(spark, sf)
    names = {"auprc": "AUPRC", "roc_auc": "ROC_AUC", "f1": "F1", "threshold": "threshold_used"}

    def run(name, expr):
        s = base.select("party", F.col("isFraud").alias("y"), expr().alias("p"))
        per, micro = (M.evaluate(s, "y", "p", g, tune_on_test=True, mode="eval").withColumnsRenamed(names) for g in (["party"], []))
        fields = [names.get(c, c) for c in FIELDS]
        records = per.select(F.lit(name).alias("family"), "party", *fields, F.lit("test").alias("threshold_source"))
        write_json(records, f"{root}/{name}")
        clients = spark.read.json(f"{root}/{name}").groupBy("family").agg(F.collect_list(F.struct("party", "AUPRC")).alias("per_client"))
        report = clients.join(micro.select(F.lit(name).alias("family"), F.struct(*fields).alias("micro")), "family")
        write_json(report, f"{root}/{name}-clients")

    with ThreadPoolExecutor(max_workers=len(FAMILIES)) as pool:  # independent runs, concurrent jobs
        for f in [pool.submit(run, name, expr) for name, (expr, _) in FAMILIES.items()]:
            f.result()
    sb = RP.scoreboard(RP.load_metrics(spark, root, lines=True))
    return sb.select("source", "family", F.element_at(F.split("path", "/"), -2).alias("run"), F.col("party").cast("int").alias("party"),
                     *[rnd(c, 9).alias(c) for c in FIELDS], "notes")


@register("mi_probe", sql=f"""
with {LRF_SQL},
pred as (select txn_id, round({_sig_sql(_z_sql(FEATURES + ['1.0e0'], THETA))}, 9) as score,
                cast(split = 'train' as integer) as y from lrf),
sc as (select score, count(*) filter (where y = 1) as pos, count(*) filter (where y <> 1) as neg
       from pred group by score),
cv as (select *, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp,
              sum(pos) over () as P, sum(neg) over () as N from sc)
select round(sum(case when P > 0 then pos * 1.0e0 / P * (tp * 1.0e0 / (tp + fp)) else 0.0 end), 9) as auprc,
       round(case when max(P) > 0 and max(N) > 0
                  then sum(neg * ((tp - pos) + pos / 2.0e0)) / (max(P) * 1.0e0 * max(N)) end, 9) as roc_auc,
       cast(sum(pos) as bigint) as n_members, cast(sum(pos + neg) as bigint) as n
from cv""")
def mi_probe(spark, sf):
    """Membership probe: do model scores separate training rows from the rest?"""
    lf = lr_frame(spark, sf)
    pred = L.score(lf, FEATURES, THETA).select(F.col("txn_id").alias("id"), rnd("p", 9).alias("p_hat"))
    members = lf.select(F.col("txn_id").alias("id"), (F.col("split") == "train").cast("int").alias("is_member"))
    s = RP.membership_probe(pred, members)
    return s.select(rnd("auprc", 9).alias("auprc"), rnd("roc_auc", 9).alias("roc_auc"),
                    F.col("n_members").cast("bigint").alias("n_members"), F.col("n").cast("bigint").alias("n"))
