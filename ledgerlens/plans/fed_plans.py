"""Registered queries: logistic scoring, gradients, FedAvg rounds, round rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import linear as L, rounds as R
from ledgerlens.plans.prep_plans import split_txn
from ledgerlens.plans.registry import SPLIT_SQL, UPDATES_SQL, register, rnd
from ledgerlens.sources import tables as T

FEATURES = ["x1", "x2", "x3"]
GRAD_FEATURES = ["x1", "x2", "x3", "x0"]          # x0 = bias column
THETA = [0.8, -0.1, 0.3, -0.5]                    # trailing bias for FEATURES
LR = 0.1
EXPECTED_CLIENTS = 4
CURRENT_ROUND = 15
SERVER_MODEL = "purchase"
K_MIN = 60

LRF_SQL = SPLIT_SQL + """,
lrf as (select txn_id, party, split, isFraud as y, 1.0e0 as x0, amount / 100000.0e0 as x1,
               oldbalanceOrg / 10000.0e0 as x2, cast(step as double) / 1000.0e0 as x3 from split_txn)"""


def lr_frame(spark, sf):
    s = split_txn(spark, sf)
    return s.select("txn_id", "party", "split", F.col("isFraud").alias("y"), F.lit(1.0).alias("x0"),
                    (F.col("amount") / 100000.0).alias("x1"), (F.col("oldbalanceOrg") / 10000.0).alias("x2"),
                    (F.col("step").cast("double") / 1000.0).alias("x3"))


def _z_sql(cols, theta):
    return " + ".join(f"({float(t)!r}e0 * {c})" for c, t in zip(cols, theta))


def _sig_sql(z):
    return f"1.0e0 / (1.0e0 + exp(-greatest(-35.0e0, least(35.0e0, {z}))))"


@register("lr_score", sql=f"""
with {LRF_SQL}
select txn_id, round({_sig_sql(_z_sql(FEATURES + ['1.0e0'], THETA))}, 9) as p from lrf""")
def lr_score(spark, sf):
    s = L.score(lr_frame(spark, sf), FEATURES, THETA)
    return s.select("txn_id", rnd("p", 9).alias("p"))


GRAD_SQL = LRF_SQL + f""",
e as (select party, x0, x1, x2, x3, {_sig_sql(_z_sql(GRAD_FEATURES, THETA))} - y as err
      from lrf where split = 'train'),
g as (select party, count(*) as n, {', '.join(f'sum(err * {c}) as g{j}' for j, c in enumerate(GRAD_FEATURES))}
      from e group by party)"""


@register("grad_sum", sql=f"""
with {GRAD_SQL}
""" + "\nunion all\n".join(f"select party, '{c}' as feature, round(g{j}, 6) as grad, n from g"
                           for j, c in enumerate(GRAD_FEATURES)))
def grad_sum(spark, sf):
    tr = lr_frame(spark, sf).filter(F.col("split") == "train")
    g = L.grad_sums(tr, GRAD_FEATURES, "y", THETA, ["party"])
    lg = L.grad_long(g, GRAD_FEATURES, ["party"])
    return lg.select("party", "feature", rnd("grad").alias("grad"), "n")


WIDE_DIM, WIDE_PARTIES = 64, 4
WIDE_THETA = [((j % 7) - 3) / 10 for j in range(WIDE_DIM)]


@register("grad_sum_wide", sql=f"""
with e as (select vec_id, vec_id % {WIDE_PARTIES} as party, label % 2 as y, i - 1 as pos, embedding[i]::double as x
           from (select *, unnest(range(1, len(embedding) + 1)) as i from embeddings)),
z as (select vec_id, sum(x * ((pos % 7) - 3) / 10e0) as z from e group by vec_id)
select party, pos::integer as pos, count(*) as n, round(sum((1e0 / (1e0 + exp(-greatest(-35e0, least(35e0, z)))) - y) * x), 6) as grad
from e join z on e.vec_id = z.vec_id group by party, pos""")
def grad_sum_wide(spark, sf):
    """Gradient sums per party straight from the array column of the vectors."""
    e = T.table(spark, sf, "embeddings").select((F.col("vec_id") % WIDE_PARTIES).alias("party"), (F.col("label") % 2).alias("y"), "embedding")
    return L.grad_sums_array(e, "embedding", "y", WIDE_THETA).select("party", "pos", "n", rnd("grad").alias("grad"))


@register("fedavg_round", sql=f"""
with {GRAD_SQL},
tot as (select sum(n) as n, {', '.join(f'sum(g{j}) as g{j}' for j in range(len(GRAD_FEATURES)))}
        from g where n > 0)
""" + "\nunion all\n".join(f"select '{c}' as feature, round({float(THETA[j])!r}e0 - {LR} * g{j} / n, 9) as theta from tot"
                           for j, c in enumerate(GRAD_FEATURES)))
def fedavg_round(spark, sf):
    """One FedAvg step from θ = THETA over the parties' training rows (n = 0 skipped)."""
    tr = lr_frame(spark, sf).filter(F.col("split") == "train")
    g = L.grad_sums(tr, GRAD_FEATURES, "y", THETA, ["party"])
    th = L.fedavg_step(g, len(GRAD_FEATURES), THETA, LR)
    return spark.createDataFrame([(c, round(t, 9)) for c, t in zip(GRAD_FEATURES, th)],
                                 "feature string, theta double")


@register("fedavg_rounds")
def fedavg_rounds(spark, sf):
    """Three rounds from θ = 0; θ carries over (iterative: rows-only check)."""
    tr = lr_frame(spark, sf).filter(F.col("split") == "train").select("party", "y", *GRAD_FEATURES).cache()
    thetas = L.fedavg_rounds(tr, GRAD_FEATURES, "y", rounds=3, lr=LR)
    tr.unpersist()
    return L.theta_frame(spark, thetas, GRAD_FEATURES)


@register("round_barrier", sql=f"""
with {UPDATES_SQL}
select round, count(distinct client_id) as n_clients, count(*) as received,
       count(distinct client_id) >= {EXPECTED_CLIENTS} as ready
from updates group by round""")
def round_barrier(spark, sf):
    return R.barrier(T.updates(spark, sf), EXPECTED_CLIENTS)


@register("dedup_updates", sql=f"""
with {UPDATES_SQL}
select client_id, round, event_id, model, value from (
  select *, row_number() over (partition by client_id, round order by ts, event_id) as rn from updates) z
where rn = 1""")
def dedup_updates(spark, sf):
    d = R.dedup_first(T.updates(spark, sf), ["client_id", "round"], ["ts", "event_id"])
    return d.select("client_id", "round", "event_id", "model", "value")


@register("stale_updates", sql=f"""
with {UPDATES_SQL}
select case when round < {CURRENT_ROUND} then 'stale' when round > {CURRENT_ROUND} then 'future'
            else 'current' end as status, count(*) as n
from updates group by all""")
def stale_updates(spark, sf):
    u = T.updates(spark, sf)
    return u.groupBy(R.round_status(u, CURRENT_ROUND).alias("status")).agg(F.count(F.lit(1)).alias("n"))


REGISTRY_SQL = UPDATES_SQL + """,
registry as (select distinct client_id from updates where round = 1 and model = 'signup')"""


def registry(u):
    return u.filter((F.col("round") == 1) & (F.col("model") == "signup")).select("client_id").distinct()


@register("valid_updates", sql=f"""
with {REGISTRY_SQL}
select event_id, client_id, round, value from updates
where client_id in (select client_id from registry) and model = '{SERVER_MODEL}'""")
def valid_updates(spark, sf):
    u = T.updates(spark, sf)
    return R.valid_updates(u, registry(u), SERVER_MODEL).select("event_id", "client_id", "round", "value")


@register("round_summary", sql=f"""
with {UPDATES_SQL}
select round, array_to_string(list_sort(list_distinct(list(client_id))), ',') as clients,
       count(*) as received, count(distinct client_id) as n_clients, round(sum(value), 6) as value_sum
from updates group by round""")
def round_summary(spark, sf):
    s = R.summary(T.updates(spark, sf))
    return s.select("round", "clients", "received", "n_clients", rnd("value_sum").alias("value_sum"))


@register("latest_round", sql=f"""
with {UPDATES_SQL}
select max(round) as round from (select round from updates group by round
                                 having count(distinct client_id) >= {EXPECTED_CLIENTS}) z""")
def latest_round(spark, sf):
    return R.latest_ready_round(T.updates(spark, sf), EXPECTED_CLIENTS)


@register("kmin_violations", sql=f"""
select cast(datediff('day', cast('2024-01-01' as date), cast(ts as date)) + 1 as integer) as round,
       event_type as model, count(distinct user_id) as n_clients
from events group by all having count(distinct user_id) < {K_MIN}""")
def kmin_violations(spark, sf):
    """Privacy audit: (round, model) aggregates built from fewer than K_MIN distinct users."""
    e = T.table(spark, sf, "events").select(T.round_col(F.col("ts")).alias("round"),
                                            F.col("event_type").alias("model"),
                                            F.col("user_id").alias("client_id"))
    return (e.groupBy("round", "model").agg(F.count_distinct("client_id").alias("n_clients"))
            .filter(F.col("n_clients") < K_MIN))


@register("vector_sum", sql="""
select cast(i - 1 as integer) as pos, round(sum(cast(v as double)), 6) as total
from (select unnest(embedding) as v, unnest(range(1, len(embedding) + 1)) as i from embeddings) z group by i""")
def vector_sum(spark, sf):
    e = T.table(spark, sf, "embeddings")
    R.check_dims(e, "embedding")
    return R.vector_sum(e, "embedding").select("pos", rnd("total").alias("total"))
