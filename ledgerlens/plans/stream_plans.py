"""Registered queries: the streaming operators over the ``events`` table.

Each query runs a real streaming job (file source → stateful or stateless
operators → sink) to completion with ``availableNow`` and returns the sink as
a batch frame; since the whole table streams through, the result must equal
the batch computation, which is what the SQL twins compute.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.vectors import sigmoid
from ledgerlens.operators import prep
from ledgerlens.plans.registry import register, rnd
from ledgerlens.sources import tables as T
from ledgerlens.streaming import streams as S

TRAIN_LAST_ROUND = 20
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]  # levels present in the events table
SCORE_THETA = (-1.0, 0.05)
SCORE_THR = 0.5

ROUND_SQL = "cast(datediff('day', cast('2024-01-01' as date), cast(ts as date)) + 1 as integer)"


def _events_stream(spark, sf):
    return S.source(spark, sf, "events.parquet")


def _delay(spark, sf):
    return S.span(spark, sf, "events.parquet", "ts")


def _fit_static(spark, sf):
    e = T.table(spark, sf, "events")
    tr = e.filter(T.round_col(F.col("ts")) <= TRAIN_LAST_ROUND)
    return prep.fit_scale(tr, ["value"]), prep.fit_vocab(tr, ["event_type"])


@register("stream_transform", sql=f"""
with tr as (select avg(value) as m,
                   case when stddev_pop(value) = 0 then 1.0 else stddev_pop(value) end as s
            from events where {ROUND_SQL} <= {TRAIN_LAST_ROUND})
select event_id, round((value - m) / s, 9) as value,
       {', '.join(f"cast(event_type = '{t}' as tinyint) as event_type__{t}" for t in EVENT_TYPES)}
from events, tr""")
def stream_transform(spark, sf):
    """Batch-fitted scaling and one-hot applied to every arriving event (append)."""
    p, vocab = _fit_static(spark, sf)
    st = _events_stream(spark, sf).select("event_id", *prep.scale_exprs(p), *prep.onehot_exprs(vocab))
    out = S.run_append(st, "transform")
    return out.select("event_id", rnd("value", 9).alias("value"), *[c for c in out.columns if "__" in c])


@register("stream_stats", sql="""
select event_type, count(*) as n, round(sum(value), 6) as value_sum, round(avg(value), 6) as value_avg
from events group by event_type""")
def stream_stats(spark, sf):
    """Running per-type count/sum/mean over the stream (complete output)."""
    st = S.running_stats(_events_stream(spark, sf), ["event_type"],
                         [F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum"),
                          F.avg("value").alias("value_avg")])
    return st.select("event_type", "n", rnd("value_sum").alias("value_sum"), rnd("value_avg").alias("value_avg"))


@register("stream_score", sql=f"""
select event_id, round(1.0e0 / (1.0e0 + exp(-greatest(-35.0e0, least(35.0e0,
           ({SCORE_THETA[0]!r}e0 + {SCORE_THETA[1]!r}e0 * value))))), 9) as p,
       cast(1.0e0 / (1.0e0 + exp(-greatest(-35.0e0, least(35.0e0,
           ({SCORE_THETA[0]!r}e0 + {SCORE_THETA[1]!r}e0 * value))))) >= {SCORE_THR} as integer) as y_pred
from events""")
def stream_score(spark, sf):
    """Stored θ and threshold applied to arriving rows (append)."""
    z = F.lit(SCORE_THETA[0]) + F.lit(SCORE_THETA[1]) * F.col("value")
    st = _events_stream(spark, sf).select("event_id", sigmoid(z).alias("p"))
    st = st.withColumn("y_pred", (F.col("p") >= F.lit(SCORE_THR)).cast("int"))
    out = S.run_append(st, "score")
    return out.select("event_id", rnd("p", 9).alias("p"), "y_pred")


@register("stream_windows", sql="""
select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type,
       count(*) as n, round(sum(value), 6) as value_sum
from events group by all""")
def stream_windows(spark, sf):
    """1-day tumbling windows per type with a watermark as long as the data reaches (update mode)."""
    w = S.windows(_events_stream(spark, sf), "ts", ["event_type"],
                  [F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum")], "1 day", watermark=_delay(spark, sf))
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type",
                    "n", rnd("value_sum").alias("value_sum"))


SESSION_GAP_MIN = 30


@register("stream_sessions", sql=f"""
with e as (select user_id, ts,
                  case when lag(ts) over (partition by user_id order by ts) is null
                            or ts - lag(ts) over (partition by user_id order by ts)
                               >= interval {SESSION_GAP_MIN} minute then 1 else 0 end as new_s
           from events),
s as (select *, sum(new_s) over (partition by user_id order by ts rows unbounded preceding) as sid from e)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start,
       strftime(max(ts) + interval {SESSION_GAP_MIN} minute, '%Y-%m-%d %H:%M:%S') as session_end,
       count(*) as n
from s group by user_id, sid""")
def stream_sessions(spark, sf):
    """Per-user activity sessions (30-minute gap) from the event stream."""
    w = S.sessions(_events_stream(spark, sf), "ts", ["user_id"], {"n": F.lit(1)}, f"{SESSION_GAP_MIN} minutes")
    fmt = "yyyy-MM-dd HH:mm:ss"
    return w.select("user_id", F.date_format("session_start", fmt).alias("session_start"),
                    F.date_format("session_end", fmt).alias("session_end"), "n")


@register("stream_sliding", sql="""
with b as (select event_type, value, time_bucket(interval 12 hour, ts) as s0 from events),
w as (select event_type, value, s0 as ws from b
      union all select event_type, value, s0 - interval 12 hour from b)
select strftime(ws, '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n,
       round(sum(value), 6) as value_sum
from w group by all""")
def stream_sliding(spark, sf):
    """1-day windows sliding every 12 hours per type (update mode)."""
    w = S.windows(_events_stream(spark, sf), "ts", ["event_type"],
                  [F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum")], "1 day",
                  slide="12 hours", watermark=_delay(spark, sf), name="sliding")
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type",
                    "n", rnd("value_sum").alias("value_sum"))


def _updates_stream(spark, sf):
    e = _events_stream(spark, sf)
    return e.select("event_id", "ts", F.concat(F.lit("c"), (F.col("user_id") % T.N_CLIENTS).cast("string"))
                    .alias("client_id"), T.round_col(F.col("ts")).alias("round"), "value")


@register("stream_dedup_keys", sql=f"""
select distinct concat('c', cast(user_id % 4 as varchar)) as client_id, {ROUND_SQL} as round from events""")
def stream_dedup_keys(spark, sf):
    """Duplicate (client, round) updates rejected on the stream; the surviving keys."""
    delay = _delay(spark, sf)
    d = S.dedup_within_watermark(_updates_stream(spark, sf), ["client_id", "round"], "ts", delay)
    return S.run_append(d.select("client_id", "round"), "dedup", watermark=delay)


@register("stream_barrier", sql=f"""
select {ROUND_SQL} as round from events
group by all having count(distinct concat('c', cast(user_id % 4 as varchar))) >= {T.N_CLIENTS}""")
def stream_barrier(spark, sf):
    """Rounds released by the streaming barrier (first update of each round and client, then a count)."""
    b = S.round_barrier(_updates_stream(spark, sf), "round", "client_id", T.N_CLIENTS, "ts", _delay(spark, sf))
    return b.select("round")
