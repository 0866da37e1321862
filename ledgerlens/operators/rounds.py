"""Federated round rules over a table of client updates.

An update row is ``(client_id, round, model, arrival order..., payload)``. The
reference enforces these rules one HTTP request at a time under a lock; here
they are set operations over all updates at once (batch) or per micro-batch
(streaming). Every rule is a hash aggregation or a semi/anti join, so a client
or round holding a third of all updates is pre-aggregated map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedup_first(updates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first update per key by arrival order (first wins).

    ``min_by`` over a struct is a partial aggregation: a hot key costs one row
    per partition before the shuffle, unlike a window over the key.
    """
    cols = [c for c in updates.columns if c not in keys]
    first = F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order]))
    return updates.groupBy(*keys).agg(first.alias("_f")).select(*keys, "_f.*")


def round_status(updates: DataFrame, current_round: int | Column, col: str = "round") -> Column:
    cur = current_round if isinstance(current_round, Column) else F.lit(int(current_round))
    return (F.when(F.col(col) < cur, "stale").when(F.col(col) > cur, "future").otherwise("current"))


def reject_off_round(updates: DataFrame, current_round: int) -> DataFrame:
    """Stale (earlier) or future rounds are rejected."""
    return updates.filter(F.col("round") == F.lit(int(current_round)))


def barrier(updates: DataFrame, expected_clients: int) -> DataFrame:
    """Per round: distinct clients seen, updates received, ready when clients ≥ expected."""
    return (updates.groupBy("round")
            .agg(F.count_distinct("client_id").alias("n_clients"), F.count(F.lit(1)).alias("received"))
            .withColumn("ready", F.col("n_clients") >= F.lit(int(expected_clients))))


def kmin_violations(updates: DataFrame, k_min: int) -> DataFrame:
    """Rounds aggregated from fewer than ``k_min`` distinct clients."""
    return (updates.groupBy("round").agg(F.count_distinct("client_id").alias("n_clients"))
            .filter(F.col("n_clients") < F.lit(int(k_min))))


def valid_updates(updates: DataFrame, registry: DataFrame, server_model: str,
                  vector_col: str | None = None, dim: int | None = None) -> DataFrame:
    """Registered clients only (semi join), model must match, optional vector size check."""
    out = updates.join(registry.select("client_id").distinct(), "client_id", "left_semi")
    out = out.filter(F.col("model") == F.lit(server_model))
    if vector_col is not None and dim is not None:
        out = out.filter(F.size(vector_col) == F.lit(int(dim)))
    return out


MAX_ROUND_CLIENTS = 10_000  # the client list of a round is one value; checked first


def summary(updates: DataFrame, max_clients: int = MAX_ROUND_CLIENTS) -> DataFrame:
    """Per round: sorted distinct client list, received, distinct clients, value sum.

    The list is gathered per round, so the number of distinct clients per round
    is checked against ``max_clients`` before it is built.
    """
    big = (updates.groupBy("round").agg(F.count_distinct("client_id").alias("k"))
           .filter(F.col("k") > max_clients).limit(1).collect())
    if big:
        raise ValueError(f"round {big[0]['round']} has more than {max_clients} clients")
    return updates.groupBy("round").agg(
        F.array_join(F.array_sort(F.collect_set("client_id")), ",").alias("clients"),
        F.count(F.lit(1)).alias("received"),
        F.count_distinct("client_id").alias("n_clients"),
        F.sum("value").alias("value_sum"))


def latest_ready_round(updates: DataFrame, expected_clients: int) -> DataFrame:
    b = barrier(updates, expected_clients)
    return b.filter("ready").agg(F.max("round").alias("round"))


def vector_sum(df: DataFrame, vec: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Element-wise sum of an array column: (group..., pos, total).

    ``posexplode`` then a hash aggregation on (group, pos): partial sums per task
    mean the shuffle carries ``partitions × dim`` rows, independent of row count.
    Rows whose dimension differs from the first are rejected by ``check_dims``.
    """
    e = df.select(*group_cols, F.posexplode(vec).alias("pos", "_v"))
    return e.groupBy(*group_cols, "pos").agg(F.sum(F.col("_v").cast("double")).alias("total"))


def check_dims(df: DataFrame, vec: str) -> int:
    """All vectors must share one dimension; returns it."""
    r = df.agg(F.min(F.size(vec)).alias("lo"), F.max(F.size(vec)).alias("hi")).first()
    if r["lo"] != r["hi"]:
        raise ValueError(f"vector dimensions differ: {r['lo']} vs {r['hi']}")
    return int(r["lo"] or 0)
