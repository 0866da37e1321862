"""Logistic scoring, per-party gradient sums and FedAvg rounds.

Partial + final aggregation: each party's gradient is one ``groupBy(party)``
aggregate over wide feature columns (map-side partial sums, so a party with a
third of all rows costs nothing extra); the server step sums the per-party rows.
θ is a short driver-side vector inlined as literals, so every round is one scan
with no lineage carried between rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.vectors import dot_wide, sigmoid


def score(df: DataFrame, features: Sequence[str], theta: Sequence[float], out: str = "p") -> DataFrame:
    return df.withColumn(out, sigmoid(dot_wide(features, theta)))


def grad_sums(df: DataFrame, features: Sequence[str], label: str, theta: Sequence[float],
              group_cols: Sequence[str] = ("party",), weight: str | None = None) -> DataFrame:
    """Per group: ``n`` and ``g_j = Σ w_i (σ(x_i·θ) − y_i) x_ij`` as wide columns ``g0..``."""
    err = sigmoid(dot_wide(features, theta)) - F.col(label).cast("double")
    if weight:
        err = err * F.col(weight)
    d = df.select(*group_cols, *features, err.alias("_err"))
    aggs = [F.sum(F.col("_err") * F.col(c).cast("double")).alias(f"g{j}") for j, c in enumerate(features)]
    return d.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"), *aggs)


def grad_sums_array(df: DataFrame, vec: str, label: str, theta: Sequence[float], group: str = "party", held: int = 1024) -> DataFrame:
    """The gradient of :func:`grad_sums` from one array column: (group, n, pos, grad).

    For many features: a task holds one dense sum per group (at most ``held`` of them at a time) instead of a plan a column wide for
    each feature, and writes it as one row; the rows of all tasks are added by (group, position). A vector that is null, of another
    length than θ or with a null or non-finite component raises an error.
    """
    weights = np.asarray(theta, float)
    kind = df.schema[group].dataType.simpleString()
    rows = df.select(F.col(group).alias("g"), F.col(label).cast("double").alias("y"), F.transform(vec, lambda v: v.cast("double")).alias("x"))

    def partial(batches):
        sums: dict = {}

        def flush():
            keys = list(sums)
            out = pa.RecordBatch.from_pydict({"g": pa.array(keys, arrow_kind), "n": [sums[k][0] for k in keys], "s": [sums[k][1].tolist() for k in keys]})
            sums.clear()
            return out

        for batch in batches:
            arrow_kind = batch.schema.field("g").type
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys, x = part.column(0).to_pylist(), part.column(2)
                flat = x.flatten().to_numpy(zero_copy_only=False)
                if x.null_count or len(flat) != len(x) * len(weights) or set(x.value_lengths().to_pylist()) - {len(weights)} or not np.isfinite(flat).all():
                    raise ValueError(f"vectors must hold {len(weights)} finite numbers")
                m = flat.reshape(len(x), len(weights))
                err = 1.0 / (1.0 + np.exp(-np.clip(m @ weights, -35.0, 35.0))) - part.column(1).to_numpy(zero_copy_only=False)
                order: dict = {}
                for k, key in enumerate(keys):
                    order.setdefault(key, []).append(k)
                for key, mine in order.items():
                    n, s = sums.get(key, (0, 0.0))
                    sums[key] = (n + len(mine), s + err[mine] @ m[mine])
                if len(sums) >= held:
                    yield flush()
        if sums:
            yield flush()

    parts = rows.mapInArrow(partial, f"g {kind}, n bigint, s array<double>")
    total = parts.select("g", "n", F.posexplode("s").alias("pos", "v")).groupBy("g", "pos").agg(F.sum("n").alias("n"), F.sum("v").alias("grad"))
    return total.select(F.col("g").alias(group), "n", "pos", "grad")


def grad_long(g: DataFrame, features: Sequence[str], group_cols: Sequence[str] = ("party",)) -> DataFrame:
    """Wide per-party gradients → (group..., feature, grad, n)."""
    st = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"g{j}").alias("grad"))
                             for j, c in enumerate(features)]))
    return g.select(*group_cols, "n", st.alias("s")).select(*group_cols, "s.feature", "s.grad", "n")


def fedavg_step(updates: DataFrame, dim: int, theta: Sequence[float], lr: float = 0.1) -> list[float]:
    """θ' = θ − lr · Σ_parties g / Σ_parties n over updates with n > 0.

    ``updates`` holds one row per party (``n``, ``g0..g{dim-1}``): tiny, so the
    final sum is collected as one row. No rows with n > 0 → θ unchanged.
    """
    u = updates.filter(F.col("n") > 0)
    row = u.agg(F.sum("n").alias("n"), *[F.sum(f"g{j}").alias(f"g{j}") for j in range(dim)]).first()
    if not row["n"]:
        return list(theta)
    return [float(theta[j]) - lr * float(row[f"g{j}"]) / float(row["n"]) for j in range(dim)]


def fedavg_rounds(df: DataFrame, features: Sequence[str], label: str, rounds: int, lr: float = 0.1,
                  theta0: Sequence[float] | None = None, group_cols: Sequence[str] = ("party",),
                  weight: str | None = None, reset_each_round: bool = False,
                  state_path: str | None = None) -> list[list[float]]:
    """Driver loop: per round one distributed aggregate, θ back as a short list.

    θ carries over between rounds; ``reset_each_round`` restarts each round from
    zeros (the reference server's behaviour when its aggregator is rebuilt).
    With ``state_path`` (a shared folder) each finished round's θ is written
    there, and a restarted job resumes after the last finished round.
    """
    d = len(features)
    theta = list(theta0) if theta0 is not None else [0.0] * d
    out: list[list[float]] = []
    spark = df.sparkSession
    if state_path:
        at = spark._jvm.org.apache.hadoop.fs.Path(state_path)
        written = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        done = spark.read.parquet(state_path).orderBy("round").collect() if written else []
        out = [list(r["theta"]) for r in done][:rounds]
        if out:
            theta = out[-1]
    for r in range(len(out), rounds):
        start = [0.0] * d if reset_each_round else theta
        g = grad_sums(df, features, label, start, group_cols, weight)
        theta = fedavg_step(g, d, start, lr)
        out.append(theta)
        if state_path:
            spark.createDataFrame([(r + 1, [float(t) for t in theta])], "round int, theta array<double>") \
                .write.mode("append").parquet(state_path)
    return out


def theta_frame(spark, thetas: list[list[float]], features: Sequence[str]) -> DataFrame:
    rows = [(r + 1, f, float(t)) for r, th in enumerate(thetas) for f, t in zip(features, th)]
    return spark.createDataFrame(rows, "round int, feature string, theta double")


def score_expr(features: Sequence[str], theta: Sequence[float]) -> Column:
    return sigmoid(dot_wide(features, theta))
