"""Rounds of party models with a ledger, and the evaluation of their stored global models.

Every party fits one model per round; the round's global model is the united forest of the
parties (``rf``) or the row-weighted mean of their models. Models are written to fresh folders
under ``base`` and count only once their ledger row (round, party, n, seed, path) is there, so a
run that was stopped goes on at the first missing party and never reads a half-written model.
``party`` null marks the global model of a round. Everything the driver holds is one row per
party and round.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import metrics as M
from ledgerlens.operators import models as MD
from ledgerlens.operators import trees as TR

LEDGER = "round int, party string, family string, n long, seed long, path string"


def ledger(spark: SparkSession, base: str) -> DataFrame:
    """(round, party, family, n, seed, path) of all finished models under ``base``; empty before the first."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{base}/ledger")
    except AnalysisException:  # nothing written yet
        return spark.createDataFrame([], LEDGER)


def record(spark: SparkSession, base: str, round_no: int, party: str | None, n: int, seed: int, model: MD.Fitted, threshold: float | None = None) -> str:
    """Stores a model and then its ledger row; returns the model's path."""
    path = f"{base}/models/{uuid.uuid4().hex}"
    model.save(spark, path, threshold)
    spark.createDataFrame([(round_no, party, model.family, n, seed, path)], LEDGER).coalesce(1).write.mode("append").parquet(f"{base}/ledger")
    return path


def latest_global(spark: SparkSession, base: str) -> tuple[int, str]:
    """(round, path) of the global model of the last finished round."""
    row = ledger(spark, base).filter("party is null").agg(F.max(F.struct("round", "path")).alias("r")).first()["r"]
    if row is None:
        raise ValueError(f"no finished round under {base}")
    return row["round"], row["path"]


def run_rounds(train: DataFrame, features: Sequence[str], family: str, rounds: int, base: str, party: str = "party", label: str = "y",
               n_trees: int = 400, max_trees: int | None = 800, seed: int = 42, diversify: bool = False, id_col: str = "txn_id",
               after: Callable[[int, str], None] | None = None) -> MD.Fitted:
    """``rounds`` rounds of party models; returns the last global model. ``train`` should be a stored table.

    ``diversify`` adds the round to the seed; without it all rounds fit alike. ``after(round, party)`` is called once a
    party's model counts. Run again with the same ``base``, finished models are taken from the ledger.
    """
    spark = train.sparkSession
    sizes = dict(MD.party_sizes(train, party))
    per = max(1, min(n_trees, max_trees // max(1, len(sizes)))) if max_trees else n_trees
    last = None
    for r in range(1, rounds + 1):
        done = {row["party"]: row["path"] for row in ledger(spark, base).filter(F.col("round") == r).collect()}  # one row per party
        if None in done:
            last = done[None]
            continue
        now = seed + (r if diversify else 0)
        for p, n in sizes.items():
            if str(p) not in done:
                model = MD.fit_party(train.filter(F.col(party) == p), features, family, label, per, now, id_col)
                done[str(p)] = record(spark, base, r, str(p), n, now, model)
                if after:
                    after(r, p)
        parts = [(n, MD.load(spark, done[str(p)])[0]) for p, n in sizes.items()]
        if family == "rf":
            whole = MD.Fitted("rf", features, TR.unite([m.model for _, m in parts], max_trees), id_col)
        else:
            total = sum(n for n, _ in parts)
            whole = MD.Fitted("ensemble", features, [(n / total, m) for n, m in parts], id_col)
        last = record(spark, base, r, None, sum(sizes.values()), now, whole)
    return MD.load(spark, last)[0]


def evaluate_clients(spark: SparkSession, base: str, df: DataFrame, party: str = "party", label: str = "y", tune: bool = False) -> DataFrame:
    """The last global model on every client's rows: a row per client, one over all rows (micro), and the mean of the clients (macro).

    Rows are scored once and written; the threshold is 0.5, or each scope's own best one with ``tune`` (flagged as leaked).
    """
    round_no, path = latest_global(spark, base)
    model, kept = MD.load(spark, path)
    scored = TR.stored(model.score(df).select(party, label, "p_hat"), "client-scores")
    at = 0.5 if kept is None else kept
    nobody = F.lit(None).cast(df.schema[party].dataType)
    clients = M.evaluate(scored, label, "p_hat", [party], tune_on_test=tune, default_threshold=at).withColumn("scope", F.lit("client"))
    micro = M.evaluate(scored, label, "p_hat", tune_on_test=tune, default_threshold=at).withColumns({"scope": F.lit("micro"), party: nobody})
    macro = M.macro(clients).withColumns({"scope": F.lit("macro"), party: nobody, "leakage": F.lit(tune)})
    rows = clients.unionByName(micro, allowMissingColumns=True).unionByName(macro, allowMissingColumns=True)
    source = F.lit("best_F1_on_TEST" if tune else "default_0.5" if kept is None else "stored")
    return rows.withColumns({"round": F.lit(round_no), "family": F.lit(model.family), "threshold_source": source})
