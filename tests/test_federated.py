import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import federated as FD
from ledgerlens.operators import metrics as M
from ledgerlens.operators import models as MD
from ledgerlens.operators import trees as TR
from ledgerlens.session import scratch_path


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(360, 2))
    data = [(i, int(a + 0.3 * rng.normal() > 0.2), float(a), float(b), f"p{i % 3}") for i, (a, b) in enumerate(x)]
    return TR.stored(spark.createDataFrame(data, "txn_id long, y int, a double, b double, party string"), "test-rows")


class Killed(Exception):
    pass


def scores(model, df):
    return {r["txn_id"]: r["p_hat"] for r in model.score(df).select("txn_id", "p_hat").collect()}


def test_a_stopped_run_goes_on_where_it_was(rows, spark):
    base, calls = scratch_path(spark, "rounds"), []

    def stop(r, p):
        calls.append((r, p))
        if len(calls) == 4:
            raise Killed

    with pytest.raises(Killed):
        FD.run_rounds(rows, ["a", "b"], "rf", 2, base, n_trees=3, diversify=True, after=stop)
    before = {(r["round"], r["party"]): r["path"] for r in FD.ledger(spark, base).collect()}
    assert set(before) == {(1, None), (1, "p0"), (1, "p1"), (1, "p2"), (2, "p0")}
    assert FD.latest_global(spark, base)[0] == 1
    more = []
    model = FD.run_rounds(rows, ["a", "b"], "rf", 2, base, n_trees=3, diversify=True, after=lambda r, p: more.append((r, p)))
    assert more == [(2, "p1"), (2, "p2")]  # nothing is fitted twice
    after = {(r["round"], r["party"]): (r["path"], r["seed"]) for r in FD.ledger(spark, base).collect()}
    assert len(after) == 8 and all(after[k][0] == v for k, v in before.items())
    assert {k[0]: v[1] for k, v in after.items()} == {1: 43, 2: 44}
    assert FD.latest_global(spark, base) == (2, after[2, None][0])
    # the global forest holds the trees of the parties, and the rounds differ
    assert model.model.select("tree").distinct().count() == 9
    parts = [scores(MD.load(spark, after[2, p][0])[0], rows) for p in ("p0", "p1", "p2")]
    whole = scores(model, rows)
    assert whole == pytest.approx({i: sum(s[i] for s in parts) / 3 for i in whole})
    assert scores(MD.load(spark, after[1, None][0])[0], rows) != whole


def test_other_families_average_their_parties(rows, spark):
    base = scratch_path(spark, "rounds")
    model = FD.run_rounds(rows, ["a", "b"], "lr", 1, base)
    assert model.family == "ensemble" and [s for s, _ in model.model] == [1 / 3] * 3
    got = FD.evaluate_clients(spark, base, rows).collect()
    by = {(r["scope"], r["party"]): r for r in got}
    assert sorted(by, key=str) == sorted([("client", "p0"), ("client", "p1"), ("client", "p2"), ("micro", None), ("macro", None)], key=str)
    assert by["micro", None]["n"] == 360 and by["macro", None]["n"] is None
    assert by["macro", None]["f1"] == pytest.approx(sum(by["client", f"p{k}"]["f1"] for k in range(3)) / 3)
    want = M.evaluate(model.score(rows), "y", "p_hat", tune_on_test=False).first()
    assert by["micro", None]["roc_auc"] == pytest.approx(want["roc_auc"]) and by["micro", None]["threshold_source"] == "default_0.5"
    tuned = FD.evaluate_clients(spark, base, rows, tune=True)
    assert {r["leakage"] for r in tuned.collect()} == {True}
    assert tuned.filter("scope = 'micro'").first()["f1"] >= by["micro", None]["f1"] - 1e-12


def test_numbered_parties_resume_too(rows, spark):
    numbered = rows.withColumn("party", (F.col("txn_id") % 2).cast("int"))
    base, calls = scratch_path(spark, "rounds"), []
    for _ in range(2):
        FD.run_rounds(numbered, ["a", "b"], "lr", 1, base, after=lambda r, p: calls.append(p))
    assert calls == [0, 1]
    assert [r["party"] for r in FD.evaluate_clients(spark, base, numbered).filter("scope = 'client'").sort("party").collect()] == [0, 1]


def test_no_finished_round(spark):
    with pytest.raises(ValueError, match="no finished round"):
        FD.latest_global(spark, scratch_path(spark, "nothing"))
    assert FD.ledger(spark, scratch_path(spark, "nothing")).count() == 0
