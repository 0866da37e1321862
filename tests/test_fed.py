import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import linear as L, rounds as R


def lr_data(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(120):
        x1, x2 = rng.normal(), rng.normal()
        y = int(x1 + 0.5 * x2 + rng.normal() * 0.3 > 0)
        rows.append((i % 3, y, float(x1), float(x2), 1.0))
    return spark.createDataFrame(rows, "party int, y int, x1 double, x2 double, x0 double"), rows


def test_grad_sum_matches_numpy(spark):
    df, rows = lr_data(spark)
    theta = [0.3, -0.2, 0.1]
    g = {r["party"]: r for r in L.grad_sums(df, ["x1", "x2", "x0"], "y", theta).collect()}
    for party in range(3):
        X = np.array([[r[2], r[3], r[4]] for r in rows if r[0] == party])
        y = np.array([r[1] for r in rows if r[0] == party])
        p = 1 / (1 + np.exp(-np.clip(X @ np.array(theta), -35, 35)))
        exp = X.T @ (p - y)
        assert [g[party][f"g{j}"] for j in range(3)] == pytest.approx(exp.tolist())
        assert g[party]["n"] == len(y)


def test_fedavg_skips_empty_party(spark):
    upd = spark.createDataFrame([(0, 10, 1.0, 2.0), (1, 0, 100.0, 100.0), (2, 30, 3.0, -2.0)],
                                "party int, n long, g0 double, g1 double")
    th = L.fedavg_step(upd, 2, [0.0, 0.0], lr=0.1)
    assert th == pytest.approx([-0.1 * 4.0 / 40, -0.1 * 0.0 / 40])
    b = R.barrier(spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "round int, client_id string"), 3)
    assert b.first()["ready"]  # the empty party still counts for the barrier


def test_fedavg_rounds_decrease_loss(spark):
    df, rows = lr_data(spark)
    thetas = L.fedavg_rounds(df, ["x1", "x2", "x0"], "y", rounds=5, lr=1.0)
    X = np.array([[r[2], r[3], r[4]] for r in rows]); y = np.array([r[1] for r in rows])

    def loss(t):
        p = 1 / (1 + np.exp(-(X @ np.array(t))))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    assert loss(thetas[-1]) < loss(thetas[0]) < loss([0, 0, 0])


def test_dedup_first_wins(spark):
    u = spark.createDataFrame([("a", 1, 5, 1, 10.0), ("a", 1, 3, 2, 20.0), ("b", 1, 9, 3, 30.0), ("a", 2, 1, 4, 40.0)],
                              "client_id string, round int, ts long, event_id long, value double")
    got = {(r["client_id"], r["round"]): r["value"] for r in R.dedup_first(u, ["client_id", "round"], ["ts", "event_id"]).collect()}
    assert got == {("a", 1): 20.0, ("b", 1): 30.0, ("a", 2): 40.0}


def test_valid_updates_rules(spark):
    u = spark.createDataFrame([("a", "lr", [1.0, 2.0]), ("b", "lr", [1.0, 2.0]), ("a", "rf", [1.0, 2.0]),
                               ("a", "lr", [1.0])], "client_id string, model string, g array<double>")
    reg = spark.createDataFrame([("a",)], "client_id string")
    got = R.valid_updates(u, reg, "lr", vector_col="g", dim=2).collect()
    assert [(r["client_id"], r["model"]) for r in got] == [("a", "lr")]


def test_stale_and_summary(spark):
    u = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0), ("a", 3, 3.0), ("b", 2, 4.0)],
                              "client_id string, round int, value double")
    st = {r["status"]: r["count"] for r in u.groupBy(R.round_status(u, 2).alias("status")).count().collect()}
    assert st == {"stale": 1, "current": 2, "future": 1}
    assert R.reject_off_round(u, 2).count() == 2
    s = {r["round"]: r["clients"] for r in R.summary(u).collect()}
    assert s[2] == "b"
    assert R.latest_ready_round(u, 1).first()["round"] == 3
    assert [r["round"] for r in R.kmin_violations(u, 2).collect()] != []


def test_vector_sum_and_dims(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "v array<double>")
    assert {r["pos"]: r["total"] for r in R.vector_sum(df, "v").collect()} == {0: 4.0, 1: 6.0}
    bad = spark.createDataFrame([([1.0, 2.0],), ([3.0],)], "v array<double>")
    with pytest.raises(ValueError):
        R.check_dims(bad, "v")


def test_bias_column_added_when_theta_longer(spark):
    df = spark.createDataFrame([(2.0,)], "x double")
    p = L.score(df, ["x"], [0.5, -1.0]).first()["p"]
    assert p == pytest.approx(1 / (1 + np.exp(-(0.5 * 2.0 - 1.0))))


def test_fedavg_rounds_resume(spark):
    from ledgerlens.session import scratch_path
    df, _ = lr_data(spark)
    path = scratch_path(spark, "fedavg-state")
    full = L.fedavg_rounds(df, ["x1", "x2", "x0"], "y", rounds=3, lr=1.0)
    part = L.fedavg_rounds(df, ["x1", "x2", "x0"], "y", rounds=2, lr=1.0, state_path=path)
    resumed = L.fedavg_rounds(df, ["x1", "x2", "x0"], "y", rounds=3, lr=1.0, state_path=path)
    assert part == full[:2]
    assert all(a == pytest.approx(b) for a, b in zip(resumed, full)) and len(resumed) == 3


def test_array_gradient_equals_the_wide_form(spark):
    rng = np.random.default_rng(2)
    rows = [(f"p{i % 3}" if i % 7 else None, int(rng.integers(2)), [float(v) for v in rng.normal(size=5)]) for i in range(400)]
    df = spark.createDataFrame(rows, "party string, y int, x array<double>").repartition(5)
    theta = [.5, -1.0, .25, 0.0, 2.0]
    wide = df.select("party", "y", *[F.col("x")[j].alias(f"x{j}") for j in range(5)])
    want = {(r["party"], j): (r["n"], r[f"g{j}"]) for r in L.grad_sums(wide, [f"x{j}" for j in range(5)], "y", theta).collect() for j in range(5)}
    for held in (1024, 1):
        got = {(r["party"], r["pos"]): (r["n"], r["grad"]) for r in L.grad_sums_array(df, "x", "y", theta, held=held).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)
    assert L.grad_sums_array(df.limit(0), "x", "y", theta).count() == 0
    for bad in ([1.0] * 4, None, [1.0, 2.0, 3.0, 4.0, float("nan")], [1.0, 2.0, 3.0, 4.0, None]):
        with pytest.raises(Exception, match="5 finite numbers"):
            L.grad_sums_array(spark.createDataFrame([("a", 1, bad)], df.schema), "x", "y", theta).collect()
