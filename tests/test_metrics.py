import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import metrics as M
from ledgerlens.operators import ranking as RK

Y = [0, 0, 1, 1, 0, 1]
P = [.1, .2, .35, .4, .5, .8]


def frame(spark, ys, ps, groups=None):
    rows = [(i, y, p, (groups[i] if groups else 0)) for i, (y, p) in enumerate(zip(ys, ps))]
    return spark.createDataFrame(rows, "id long, y int, p double, g int")


def brute_curve(ys, ps):
    ts = sorted(set(ps))
    P = sum(ys)
    out = []
    for t in ts:
        tp = sum(1 for y, p in zip(ys, ps) if p >= t and y == 1)
        fp = sum(1 for y, p in zip(ys, ps) if p >= t and y == 0)
        prec = tp / (tp + fp)
        rec = tp / P if P else 1.0
        f1 = 2 * prec * rec / (prec + rec) if prec + rec > 0 else 0.0
        out.append((t, prec, rec, f1))
    return out


def brute_threshold(ys, ps, mode):
    c = brute_curve(ys, ps)
    f1 = [x[3] for x in c] + [0.0]
    ts = [x[0] for x in c]
    if mode == "exact":
        i = max(range(len(c)), key=lambda k: (f1[k], -k))
        return ts[i]
    if mode == "train":
        if len(ts) == 0:
            return 0.5
        k = max(range(1, len(f1)), key=lambda j: (f1[j], -j))
        return ts[k - 1]
    i = max(range(len(f1)), key=lambda j: (f1[j], -j))
    return ts[i - 1] if i > 0 else 0.5


def brute_ap(ys, ps):
    c = sorted(brute_curve(ys, ps), key=lambda x: -x[0])
    ap, prev_r = 0.0, 0.0
    for t, prec, rec, _ in c:
        ap += (rec - prev_r) * prec
        prev_r = rec
    return ap


def brute_auc(ys, ps):
    pos = [p for y, p in zip(ys, ps) if y == 1]
    neg = [p for y, p in zip(ys, ps) if y == 0]
    if not pos or not neg:
        return None
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


@pytest.mark.parametrize("mode,expect", [("exact", .35), ("train", .2), ("eval", .2)])
def test_best_f1_fixture(spark, mode, expect):
    cv = M.curve(frame(spark, Y, P), "y", "p")
    assert M.best_f1_threshold(cv, None, mode).first()["threshold"] == pytest.approx(expect)


def test_random_against_brute_force(spark):
    rng = random.Random(7)
    for trial in range(4):
        n = 60
        ys = [rng.randint(0, 1) for _ in range(n)]
        ps = [round(rng.random(), 1) for _ in range(n)]  # ties on purpose
        cv = M.curve(frame(spark, ys, ps), "y", "p")
        row = cv.agg(M.ap_agg(), M.auc_agg()).first()
        assert row["auprc"] == pytest.approx(brute_ap(ys, ps))
        assert row["roc_auc"] == pytest.approx(brute_auc(ys, ps))
        for mode in M.MODES:
            got = M.best_f1_threshold(cv, None, mode).first()["threshold"]
            assert got == pytest.approx(brute_threshold(ys, ps, mode)), (trial, mode)


def test_curve_is_range_independent(spark, many_ranges):
    """Many ranges give the same curve as a single one."""
    rng = random.Random(3)
    ys = [rng.randint(0, 1) for _ in range(400)]
    ps = [rng.random() for _ in range(400)]
    df = frame(spark, ys, ps)
    cols = ["score", "cum_pos", "cum_neg", "tot_pos", "prev", "prev_pos", "prev_neg"]

    def run():
        sc = M.score_counts(df, "y", "p")
        out = RK.running_sums(sc, "score", ["pos", "neg"], totals=True, lower_col="prev", lower_values=True)
        return sorted(tuple(r) for r in out.select(*cols).collect())

    rb = run()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    ra = run()
    assert ra == rb


def test_one_class_only(spark):
    ev = M.evaluate(frame(spark, [0] * 5, [.1, .2, .3, .4, .5]), "y", "p", tune_on_test=False).first()
    assert ev["roc_auc"] is None and ev["precision"] == 0.0 and ev["recall"] == 0.0


def test_single_distinct_score(spark):
    cv = M.curve(frame(spark, [0, 1, 1], [.3, .3, .3]), "y", "p")
    assert M.best_f1_threshold(cv, None, "train").first()["threshold"] == pytest.approx(.3)
    assert M.best_f1_threshold(cv, None, "eval").first()["threshold"] == pytest.approx(.5)


def test_monotone_map_invariance(spark):
    rng = random.Random(11)
    ys = [rng.randint(0, 1) for _ in range(80)]
    ps = [rng.random() for _ in range(80)]
    a = M.curve(frame(spark, ys, ps), "y", "p").agg(M.ap_agg(), M.auc_agg()).first()
    b = M.curve(frame(spark, ys, [math.exp(3 * p) for p in ps]), "y", "p").agg(M.ap_agg(), M.auc_agg()).first()
    assert a["auprc"] == pytest.approx(b["auprc"]) and a["roc_auc"] == pytest.approx(b["roc_auc"])


def test_grouped_equals_per_group(spark):
    rng = random.Random(5)
    ys = [rng.randint(0, 1) for _ in range(90)]
    ps = [round(rng.random(), 2) for _ in range(90)]
    gs = [i % 3 for i in range(90)]
    ev = {r["g"]: r for r in M.evaluate(frame(spark, ys, ps, gs), "y", "p", ["g"]).collect()}
    for g in range(3):
        yy = [y for y, k in zip(ys, gs) if k == g]
        pp = [p for p, k in zip(ps, gs) if k == g]
        assert ev[g]["auprc"] == pytest.approx(brute_ap(yy, pp))
        assert ev[g]["threshold"] == pytest.approx(brute_threshold(yy, pp, "eval"))
        thr = ev[g]["threshold"]
        tp = sum(1 for y, p in zip(yy, pp) if y == 1 and p >= thr)
        assert ev[g]["tp"] == tp


def test_rank_to_prob(spark):
    df = frame(spark, [0, 1, 0, 1], [.5, .1, .5, .9])
    got = {r["id"]: r["prob"] for r in M.rank_to_prob(df, "p", "id").collect()}
    d = 3 + 1e-9
    assert got == pytest.approx({1: 0 / d, 0: 1 / d, 2: 2 / d, 3: 3 / d})


def test_tie_robust_rank_with_hot_score(spark, many_ranges):
    """One score holds most rows; ranks still equal a (score, id) row_number."""
    rows = [(i, 0 if i % 10 else 1, 0.5 if i % 3 else float(i % 7)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, y int, p double")
    got = {r["id"]: r["rn"] for r in RK.row_number(df, ["p", "id"]).collect()}
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    assert got == {r[0]: k + 1 for k, r in enumerate(order)}


def test_macro_rules(spark):
    pg = spark.createDataFrame([(0, None, 0.5), (1, 0.8, 0.7), (2, 0.6, None)], "party int, roc_auc double, f1 double")
    a = M.macro(pg, ("roc_auc", "f1")).first()
    assert a["roc_auc"] == pytest.approx(0.7) and a["f1"] == pytest.approx(0.6)
    b = M.macro(pg, ("roc_auc", "f1"), first_rule_order="party").first()
    assert b["roc_auc"] is None and b["f1"] == pytest.approx(0.6)


def test_null_scores_stop_the_job_and_null_keys_keep_their_place(spark, many_ranges):
    import pytest
    from pyspark.sql import functions as F

    from ledgerlens.operators import metrics as M
    from ledgerlens.operators import ranking as R
    df = spark.createDataFrame([(1, 1, 0.5), (2, 0, None), (3, 0, float("nan"))], "id long, y int, p double")
    with pytest.raises(Exception, match="null or NaN score"):
        M.score_counts(df, "y", "p").collect()
    rows = [(None if k % 10 == 0 else f"C{k * 7 % 50}",) for k in range(50)]
    ids = spark.createDataFrame(rows, "k string")
    got = R.row_number(ids, [F.col("k")], out="n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 51))
    assert [r["k"] for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or ""))


def test_a_null_party_keeps_its_row(spark):
    df = spark.createDataFrame([("a", 1, .9), ("a", 0, .2), (None, 1, .7), (None, 0, .8)], "party string, y int, p double")
    for tune in (True, False):
        got = {r["party"]: r["n"] for r in M.evaluate(df, "y", "p", ["party"], tune_on_test=tune).collect()}
        assert got == {"a": 2, None: 2}


@pytest.mark.parametrize("mode", M.MODES)
def test_one_pass_metrics_equal_a_count_of_the_rows(spark, many_ranges, mode):
    """Groups with ties, with one score and with a null key: the counts at the threshold are those of the rows."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 1), round(rng.random(), 1)) for _ in range(300)]
    rows += [("one", 1, .25), ("one", 0, .25), ("none", 0, .1), ("none", 0, .9)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    for tune in (True, False):
        got = {r["g"]: r for r in M.evaluate(df, "y", "p", ["g"], tune_on_test=tune, mode=mode).collect()}
        assert set(got) == {"a", "b", None, "one", "none"}
        for g, r in got.items():
            own = [(y, p) for x, y, p in rows if x == g]
            t = brute_threshold([y for y, _ in own], [p for _, p in own], mode) if tune else 0.5
            t = t[0] if isinstance(t, tuple) else t
            assert r["threshold"] == pytest.approx(t)
            want = {(a, b): sum(y == a and (p >= t) == b for y, p in own) for a in (0, 1) for b in (False, True)}
            assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (want[0, False], want[0, True], want[1, False], want[1, True])
            assert r["n"] == len(own)
    empty = M.evaluate(df.limit(0), "y", "p", mode=mode).first()
    assert (empty["n"], empty["tp"], empty["f1"]) == (0, 0, 0.0)
