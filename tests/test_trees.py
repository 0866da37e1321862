import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerlens.operators import models as MD
from ledgerlens.operators import trees as TR


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 2))
    data = [(i, int(a * b + 0.4 * rng.normal() > 0), float(a), float(b), f"p{i % 3}") for i, (a, b) in enumerate(x)]
    return TR.stored(spark.createDataFrame(data, "txn_id long, y int, a double, b double, party string"), "test-rows")


def estimator(n, k):
    return MD.build("rf", seed=5 + k, n_trees=n)


def by_id(df):
    return {r["txn_id"]: r["p_hat"] for r in df.select("txn_id", "p_hat").collect()}


def test_node_table_scores_as_the_fitted_forest(rows):
    train = MD.assemble(rows, ["a", "b"])
    fitted = estimator(7, 0).fit(train)
    nodes = TR.nodes_of(fitted, rows)
    assert nodes.schema.simpleString().replace("struct<", "").replace(":", " ").replace(",", ", ").rstrip(">") == TR.NODES
    want = by_id(fitted.transform(train).withColumn("p_hat", vector_to_array("probability")[1]))
    for most in (None, 200):  # one scorer, and several projections
        got = by_id(rows.withColumn("p_hat", TR.probability(nodes, ["a", "b"], most)))
        assert got == pytest.approx(want, abs=1e-12)
    with pytest.raises(ValueError, match="more than 3 nodes"):
        TR.probability(nodes, ["a", "b"], 3)


def test_batches_differ_and_number_their_trees(rows):
    nodes = TR.grow(MD.assemble(rows, ["a", "b"]), estimator, 10, batch=4)
    assert [r["tree"] for r in nodes.select("tree").distinct().sort("tree").collect()] == list(range(10))
    first = [tuple(r)[1:] for r in nodes.filter("tree = 0").sort("node").collect()]
    assert first != [tuple(r)[1:] for r in nodes.filter("tree = 4").sort("node").collect()]


def test_union_is_the_mean_of_the_party_forests(rows, spark):
    parts = [TR.grow(MD.assemble(rows.filter(F.col("party") == p), ["a", "b"]), estimator, 6) for p in ("p0", "p1", "p2")]
    scores = [by_id(rows.withColumn("p_hat", TR.probability(f, ["a", "b"]))) for f in parts]
    united = by_id(rows.withColumn("p_hat", TR.probability(TR.unite(parts), ["a", "b"])))
    assert united == pytest.approx({i: sum(s[i] for s in scores) / 3 for i in united})
    capped = TR.unite(parts, 7)
    assert capped.select("tree").distinct().count() == 6  # two of each party
    assert capped.filter("tree in (2, 3)").count() == parts[1].filter("tree < 2").count()


def test_united_party_forest_is_one_stored_model(rows, spark):
    from ledgerlens.session import scratch_path
    model = MD.party_forest(rows, ["a", "b"], n_trees=6, max_trees=9)
    assert model.model.select("tree").distinct().count() == 9
    path = scratch_path(spark, "united")
    model.save(spark, path, 0.4)
    again, thr = MD.load(spark, path)
    assert thr == 0.4 and by_id(again.score(rows)) == by_id(model.score(rows))
    pooled = MD.party_ensemble(rows, rows, ["a", "b"], "rf", n_trees=6, max_trees=9, weighted=False)
    assert by_id(pooled).keys() == by_id(rows.withColumn("p_hat", F.lit(0))).keys()


def test_missing_values_go_right(spark):
    nodes = spark.createDataFrame([(0, 0, 1, 2, 0, 0.5, 0.5), (0, 1, -1, -1, None, None, 0.1), (0, 2, -1, -1, None, None, 0.9)], TR.NODES)
    df = spark.createDataFrame([(1, 0.5), (2, 0.6), (3, None), (4, float("nan"))], "txn_id long, a double")
    assert by_id(df.withColumn("p_hat", TR.probability(nodes, ["a"]))) == {1: 0.1, 2: 0.9, 3: 0.9, 4: 0.9}


def jobs(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_deep_forests_take_no_more_jobs_than_shallow_ones(rows, spark):
    """Each task grows whole trees; a level of all trees was a job, with a histogram of each open node from each part."""
    train = MD.assemble(rows, ["a", "b"])
    deep, flat = (jobs(spark, f"forest-{d}", lambda d=d: estimator(6, 0).setMaxDepth(d).fit(train)) for d in (30, 1))
    assert deep == flat


def test_cells_count_equal_rows(rows, spark):
    from ledgerlens.operators import cells as C
    data = [(i, i % 2, float(i % 40), float(i % 3), 1.0) for i in range(400)]
    train = MD.assemble(spark.createDataFrame(data, "txn_id long, y int, a double, b double, w double"), ["a", "b"])
    cuts = C.edges(train, 32)
    assert cuts[1] == [0.0, 1.0] and 16 <= len(cuts[0]) <= 31 and max(cuts[0]) < 39
    got = C.counted(train, cuts, ["y", "w"]).collect()
    want = {}
    for _, y, a, b, w in data:
        key = (sum(c < a for c in cuts[0]), sum(c < b for c in cuts[1]), y, w)
        want[key] = want.get(key, 0) + 1
    assert {(*r["cell"], r["y"], r["w"]): r["n"] for r in got} == want and len(got) == len(want)


def test_forest_learns_as_well_as_sparks_own(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from ledgerlens.operators import metrics as M
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1500, 4))
    y = (x[:, 0] * x[:, 1] + np.sin(2 * x[:, 2]) + 0.4 * rng.normal(size=1500) > 0.5).astype(int)
    schema = "txn_id long, y int, a double, b double, c double, d double, w double"
    df = TR.stored(spark.createDataFrame([(i, int(y[i]), *map(float, x[i]), 1.0 + float(y[i])) for i in range(1500)], schema), "test-rows")
    train, test = (MD.assemble(df.filter(f), list("abcd")) for f in ("txn_id < 1000", "txn_id >= 1000"))
    auc, size = {}, {}
    for kind in (TR.Forest, RandomForestClassifier):
        model = kind(labelCol="y", weightCol="w", numTrees=30, maxDepth=30, minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=4).fit(train)
        scored = model.transform(test).withColumn("p_hat", vector_to_array("probability")[1])
        auc[kind] = M.curve(scored, "y", "p_hat").agg(M.auc_agg()).first()[0]
        size[kind] = TR.nodes_of(model, df).count()
    assert auc[TR.Forest] == pytest.approx(auc[RandomForestClassifier], abs=0.03) and auc[TR.Forest] > 0.85
    assert size[TR.Forest] == pytest.approx(size[RandomForestClassifier], rel=0.15)


def test_leaves_hold_at_least_as_many_rows_as_asked(spark):
    """Without a bootstrap's luck: all rows of a cell count, and no leaf has fewer than the least number."""
    x = np.arange(64, dtype=np.uint8)[:, None]
    count, y = np.full(64, 3), (np.arange(64) // 8 % 2 == 0) ^ (np.arange(64) % 5 == 0)
    one = type("Draw", (), {"poisson": lambda self, n: n, "random": lambda self, size: np.zeros(size)})()
    tree = TR._grown(x, y, count, np.ones(64), [list(map(float, range(63)))], 1, 30, 10, one)
    leaf = {}
    for v in range(64):
        node = 0
        while tree["left"][node] >= 0:
            node = tree["left"][node] if v <= tree["threshold"][node] else tree["right"][node]
        leaf.setdefault(node, []).append(v)
    assert len(leaf) > 1 and all(3 * len(v) >= 10 for v in leaf.values())
    assert all(tree["p"][k] == pytest.approx(np.mean([y[i] for i in v])) for k, v in leaf.items())


def test_more_cells_than_a_task_takes_go_to_sparks_forest(rows, monkeypatch):
    monkeypatch.setattr(TR, "MOST_CELLS", 10)
    monkeypatch.setattr(TR, "BATCH", 3)
    nodes = TR.grow(MD.assemble(rows, ["a", "b"]), estimator, 7)
    assert [r["tree"] for r in nodes.select("tree").distinct().sort("tree").collect()] == list(range(7))
    assert all(0 <= r["p_hat"] <= 1 for r in rows.withColumn("p_hat", TR.probability(nodes, ["a", "b"])).collect())


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_packs_of_trees_score_as_the_projection(rows, spark, monkeypatch, most):
    """The rows meet the trees (Spark's own, of other node numbers, too) in blocks of cells; repeated rows and missing values keep their scores."""
    monkeypatch.setattr(TR, "MOST_CELLS", most)
    model = MD.fit(rows, ["a", "b"], "rf", n_trees=9)
    odd = rows.unionByName(rows.filter("txn_id < 20")).withColumn("a", F.when(F.col("txn_id") % 50 > 0, F.col("a")))
    want = sorted(map(tuple, model.score(odd).collect()), key=str)
    for name, value in (("NEAR_NODES", 0), ("PACK_NODES", 100), ("BLOCK_CELLS", 30)):
        monkeypatch.setattr(TR, name, value)
    model = MD.Fitted("rf", ["a", "b"], model.model, "txn_id")
    got = sorted(map(tuple, model.score(odd).collect()), key=str)
    assert model._packed[0] and len(got) == 520 and [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], abs=1e-12)


def test_forests_refuse_labels_other_than_two(spark):
    for bad in (2, None):
        df = MD.assemble(spark.createDataFrame([(0, 0.5), (1, 0.7), (bad, 0.9)], "y int, a double"), ["a"])
        with pytest.raises(ValueError, match="labels other than 0 and 1"):
            estimator(2, 0).fit(df)
    for bad in (None, float("nan"), float("-inf")):  # Spark's own refuse them too
        df = MD.assemble(spark.createDataFrame([(0, 0.5), (1, 0.7), (1, bad)], "y int, a double"), ["a"])
        for one in (estimator(2, 0), MD.build("gbt", n_trees=2)):
            with pytest.raises(Exception, match="NaN or [iI]nfinit"):
                one.fit(df)


def test_rounds_of_party_forests_score_by_packs(rows, spark, monkeypatch):
    """The last united forest of two rounds, taken from its ledger, scores alike by projection and by packs of trees."""
    from ledgerlens.operators import federated as FD
    from ledgerlens.session import scratch_path
    base = scratch_path(spark, "rounds")
    model = FD.run_rounds(rows, ["a", "b"], "rf", 2, base, n_trees=4, diversify=True)
    assert model.model.select("tree").distinct().count() == 12
    want = by_id(model.score(rows))
    monkeypatch.setattr(TR, "NEAR_NODES", 0)
    again, _ = MD.load(spark, FD.latest_global(spark, base)[1])
    assert by_id(again.score(rows)) == pytest.approx(want, abs=1e-12) and again._packed[0]


def test_shallow_forests_of_either_stored_form(rows, spark):
    """A blend's forest is a node table; one that was stored as Spark's own is read as one."""
    from pyspark.ml.classification import RandomForestClassifier
    from ledgerlens.session import scratch_path
    path = scratch_path(spark, "shallow")
    model = MD.fit(rows, ["a", "b"], "rf_shallow", n_trees=3)
    assert model.model.agg(F.max("tree")).first()[0] == 2
    model.save(spark, path)
    assert by_id(MD.load(spark, path)[0].score(rows)) == by_id(model.score(rows))
    train, path = MD.assemble(rows, ["a", "b"]), scratch_path(spark, "shallow")
    old = RandomForestClassifier(labelCol="y", numTrees=3, maxDepth=8, seed=1).fit(train)
    old.write().save(f"{path}/model")
    spark.createDataFrame([("rf_shallow", ["a", "b"], "txn_id", None, [])], MD.META_SCHEMA).write.parquet(f"{path}/meta")
    want = by_id(old.transform(train).withColumn("p_hat", vector_to_array("probability")[1]))
    assert by_id(MD.load(spark, path)[0].score(rows)) == pytest.approx(want, abs=1e-12)
