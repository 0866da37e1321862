import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import ranking as RK, weights as W


def labels(spark, ys):
    return spark.createDataFrame([(i, y) for i, y in enumerate(ys)], "id long, y int")


def test_balanced_and_inverse_fixture(spark):
    df = labels(spark, [0] * 8 + [1] * 2)
    bal = {r["label"]: r["weight"] for r in W.balanced_weights(df, "y").collect()}
    inv = {r["label"]: r["weight"] for r in W.inverse_weights(W.class_counts(df, "y")).collect()}
    assert bal == pytest.approx({0: 0.625, 1: 2.5})
    assert inv == pytest.approx({0: 1.25, 1: 5.0})


def test_weight_sum_rule(spark):
    df = labels(spark, [0] * 7 + [1] * 3 + [2] * 5)
    wm = W.weight_map(W.balanced_weights(df, "y"))
    tot = W.sample_weights(df, "y", wm).agg(F.sum("weight")).first()[0]
    assert tot == pytest.approx(15.0)  # Σ w·count = n


def test_null_class_kept_in_counts(spark):
    df = spark.createDataFrame([(1,), (None,), (0,), (None,)], "y int")
    cc = {r["label"]: r["n"] for r in W.class_counts(df, "y").collect()}
    assert cc == {1: 1, 0: 1, None: 2}
    bal = {r["label"]: r["weight"] for r in W.balanced_weights(df, "y").collect()}
    assert bal == pytest.approx({0: 2.0, 1: 2.0})  # n includes nulls, k does not


def test_sample_weights_default_and_none(spark):
    df = labels(spark, [0, 1, 2])
    got = {r["y"]: r["weight"] for r in W.sample_weights(df, "y", {0: 0.5, 1: 2.0}).collect()}
    assert got == {0: 0.5, 1: 2.0, 2: 1.0}
    assert {r["weight"] for r in W.sample_weights(df, "y", None).collect()} == {1.0}


def test_stratified_split_exact_counts(spark):
    df = labels(spark, [0] * 37 + [1] * 13)
    out = W.stratified_split(df, "id", "y", frac=0.2, seed=3)
    cnt = {(r["y"], r["part"]): r["count"] for r in out.groupBy("y", "part").count().collect()}
    assert cnt[(0, "val")] == 7 and cnt[(1, "val")] == 3  # round(0.2 * n)
    again = W.stratified_split(df, "id", "y", frac=0.2, seed=3)
    assert sorted(out.collect()) == sorted(again.collect())


def test_row_index_contiguous_many_ranges(spark, many_ranges):
    df = spark.range(0, 3000, 3).select(F.col("id").alias("k"))
    out = W.row_index(df, "k").collect()
    assert sorted((r["k"], r["row_idx"]) for r in out) == [(3 * i, i) for i in range(1000)]


def test_chunked_balanced_weights(spark):
    df = labels(spark, [0] * 8 + [1] * 2 + [5] * 3)
    w = {r["label"]: r["weight"] for r in W.balanced_weights_01(df, "y").collect()}
    assert w == pytest.approx({0: 10 / 16, 1: 10 / 4})
    only0 = {r["label"]: r["weight"] for r in W.balanced_weights_01(labels(spark, [0] * 4), "y").collect()}
    assert only0 == pytest.approx({0: 0.5, 1: 2.0})  # count floored at 1


def test_grouped_row_number_with_hot_group(spark, many_ranges):
    """One group holds a third of the rows; per-group ranks still match a brute force."""
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 7}", (i * 7919) % 1000) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, k long")
    ranked = RK.row_number(df, [F.col("k"), F.col("id")], group_cols=["g"], total="n")
    got = {r["id"]: r["rn"] for r in ranked.collect()}
    assert {r["g"]: r["n"] for r in ranked.select("g", "n").distinct().collect()} == {g: sum(r[1] == g for r in rows) for g in {r[1] for r in rows}}
    exp = {}
    for g in {r[1] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))):
            exp[r[0]] = n + 1
    assert got == exp


def test_prefixed_ids_and_a_hot_value_spread_over_the_ranges(spark, many_ranges):
    rows = [(f"customer_{i:09d}", 0.5 if i % 3 else float(i % 7)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id string, p double")
    for keys in (["id"], ["p", "id"]):  # ids of one prefix; a score that most rows share
        sizes = [r["count"] for r in RK.ranged(df, keys).groupBy("_part").count().collect()]
        assert len(sizes) == many_ranges and max(sizes) < 4 * 4000 / many_ranges
    got = {r["id"]: r["rn"] for r in RK.row_number(df, ["p", "id"]).collect()}
    assert got == {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
