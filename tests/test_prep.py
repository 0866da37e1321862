import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import prep, ranking as RK


def steps(spark, vals):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "id long, step double")


def test_quantile_fixture(spark):
    c = prep.step_cutoffs(steps(spark, list(range(1, 11))), "step", 0.2, 0.2)
    assert (c.train_end, c.cal_end) == pytest.approx((6.4, 8.2))


def test_embargo_fixture(spark):
    df = steps(spark, list(range(1, 11)))
    c = prep.step_cutoffs(df, "step", 0.2, 0.2)
    got = {r["step"]: r["split"] for r in prep.assign_split(df, "step", c, embargo=1).collect()}
    assert got == {1: "train", 2: "train", 3: "train", 4: "train", 5: "train", 6: "train",
                   8: "cal", 10: "test"}


def test_quantiles_match_numpy(spark, many_ranges):
    rng = np.random.default_rng(0)
    vals = rng.normal(size=3000).round(3).tolist()
    df = steps(spark, vals)
    probs = [0.1, 0.5, 0.65, 0.8, 1.0]
    exp = np.quantile(np.array(vals), probs)
    assert RK.exact_quantiles(df, "step", probs) == pytest.approx(exp)


def test_bad_fractions_rejected(spark):
    with pytest.raises(ValueError):
        prep.step_cutoffs(steps(spark, [1, 2]), "step", 0.6, 0.5)


def test_assert_numeric(spark):
    df = spark.createDataFrame([("1",), ("x",), ("3",)], "step string")
    with pytest.raises(ValueError, match="1 rows"):
        prep.assert_numeric(df, "step")


def test_constant_column_scaled_zero(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (3.0,)], "x double")
    p = prep.fit_scale(df, ["x"])
    assert p.std["x"] == 1.0
    assert {r[0] for r in prep.apply_scale(df, p, []).collect()} == {0.0}


def test_scale_matches_numpy_population_std(spark):
    vals = [1.0, 2.0, 4.0, 8.0]
    p = prep.fit_scale(spark.createDataFrame([(v,) for v in vals], "x double"), ["x"])
    assert p.mean["x"] == pytest.approx(np.mean(vals)) and p.std["x"] == pytest.approx(np.std(vals))


def test_zero_fill_form(spark):
    df = spark.createDataFrame([(None,), (2.0,)], "x double")
    p = prep.fit_scale(df, ["x"], zero_fill=True, std_floor=1e-12)
    assert p.mean["x"] == pytest.approx(1.0) and p.std["x"] == pytest.approx(1.0)
    one = prep.fit_scale(spark.createDataFrame([(5.0,)], "x double"), ["x"], zero_fill=True)
    assert one.std["x"] == 1.0


def test_unseen_and_null_category(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    test = spark.createDataFrame([("c",), (None,), ("a",)], "c string")
    vocab = prep.fit_vocab(train, ["c"])
    assert vocab == {"c": ["a", "b"]}
    rows = prep.apply_onehot(test, vocab, ["c"]).collect()
    got = {r["c"]: (r["c__a"], r["c__b"]) for r in rows}
    assert got == {"c": (0, 0), None: (0, 0), "a": (1, 0)}


def test_vocab_size_guard(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        prep.fit_vocab(df, ["c"], max_levels=10)


def test_coercion(spark):
    df = spark.createDataFrame([("1.5", "1"), ("x", "bad"), (None, None), ("2", "1.9")], "a string, y string")
    out = prep.coerce_label(prep.coerce_numeric(df, ["a"]), "y").collect()
    assert [r["a"] for r in out] == [1.5, None, None, 2.0]
    assert [r["y"] for r in out] == [1, 0, 0, 1]


def test_required_columns_and_label_case(spark):
    df = spark.createDataFrame([(1, 0)], "step int, ISFRAUD int")
    out = prep.require_columns(df, ["step"], "isFraud")
    assert "isFraud" in out.columns
    with pytest.raises(ValueError):
        prep.require_columns(df, ["step", "amount"], "isFraud")


def test_preprocess_job(spark):
    from conftest import SF_SMALL
    from ledgerlens.sources import tables as T
    t = T.txn(spark, SF_SMALL)
    out, schema = prep.preprocess(t, id_col="txn_id", label="isFraud", step_col="step", calib_frac=0.15,
                                  test_frac=0.2, embargo=5, id_columns=["nameOrig", "nameDest"])
    assert schema["categorical"] == ["type"] and "nameOrig" not in schema["numeric"]
    assert set(r[0] for r in out.select("split").distinct().collect()) == {"train", "cal", "test"}
    tr = out.filter("split = 'train'")
    assert abs(tr.agg(F.avg("amount")).first()[0]) < 1e-9  # scaled on train
    ext = t.limit(7)
    out2, _ = prep.preprocess(t, id_col="txn_id", label="isFraud", step_col="step", calib_frac=0.15,
                              test_frac=0.2, embargo=5, id_columns=["nameOrig", "nameDest"], external_test=ext)
    assert out2.filter("split = 'test'").count() == 7


def test_missing_values_are_missing_in_fit_and_projection(spark):
    df = spark.createDataFrame([("1",), ("3",), ("NaN",), ("abc",), (None,)], "x string")
    p = prep.fit_scale(df, ["x"])
    assert (p.mean["x"], p.std["x"]) == (2.0, 1.0)
    assert [r[0] for r in df.select(*prep.scale_exprs(p)).collect()] == [-1.0, 1.0, None, None, None]
    z = prep.fit_scale(df, ["x"], zero_fill=True)
    low = (0 - z.mean["x"]) / z.std["x"]
    assert [r[0] for r in df.select(*prep.scale_exprs(z, zero_fill=True)).collect()][2:] == [low] * 3
