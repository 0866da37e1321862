import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import psi

KEY = bytes(range(32))


def tokens(spark, parties):
    rows = [(p, i, x) for p, ids in parties.items() for i, x in enumerate(ids)]
    df = spark.createDataFrame(rows, "party string, pos long, id string")
    return psi.tokenize(df, "id", KEY, b"s", "lower", keep=["party", "pos", "id"])


def test_intersection_laws(spark):
    parties = {"A": ["x", "Y", "z", "x"], "B": [" y", "X", "w"], "C": ["x", "y", "q"]}
    tok = tokens(spark, parties)
    inter = {r[0] for r in psi.intersect(tok, parties).collect()}
    assert len(inter) == 2  # x and y after canonicalisation
    for p in parties:
        mine = {r[0] for r in tok.filter(F.col("party") == p).select("token").collect()}
        assert inter <= mine
    rev = tokens(spark, dict(reversed(list(parties.items()))))
    assert {r[0] for r in psi.intersect(rev, psi.parties_of(rev)).collect()} == inter
    counts = {r["party"]: (r["n_rows"], r["n_distinct"], r["n_intersection"])
              for r in psi.party_counts(tok, psi.intersect(tok, parties)).collect()}
    assert counts["A"] == (4, 3, 2)


def test_semi_filter(spark):
    tok = tokens(spark, {"A": ["x", "y"], "B": ["X", "z"]})
    inter = psi.intersect(tok, ["A", "B"])
    rows = spark.createDataFrame([("x", 1), ("  X", 2), ("z", 3)], "id string, v int")
    kept = psi.semi_filter(rows, "id", inter, KEY, b"s", "lower")
    assert sorted(r["v"] for r in kept.collect()) == [1, 2]


def test_positional_filter_count_mismatch(spark):
    rows = spark.createDataFrame([(0,), (1,)], "row_idx long")
    toks = spark.createDataFrame([(0, "t")], "row_idx long, token string")
    with pytest.raises(ValueError):
        psi.positional_filter(rows, toks, toks.select("token"))


def test_id_hash_map_distinct(spark):
    df = spark.createDataFrame([("a", "m"), ("a", "n")], "nameOrig string, nameDest string")
    m = psi.id_hash_map(df, ["nameOrig", "nameDest"], KEY).collect()
    assert sorted((r["id"], r["column"]) for r in m) == [("a", "nameOrig"), ("m", "nameDest"), ("n", "nameDest")]


def test_null_ids_dropped_and_counted(spark):
    df = spark.createDataFrame([("A", "x"), ("A", None), ("B", "x"), ("B", None)], "party string, id string")
    tok = psi.tokenize(df, "id", KEY, b"s", "lower", keep=["party"])
    assert tok.count() == 2 and psi.intersect(tok, psi.parties_of(df)).count() == 1
    assert {r["party"]: r["null_ids"] for r in psi.null_id_counts(df, "id").collect()} == {"A": 1, "B": 1}


def test_a_party_without_ids_empties_the_intersection(spark):
    df = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", None), (None, "x")], "party string, id string")
    tok = psi.tokenize(df, "id", KEY, b"s", "lower", keep=["party"])
    assert psi.parties_of(df) == ["A", "B", "C"]
    assert psi.intersect(tok, psi.parties_of(df)).count() == 0
    assert psi.intersect(tok, ["A", "B"]).count() == 1
    assert psi.intersect(tok, []).count() == 0


def test_positional_filter_of_every_party(spark):
    rows = spark.createDataFrame([(p, i) for p in "ab" for i in (5, 3, 9)], "party string, txn_id long")
    toks = spark.createDataFrame([(p, i, f"{p}{i}" if i != 9 else "both") for p in "ab" for i in (3, 5, 9)], "party string, txn_id long, token string")
    inter = spark.createDataFrame([("both",), ("a3",)], "token string")
    at = lambda df: psi.with_row_idx(df, "txn_id", ["party"])
    got = psi.positional_filter(at(rows), at(toks).drop("txn_id"), inter, ["party"])
    assert sorted((r["party"], r["txn_id"], r["row_idx"], r["token"]) for r in got.collect()) == [("a", 3, 0, "a3"), ("a", 9, 2, "both"), ("b", 9, 2, "both")]
    # as many in all, but not in each party
    moved = toks.withColumn("party", F.when(F.col("txn_id") == 3, "a").otherwise(F.col("party")))
    with pytest.raises(ValueError, match="align"):
        psi.positional_filter(at(rows), at(moved).drop("txn_id"), inter, ["party"])
