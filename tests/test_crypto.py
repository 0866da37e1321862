import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import crypto as C

KEY = bytes(range(32))
SALT = b"\x01\x02salt"
IDS = ["a", "A ", "é", "", "  MiXeD-Case_1 "]


def _py(key, salt, s):
    return hmac.new(key, salt + s.encode("utf-8"), hashlib.sha256).hexdigest()


def test_hmac_matches_python(spark):
    df = spark.createDataFrame([(i,) for i in IDS], "id string")
    got = {r["id"]: r["t"] for r in df.select("id", C.hmac_token("id", KEY, SALT, None).alias("t")).collect()}
    assert got == {i: _py(KEY, SALT, i) for i in IDS}


def test_hmac_long_key_and_no_salt(spark):
    key = bytes(range(100))  # longer than the block: hashed first
    df = spark.createDataFrame([(i,) for i in IDS], "id string")
    got = {r["id"]: r["t"] for r in df.select("id", C.hmac_token("id", key, b"", None).alias("t")).collect()}
    assert got == {i: _py(key, b"", i) for i in IDS}


@pytest.mark.parametrize("mode,expect", [
    ("none", ["a", "A", "é", "", "MiXeD-Case_1"]),
    ("strip", ["a", "A", "é", "", "MiXeD-Case_1"]),
    ("lower", ["a", "a", "é", "", "mixed-case_1"]),
    ("upper", ["A", "A", "É", "", "MIXED-CASE_1"]),
    ("alnum_lower", ["a", "a", "", "", "mixedcase1"]),
])
def test_canonize(spark, mode, expect):
    df = spark.createDataFrame([(k, i) for k, i in enumerate(IDS)], "k int, id string")
    got = [r["c"] for r in df.orderBy("k").select(C.canonize("id", mode).alias("c")).collect()]
    assert got == expect


def test_canonize_null_is_empty(spark):
    df = spark.createDataFrame([(None,)], "id string")
    assert df.select(C.canonize("id", "lower")).first()[0] == ""


def test_canonical_tokens_match_across_variants(spark):
    df = spark.createDataFrame([("C12",), ("c12",), ("\tC12 ",)], "id string")
    toks = {r[0] for r in df.select(C.hmac_token("id", KEY, SALT, "lower")).collect()}
    assert toks == {_py(KEY, SALT, "c12")}


def test_pair_salt(spark):
    salt = bytes(range(16))
    df = spark.createDataFrame([("b", "a")], "x string, y string")
    got = df.select(C.pair_salt(salt, F.col("x"), F.col("y"))).first()[0]
    assert got == hashlib.sha256(salt + b"|a|b").hexdigest()


def test_pandas_udf_form_matches(spark):
    df = spark.createDataFrame([(i,) for i in IDS], "id string")
    udf = C.hmac_hex_udf(KEY, SALT)
    got = {r["id"]: r["t"] for r in df.select("id", udf("id").alias("t")).collect()}
    assert got == {i: _py(KEY, SALT, i) for i in IDS}
