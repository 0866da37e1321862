import hashlib
import hmac

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import secagg as S


def ref_prg(key: bytes, salt: bytes, dim: int) -> np.ndarray:
    """Independent NumPy statement of the keyed PRG (little-endian uint64 words)."""
    out = []
    c = 0
    while len(out) < dim:
        block = hmac.new(key, salt + c.to_bytes(8, "big"), hashlib.sha256).digest()
        u = np.frombuffer(block, dtype="<u8", count=4)
        out.extend((u.astype(np.float64) / 2.0 ** 64 - 0.5).tolist())
        c += 1
    return np.array(out[:dim])


def pairs_frame(spark, clients, session="s"):
    r = spark.createDataFrame([(session, c) for c in clients], "session string, client_id string")
    p = S.pair_salts(S.pairs(r))
    return p.withColumn("key_hex", F.sha2(F.concat_ws("|", "a", "b"), 256))


def test_prg_bit_exact(spark):
    p = pairs_frame(spark, ["c1", "c2"]).collect()[0]
    key, salt = bytes.fromhex(p["key_hex"]), bytes.fromhex(p["pair_salt"])
    df = spark.createDataFrame([(p["key_hex"], p["pair_salt"])], "key_hex string, pair_salt string")
    got = sorted((r["pos"], r["m"]) for r in S.prg(df, "key_hex", "pair_salt", 7).collect())
    assert [m for _, m in got] == ref_prg(key, salt, 7).tolist()


def test_masks_cancel_three_clients(spark):
    m = S.client_masks(pairs_frame(spark, ["c1", "c2", "c3"]), 7)
    total = m.groupBy("pos").agg(F.sum("mask").alias("t")).collect()
    assert len(total) == 7 and all(abs(r["t"]) < 1e-12 for r in total)
    norms = S.mask_norms(m).collect()
    assert len(norms) == 3 and all(r["l2"] > 0 for r in norms)


def test_fixed_point_masks_cancel_exactly(spark):
    m = S.client_masks(pairs_frame(spark, ["a", "b", "c", "d"]), 9, scale=1000.0)
    assert {r["t"] for r in m.groupBy("pos").agg(F.sum("mask").alias("t")).collect()} == {0.0}


def test_masked_sum_equals_plain_sum(spark):
    clients = ["c1", "c2", "c3"]
    upd = spark.createDataFrame([("s", c, j, float(i * 10 + j)) for i, c in enumerate(clients) for j in range(5)],
                                "session string, client_id string, pos int, value double")
    masked = S.apply_masks(upd, S.client_masks(pairs_frame(spark, clients), 5))
    got = {r["pos"]: r["total"] for r in S.server_sum(masked).collect()}
    assert got == pytest.approx({j: float(sum(i * 10 + j for i in range(3))) for j in range(5)})


def test_dimension_mismatch_fails(spark):
    upd = spark.createDataFrame([("s", "c1", 0, 1.0)], "session string, client_id string, pos int, value double")
    masked = S.apply_masks(upd, S.client_masks(pairs_frame(spark, ["c1", "c2"]), 3))
    with pytest.raises(Exception):
        masked.collect()


def test_pairs_and_missing_peers(spark):
    r = spark.createDataFrame([("s", c) for c in ["a", "b", "c"]], "session string, client_id string")
    assert sorted((x["a"], x["b"]) for x in S.pairs(r).collect()) == [("a", "b"), ("a", "c"), ("b", "c")]
    provided = S.directed(S.pairs(r.filter("client_id != 'c'")))
    miss = S.missing_peers(S.directed(S.pairs(r)), provided).collect()
    assert sorted((m["client_id"], m["peer"]) for m in miss) == [("a", "c"), ("b", "c"), ("c", "a"), ("c", "b")]


def test_pairs_of_many_sessions_and_null_clients(spark):
    rows = [(i, f"p{k}") for i in range(40) for k in range(i % 5)] + [(1, None), (None, "p1"), (3, "p0")]
    got = S.pairs(spark.createDataFrame(rows, "session int, client_id string"))
    want = [(i, f"p{a}", f"p{b}") for i in range(40) for a in range(i % 5) for b in range(a + 1, i % 5)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def _prime(start: int) -> int:
    """Deterministic Miller-Rabin search (test keys only)."""
    def is_prime(n):
        if n < 2:
            return False
        for p in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
            if n % p == 0:
                return n == p
        d, s = n - 1, 0
        while d % 2 == 0:
            d, s = d // 2, s + 1
        for a in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
            x = pow(a, d, n)
            if x in (1, n - 1):
                continue
            for _ in range(s - 1):
                x = x * x % n
                if x == n - 1:
                    break
            else:
                return False
        return True
    n = start | 1
    while not is_prime(n):
        n += 2
    return n


def test_paillier_encrypted_sum(spark):
    from ledgerlens.operators import paillier as PL
    sk = PL.PrivateKey.from_primes(_prime(2 ** 127 + 12345), _prime(2 ** 127 + 99991))
    assert sk.decrypt(PL.encrypt(sk.public, 1) * PL.encrypt(sk.public, 2) * PL.encrypt(sk.public, 3)
                      % sk.public.n2) == 6
    df = spark.createDataFrame([(i % 3, i) for i in range(100)], "g int, v long").repartition(4)
    got = {r[0]: (r[1], r[2]) for r in PL.decrypt_frame(PL.encrypted_sums(df, "v", sk.public, ["g"]), sk)}
    assert got == {g: (sum(i for i in range(100) if i % 3 == g), len([i for i in range(100) if i % 3 == g]))
                   for g in range(3)}
    total = PL.decrypt_frame(PL.encrypted_sums(df, "v", sk.public), sk)
    assert total == [(4950, 100)]
    assert sk.decrypt(PL.total_cipher(PL.encrypted_sums(df, "v", sk.public, ["g"]), sk.public)) == 4950
    with pytest.raises(Exception):
        PL.encrypted_sums(df.select((-F.col("v")).alias("v")), "v", sk.public).collect()
