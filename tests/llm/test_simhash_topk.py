import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import components, simhash, topk


def slow_fingerprint(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def classes(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for u, v in links:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprint(spark):
    rng = random.Random(1)
    for t in [None, "", " \n", "One", "ONE two", "É é A a", "a b c d a b c d"] + [" ".join(rng.choices("Ab cd EF gh".split(), k=rng.randrange(200))) for _ in range(50)]:
        assert simhash.fingerprint(t) == signed(slow_fingerprint(t))
    spark_hash = spark.sql("select xxhash64('one two three') h").first()["h"]
    assert signed(xxhash.xxh64_intdigest(b"one two three", 42)) == spark_hash


@pytest.mark.parametrize("tile", [4, 2048])
def test_links_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1, 7, 1 << 63]
    fps = set(base)
    for b in base * 4:
        for k in (1, 2, 3, 4, 5):
            x = b
            for bit in rng.sample(range(64), k):
                x ^= 1 << bit
            fps.add(x)
    want = classes([(signed(a), signed(b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3], [signed(x) for x in fps])
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = simhash.links(df).collect()
    assert all(((r["u"] ^ r["v"]) & ((1 << 64) - 1)).bit_count() for r in got)
    assert classes([(r["u"], r["v"]) for r in got], [signed(x) for x in fps]) == want
    root = {r["node"]: r["root"] for r in components.components(simhash.links(df)).collect()}
    assert {n: root.get(n, n) for n in want} == want


def test_tile_forest_is_small():
    a = np.arange(8, dtype=np.uint64).repeat(1)
    dense = np.array([x for x in range(512) if x.bit_count() <= 3], np.uint64)
    u, v = simhash.tile_links(dense, dense, True, 3)
    assert len(u) < len(dense) and len(set(classes(zip(u.tolist(), v.tolist()), dense.tolist()).values())) == 1
    assert len(simhash.tile_links(a, a, True, 3)[0]) <= 8


def test_long_chain_components(spark):
    links = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r["root"] for r in components.components(links).collect()} == {0}
    assert components.components(links.limit(0)).count() == 0


def test_near_duplicates_and_keep_one(spark):
    rng = random.Random(4)
    long = " ".join(rng.choices([f"w{i}" for i in range(500)], k=400))
    near = long.replace(long.split()[200], "changed", 1)
    rows = [(5, long), (3, near), (9, long.upper()), (7, "other text entirely"), (8, None), (2, ""), (11, "  "), (None, "other text entirely"), (None, None), (7, "other text entirely"), (12, "unique words here now")]
    df = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in rows], "doc_id long, text string, fp string, id string, component int")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = {slow_fingerprint(t) for _, t in rows}
    root = classes([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3], fps)
    low = defaultdict(lambda: None)
    for i, t in rows:
        r = root[slow_fingerprint(t)]
        if i is not None:
            low[r] = i if low[r] is None else min(low[r], i)
    want = sorted((str(i), signed(slow_fingerprint(t)), low[root[slow_fingerprint(t)]]) for i, t in rows)
    assert sorted((str(r["id"]), r["fp"], r["component"]) for r in got) == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(low.values()) - {None})
    # rows without an id, or with an id of another text, are judged by their own texts
    more = df.union(spark.createDataFrame([(i, t, "a", "b", 1) for i, t in [(None, "no id here at all"), (None, "no id here at all"), (None, "nor is there one here"), (12, "the same id and other words"), (1, "the same id and other words")]], df.schema))
    own = sorted((str(r["doc_id"]), r["text"]) for r in simhash.keep_one(more).collect())
    added = [("None", "no id here at all"), ("None", "nor is there one here"), ("1", "the same id and other words")]
    assert own == sorted([(str(r["doc_id"]), r["text"]) for r in kept.collect()] + added)
    assert simhash.keep_one(df.limit(0)).count() == 0 and simhash.near_duplicates(df.limit(0)).count() == 0


def slow_topk(rows, k=10):
    ok = [(i, np.floor(np.array(v, np.float64) * 1024).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for r, (i, q) in enumerate(ok):
        if i % 100 == 0:
            found = sorted((-int(q @ c), j) for s, (j, c) in enumerate(ok) if s != r and len(c) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [16, 4096])
def test_topk_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(5, 8)) / 3
    rows = [(i, [float(x) for x in np.float32(centre[i % 5] + rng.normal(size=8) / 12)]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(15)] + [(2000, [0.0] * 8), (2100, [1.0, 2.0]), (2101, [0.5, -1.0]), (2200, [3.0])]
    rows += [(2300, None), (2400, []), (2500, [float("nan")] * 8), (2600, [1.0, None]), (2700, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [rows[100], rows[100], rows[200], (300, rows[5][1]), (2000, [0.0] * 8)]  # repeated rows and shared ids, queries among them
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")
    got = topk.exact_topk(df, F.col("id") % 100 == 0)
    assert sorted(tuple(r) for r in got.collect()) == slow_topk(rows)
    assert topk.exact_topk(df.limit(0), F.col("id") % 100 == 0).count() == 0
    huge = spark.createDataFrame([(0, [1e9, 1.0]), (1, [1e9, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="2 \\*\\* 53"):
        topk.exact_topk(huge, F.col("id") % 100 == 0).collect()


def test_lists_are_not_read_to_their_ends():
    rng = np.random.default_rng(1)
    rows = np.floor(1024 * rng.normal(size=(4096, 4)))
    best = [(np.zeros(0), np.zeros(0, np.int64))]
    read = topk.block_topk(np.array([-1]), rows[:1] * 2, topk.Lists(np.arange(4096), rows), best, 10)
    assert read < 4096
    want = np.lexsort((np.arange(4096), -(rows @ rows[0])))[:10]
    assert best[0][1].tolist() == want.tolist()
