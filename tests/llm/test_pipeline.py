import os
import re
import subprocess
import sys
from collections import Counter

import duckdb
import pytest
from conftest import SF_SMALL
from test_packing_pii import slow_base
from test_quality_lines import measures, spread
from test_simhash_topk import classes, signed, slow_fingerprint

import corpus_pipeline
from ledgerlens.llm import packing, pii
from ledgerlens.llm.common import read
from ledgerlens.llm.queries import ORACLE, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tools"))

from oracle_check import rows_of  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    res = con.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    df = QUERIES[name](spark, SF_SMALL)
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


def test_queries_have_no_limits():
    with open(os.path.join(ROOT, "ledgerlens/llm/queries.py")) as f:
        text = f.read()
    assert not re.search(r"\.limit\(|\.sample\(", text)


def plain_pipeline(rows):
    """The stages up to packing, on a dict of texts, by brute force."""
    docs = {}
    for i, t, s in rows:
        w, chars, symbols, dup, again = measures(t)
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        capitals = sum("A" <= c <= "Z" for c in t or "")
        bad = (w < 50 or 100 * again > 50 * w or 100 * symbols > 10 * w or chars < 2 * w or chars > 13 * w or 100 * dup > 50 * len(lines) or 100 * capitals > 50 * chars)
        if not bad:
            docs[i] = (t, s)
    _, bad = spread([(i, t, s) for i, (t, s) in docs.items()], 10)
    docs = {i: "\n".join(x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r") not in bad) for i, (t, s) in docs.items()}
    fp = {i: slow_fingerprint(t) for i, t in docs.items()}
    root = classes([(a, b) for a in set(fp.values()) for b in set(fp.values()) if a < b and (a ^ b).bit_count() <= 3], set(fp.values()))
    first = {}
    for i in sorted(docs):
        first.setdefault(root[fp[i]], i)
    return {i: pii.redact(docs[i], slow_base(docs[i]) + [s[:3] for s in pii.more_spans(docs[i])]) for i in first.values()}


def test_pipeline_against_brute_force(spark):
    docs = read(spark, SF_SMALL, "documents")
    want = plain_pipeline([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    encode = packing.public_encoder()
    pieces = Counter((i, *p) for i, t in want.items() for p in packing.pieces_of(encode(t), 2048))
    got = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces
    for seq in {r["sequence_id"] for r in got}:
        own = sorted((r["offset"], r["length"]) for r in got if r["sequence_id"] == seq)
        assert all(o == sum(n for _, n in own[:k]) for k, (o, _) in enumerate(own)) and sum(n for _, n in own) <= 2048


def test_stages_take_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(1, long, "en", "a", 5), (1, long, "en", "a", 5), (None, long + " x", None, None, None), (2, None, "en", "a", None), (3, "", None, "b", 0), (4, long + " more here and there", "de", None, 9)]
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, `row` string, kept double")
    for some in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, SF_SMALL)
            assert out.columns == some.columns and [t for _, t in out.dtypes] == [t for _, t in some.dtypes], name
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, some, SF_SMALL).count() == some.count()


def test_entry_from_another_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as e
print("ROWS", e.queries()["op9_license_scan"](s, {SF_SMALL!r}).count(), len([q for q in e.queries() if q.startswith("op")]))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert re.search(r"ROWS \d+ 10", done.stdout), done.stderr[-2000:]
