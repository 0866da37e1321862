import base64
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators import report as RP
from ledgerlens.session import scratch_path
from ledgerlens.sources import io
from ledgerlens.streaming import streams as S

from conftest import SF_SMALL


def test_stream_stats_equal_batch(spark):
    st = S.running_stats(S.source(spark, SF_SMALL, "events.parquet"), ["event_type"],
                         [F.count(F.lit(1)).alias("n")])
    batch = spark.read.parquet(f"{SF_SMALL}/events.parquet").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(st.collect()) == sorted(batch.collect())


def _shuffled_events(spark, path, files=5):
    """The events in several files, each with rows of all days."""
    e = spark.read.parquet(f"{SF_SMALL}/events.parquet").repartition(files, F.xxhash64("event_id"))
    e.write.parquet(f"{path}/events.parquet")
    return e


def test_stream_sessions_whatever_the_order(spark, tmp_path):
    _shuffled_events(spark, tmp_path)
    gap = {"n": F.lit(1), "total": F.col("value")}
    got = S.sessions(S.source(spark, str(tmp_path), "events.parquet", max_files=1), "ts", ["user_id"], gap, "2 hours")
    want = spark.read.parquet(f"{SF_SMALL}/events.parquet").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "2 hours").alias("w")).agg(
        F.count(F.lit(1)).alias("n"))
    want = sorted((r["user_id"], r["s"], r["e"], r["n"]) for r in want.select("user_id", F.col("w.start").cast("string").alias("s"), F.col("w.end").cast("string").alias("e"), "n").collect())
    assert sorted((r["user_id"], r["s"], r["e"], r["n"]) for r in got.select(
        "user_id", F.col("session_start").cast("string").alias("s"), F.col("session_end").cast("string").alias("e"), "n").collect()) == want


def test_late_rows_raise_and_a_long_watermark_loses_none(spark, tmp_path):
    e = _shuffled_events(spark, tmp_path)
    n = [F.count(F.lit(1)).alias("n")]
    src = lambda: S.source(spark, str(tmp_path), "events.parquet", max_files=1)
    with pytest.raises(S.LateRows):
        S.windows(src(), "ts", ["event_type"], n, "1 day", watermark="1 hour")
    base = str(tmp_path / "base")
    for _ in range(2):  # the run that lost rows, and one that resumes after it
        with pytest.raises(S.LateRows):
            S.windows(src(), "ts", ["event_type"], n, "1 day", watermark="1 hour", base=base)
    delay = S.span(spark, str(tmp_path), "events.parquet", "ts")
    got = S.windows(src(), "ts", ["event_type"], n, "1 day", watermark=delay)
    want = e.groupBy(F.date_trunc("day", "ts").alias("d"), "event_type").count()
    assert sorted((str(r["window_start"]), r["event_type"], r["n"]) for r in got.collect()) == sorted((str(r[0]), r[1], r[2]) for r in want.collect())
    rounds = src().withColumn("round", F.to_date("ts").cast("string")).withColumn("client", F.col("user_id") % 2)
    done = S.round_barrier(rounds, "round", "client", 2, "ts", delay)
    full = e.groupBy(F.to_date("ts").cast("string").alias("round")).agg(F.count_distinct(F.col("user_id") % 2).alias("n_clients"))
    assert sorted(done.collect()) == sorted(full.filter("n_clients >= 2").collect())


def test_a_stable_base_resumes(spark, tmp_path):
    e = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    first, base = f"{tmp_path}/in/events.parquet", f"{tmp_path}/base"
    src = lambda: S.source(spark, f"{tmp_path}/in", "events.parquet", schema=e.schema)
    e.filter("event_id % 2 = 0").write.parquet(first)
    args = ("ts", ["event_type"], [F.count(F.lit(1)).alias("n")], "1 day")
    assert S.windows(src(), *args, watermark="9999 hours", base=base).agg(F.sum("n")).first()[0] == e.filter("event_id % 2 = 0").count()
    e.filter("event_id % 2 = 1").write.mode("append").parquet(first)
    assert S.windows(src(), *args, watermark="9999 hours", base=base).agg(F.sum("n")).first()[0] == e.count()
    rows = S.run_append(src().select("event_id"), "rows", base=f"{base}-rows")
    assert rows.count() == e.count() == S.run_append(src().select("event_id"), "rows", base=f"{base}-rows").count()


def test_detect_format():
    assert io.detect_format("a/b.PQ") == "parquet" and io.detect_format("x.txt") == "csv"
    with pytest.raises(ValueError):
        io.detect_format("x.json")


def test_token_sources_and_sinks(spark):
    base = scratch_path(spark, "tok")
    os.makedirs(base)
    with open(f"{base}/t.txt", "w") as f:
        f.write(" abc \n\n def\n")
    assert [r[0] for r in io.read_tokens(spark, f"{base}/t.txt").collect()] == ["abc", "def"]
    df = spark.createDataFrame([("b",), ("a",)], "token string")
    io.write_tokens(df, f"{base}/out")
    assert sorted(r[0] for r in io.read_tokens(spark, f"{base}/out/tokens.parquet").collect()) == ["a", "b"]


def test_key_documents_and_ordered_tokens(spark, tmp_path):
    with open(f"{tmp_path}/key.json", "w") as f:  # as its owner wrote it, indented
        json.dump({"k": base64.b64encode(bytes(range(32))).decode(), "salt": base64.b64encode(b"salty").decode()}, f, indent=2)
    assert io.read_key_document(spark, f"{tmp_path}/key.json") == (bytes(range(32)), b"salty")
    io.write_key_document(spark, b"k" * 32, b"", f"{tmp_path}/own.json")
    assert io.read_key_document(spark, f"{tmp_path}/own.json") == (b"k" * 32, b"")
    with open(f"{tmp_path}/none.json", "w") as f:
        f.write("{}")
    with pytest.raises(ValueError, match="key document"):
        io.read_key_document(spark, f"{tmp_path}/none.json")
    rows = spark.createDataFrame([(f"t{i * 7 % 40}", i) for i in range(40)] + [("t0", 40)], "token string, row_idx long").repartition(5)
    io.write_tokens(rows, f"{tmp_path}/out", "row_idx")
    assert sorted((r["row_idx"], r["token"]) for r in io.read_placed_tokens(spark, f"{tmp_path}/out").collect()) == sorted((r["row_idx"], r["token"]) for r in rows.collect())
    lines = [x for p in sorted((tmp_path / "out/tokens.txt").glob("part-*")) for x in p.read_text().split()]
    assert lines == [f"t{i * 7 % 40}" for i in range(40)] + ["t0"]


def test_bad_records_are_kept_apart(spark, tmp_path):
    schema = "id long, x double, s string"
    want = T._parse_datatype_string(schema)
    (tmp_path / "a.csv").write_text("id,x,s\n1,0.5,a\n2,oops,b\n3\n4,,\n5,1.5,c,more\n")
    good, bad = io.read_checked(spark, str(tmp_path / "a.csv"), want)
    assert good.columns == ["id", "x", "s"]
    assert sorted(tuple(r) for r in good.collect()) == [(1, 0.5, "a"), (4, None, None)]
    assert sorted(r["record"] for r in bad.collect()) == ["2,oops,b", "3", "5,1.5,c,more"]
    assert bad.first()["source_path"].endswith("a.csv")
    (tmp_path / "a.json").write_text('{"id":1,"x":0.5}\n{"id":2,"x":"oops"}\n{"id":3,\nnot json\n')
    good, bad = io.read_checked(spark, str(tmp_path / "a.json"), want, "json")
    assert [tuple(r) for r in good.collect()] == [(1, 0.5, None)] and bad.count() == 3
    (tmp_path / "empty.csv").write_text("id,x,s\n")
    good, bad = io.read_checked(spark, str(tmp_path / "empty.csv"), want)
    assert good.count() == 0 == bad.count()
    with pytest.raises(ValueError):
        io.read_checked(spark, "x", want, "parquet")


def test_scoreboard_takes_micro_metrics_of_client_reports(spark, tmp_path):
    flat = {"model": "lr", "AUPRC": .3, "ROC_AUC": .6, "F1": .4, "precision": .5, "recall": .3, "threshold_used": .2, "threshold_source": "cal"}
    report = {"family": "lr", "per_client": [{"client": "a", "AUPRC": .9}], "micro": {"AUPRC": .5, "F1": .7, "threshold_used": .1}, "F1": .99}
    half = {"AUPRC": .1, "micro": {"AUPRC": .8}}  # no clients: its own metrics count
    for name, doc in {"a": flat, "b": report, "c": half}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "metrics.json").write_text(json.dumps(doc, indent=1))
    got = [r.asDict() for r in RP.scoreboard(RP.load_metrics(spark, str(tmp_path))).collect()]
    assert [r.pop("path").split("/")[-2] for r in got] == ["b", "a", "c"]
    none = dict.fromkeys(["roc_auc", "precision", "recall", "f1", "threshold", "notes"])
    assert got == [none | {"source": "fl_clients", "family": "lr", "auprc": .5, "f1": .7, "threshold": .1, "notes": "micro aggregation of clients"},
                   {"source": "single", "family": "lr", "auprc": .3, "roc_auc": .6, "f1": .4, "precision": .5, "recall": .3, "threshold": .2, "notes": "cal"},
                   none | {"source": "single", "family": "unknown", "auprc": .1}]


def test_report_jobs(spark):
    root = scratch_path(spark, "run")
    for rel, obj in [("a/metrics.json", {"model": "lr", "AUPRC": 0.3, "threshold_used": 0.4}),
                     ("b/metrics.json", {"family": "lr", "AUPRC": 0.5, "threshold": 0.2}),
                     ("psi/hmac_key.json", {"k": "x"}), ("psi/p1/tokens.txt", {})]:
        os.makedirs(os.path.dirname(f"{root}/{rel}"), exist_ok=True)
        with open(f"{root}/{rel}", "w") as f:
            json.dump(obj, f)
    sb = RP.scoreboard(RP.load_metrics(spark, root, "metrics.json")).collect()
    assert [(r["family"], r["auprc"], r["threshold"]) for r in sb] == [("lr", 0.5, 0.2), ("lr", 0.3, 0.4)]
    listed = sorted(os.path.relpath(r["path"].replace("file:", ""), root) for r in RP.secret_listing(spark, root).collect())
    assert listed == ["psi/hmac_key.json", "psi/p1/tokens.txt"]
    man = RP.checksum_manifest(spark, root).collect()
    assert len(man) == 4 and all(len(r["sha256"]) == 64 for r in man)


def test_sanitize_nested(spark):
    df = spark.createDataFrame([({"key": "s", "ok": 1}, "x")], "cfg struct<key:string, ok:int>, secret string")
    out = RP.sanitize(df, ["cfg.key", "secret"])
    assert out.columns == ["cfg"] and out.schema["cfg"].dataType.fieldNames() == ["ok"]


def test_stream_windows_independent_of_session_zone(spark):
    from ledgerlens.plans import QUERIES
    utc = sorted(QUERIES["stream_windows"](spark, SF_SMALL).collect())
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        ny = sorted(QUERIES["stream_windows"](spark, SF_SMALL).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert ny == utc


def test_bundle_roundtrip_and_matrix(spark):
    df = spark.createDataFrame([(i, float(i), float(-i), i % 2, "train" if i < 6 else "test") for i in range(8)],
                               "txn_id long, a double, b double, y int, split string")
    path = scratch_path(spark, "bundle")
    io.write_bundle(df, path, {"target": "y", "id_column": "txn_id", "numeric": ["a", "b"]})
    tr, feats, params = io.read_bundle(spark, path, "train", "txn_id", "y")
    assert tr.count() == 6 and sorted(feats) == ["a", "b"] and params["target"] == "y"
    m = io.matrix_bundle(tr, ["a", "b"], "txn_id", "y").orderBy("row").collect()
    assert [r["row"] for r in m] == list(range(6)) and m[2]["x"] == [2.0, -2.0]


def test_party_from_path_and_policy(spark):
    from ledgerlens.operators import prep
    base = scratch_path(spark, "parties")
    for p in ("bank_a", "bank_b"):
        spark.createDataFrame([(p,)], "v string").write.parquet(f"{base}/{p}")
    got = spark.read.parquet(f"{base}/bank_a", f"{base}/bank_b").select("v", io.party_from_path().alias("party"))
    assert sorted(tuple(r) for r in got.collect()) == [("bank_a", "bank_a"), ("bank_b", "bank_b")]
    df = spark.createDataFrame([(1, 2.0, 3.0, "x", 0)], "id int, a double, b double, c string, y int")
    out = prep.apply_feature_policy(df, keep=["id", "y"], exclude=["b"])
    assert out.columns == ["id", "a", "c", "y"]
    assert prep.feature_columns(df, "id", "y") == ["a", "b", "c"]


def test_stream_over_a_table_folder(spark, tmp_path):
    from ledgerlens.streaming import streams
    spark.range(100).repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    src = streams.source(spark, str(tmp_path), "events.parquet", max_files=1)
    assert streams.run_append(src, "folder").count() == 100


def test_indented_metrics_document(spark, tmp_path):
    import json

    from ledgerlens.operators import report
    (tmp_path / "metrics.json").write_text(json.dumps({"family": "lr", "AUPRC": 0.5}, indent=2))
    assert [r["family"] for r in report.load_metrics(spark, str(tmp_path)).collect()] == ["lr"]
