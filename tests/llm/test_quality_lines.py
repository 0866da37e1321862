import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ledgerlens.llm import line_spread, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, source string, `t` string, w int, kept string, `row` string"


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    again = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))


def texts():
    rng = random.Random(3)
    some = [None, "", " ", "\n\n\t", "a", "a b", "a b c", "a b c a b c", "x\x0by\x0cz\r\n", "é ü # ** |", "same\nsame\n \nsame"]
    some += [" ".join(rng.choice("ab") for _ in range(rng.randrange(1, 400))) for _ in range(40)]
    some += [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(40, 900))) + rng.choice(["", "\nline\nline", " %%%"]) for _ in range(40)]
    some += [" ".join(f"w{rng.randrange(90)}" for _ in range(20000)), "long " * 30000]
    return some


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, "y", "z") for i, t, s in rows], DOC)


def test_measures_match_plain_python(spark):
    rows = [(i, t, "s") for i, t in enumerate(texts())] + [(None, "a b c d", None), (1, "", "s")]
    got = quality.quality_report(docs(spark, rows)).select("row.doc_id", "row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept").collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[2:7] == measures(r["text"]), r["doc_id"]


def test_cascade_equals_all_rules(spark):
    df = docs(spark, [(i, t, "s") for i, t in enumerate(texts())])
    want = {r["doc_id"] for r in quality.quality_report(df).filter("kept").select("row.doc_id").collect()}
    kept = quality.quality_filter(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == want and want


def test_order_is_by_rejection_per_cost_and_does_not_matter(spark):
    df = docs(spark, [(i, t, "s") for i, t in enumerate(texts())])
    rated = quality.plan_rules(df)
    worth = [share / max(seconds, 1e-6) for _, seconds, share in rated]
    assert worth == sorted(worth, reverse=True)
    back = quality.cascade(df, [r for r, _, _ in rated][::-1]).filter("kept").count()
    assert back == quality.quality_filter(df).count()


def test_no_python_in_native_plans(spark, capsys):
    df = docs(spark, [(1, "a b", "s")])
    for x in (quality.quality_report(df), quality.quality_filter(df), line_spread.remove_boilerplate(df)):
        x.explain()
    shown = capsys.readouterr().out
    assert "Scan" in shown and not re.search("Python|Pandas|MapInArrow", shown)


def test_empty_tables(spark):
    df = docs(spark, [])
    assert quality.quality_report(df).count() == 0 and quality.quality_filter(df).count() == 0
    assert line_spread.remove_boilerplate(df).count() == 0


def spread(rows, min_sites):
    sites = defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if x.strip(" \t\n\x0b\x0c\r") and s is not None and t is not None:
                sites[x.strip(" \t\n\x0b\x0c\r")].add(s)
    bad = {x for x, s in sites.items() if len(s) >= min_sites}
    return {None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r") not in bad) for _, t, _ in rows}, bad


def test_lines_match_plain_python(spark):
    rng = random.Random(5)
    common = [f"common line {k}" for k in range(30)]
    rows = [(i, "\n".join(rng.choice([rng.choice(common), f"own {i}", "", " \t", f" {rng.choice(common)} "]) for _ in range(rng.randrange(0, 9))), f"site{min(rng.randrange(40), rng.randrange(40))}")
            for i in range(300)]
    rows += [(400 + s, f"on {k} sites", f"site{s}") for k in (9, 10, 11) for s in range(k)]
    rows += [(500, None, "site1"), (None, "common line 1\nkeep", None), (501, "", None), (1, "common line 2", "site2")]
    got = line_spread.remove_boilerplate(docs(spark, rows)).select("row.text", "kept_text", "n_removed").collect()
    want, bad = spread(rows, line_spread.MIN_SITES)
    assert len(got) == len(rows) and {r["kept_text"] for r in got} == want
    assert "on 9 sites" not in bad and {"on 10 sites", "on 11 sites"} <= bad
    assert sum(r["n_removed"] for r in got) == sum(x.strip() in bad for _, t, _ in rows if t is not None for x in t.split("\n"))


def test_far_from_the_threshold_sketches_decide(spark):
    lines = spark.range(60000).select((F.col("id") % 2).alias("h"), F.concat(F.lit("s"), (F.col("id") / 2).cast("int") % F.when(F.col("id") % 2 == 0, 500).otherwise(12)).alias("site"))
    got = {r["h"]: (r["sites"], r["exact"]) for r in line_spread.site_spread(lines.withColumn("id", F.lit(1))).collect()}
    assert got[1] == (12, False) or got[1] == (12, True)
    assert 450 < got[0][0] < 550 and got[0][1] is False
