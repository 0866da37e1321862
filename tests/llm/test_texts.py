import random
import time

import numpy as np
import pytest

from ledgerlens.llm import html_text, licenses, passages, sentencepieces


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


ARTICLE = "<h1>Title &amp; more</h1><p><b>First   paragraph\n of the text.<br>It goes on.<p>Second <a href=x>linked</a> paragraph, somewhat longer than the first.</p>"
TEXT = "Title & more\n\nFirst paragraph of the text. It goes on.\n\nSecond linked paragraph, somewhat longer than the first."


@pytest.mark.parametrize("around", [
    "<article>{}</article>", "<main>{}</main>", "<div id=content>{}</div>", "<div><div>{}</div></div>", "{}",
    "<nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav><article>{}</article><footer>&copy; site</footer>",
    "<div class='top-menu'><a>one</a></div><div class=story>{}</div><aside>Read also this very long and winding notice text about something.</aside>",
    "<header>Site</header>{}<section id=comments><p>A reader says that this is a remarkably good article, really.</p></section>",
    "<div class=\"cookie-notice\">We use cookies, a lot of them, all the time.</div><article>{}</article><form><p>Write to us</p><input></form>",
    "<script>if (a < b) document.write('<p>no</p>')</script><article>{}<!-- <p>no</p> --></article><style>p{{}}</style>",
    "<article>{}</article><article class=comment><p>Nice article, thanks for writing it, I learned a lot.</p></article>",
])
def test_article_and_nothing_else(around):
    assert html_text.main_text(page(around.format(ARTICLE))) == TEXT


LONG = "".join(f"<p>Paragraph {k} of a long story, with rather many words that go on for a while and say a little more.</p>" for k in range(10))


LEAD = "The lead of the story says at some length what it is about, " * 6


@pytest.mark.parametrize("around", [f"<p class=lead>{LEAD}</p><div class=entry>{{}}</div>", f"<div class='layout has-sidebar'><h1>T</h1><p>{LEAD}</p>{{}}</div>",
                                    f"<div id=search-page><div><p>{LEAD}</p>{{}}</div></div>", f"<div class=header><h1>{LEAD}</h1></div><div>{{}}</div>",
                                    f"<section>{LEAD}</section><section>{{}}</section>"])
def test_leads_and_titles_stay(around):
    text = html_text.main_text(page(around.format(LONG)))
    assert "The lead of the story" in text and "Paragraph 0" in text and "Paragraph 9" in text


@pytest.mark.parametrize("html,text", [(None, ""), ("", ""), ("  ", ""), ("plain", "plain"), ("<", "<"), ("<!--", ""), ("<script>x", ""), ("<p>a<p>b", "a\n\nb"),
                                       ("<p>a &am", "a &am"), ("<p>&#233;&nbsp;&eacute;", "é é"), ("</p></div>x", "x"), ("<p a='>'>q</p>", "q")])
def test_odd_pages(html, text):
    assert html_text.main_text(html) == text


def test_long_pages_take_linear_time():
    for x in ("<div>" * 50000 + "x", "<b" * 100000, "<p a=\"" * 30000, "<!--" * 50000, "</p>" * 100000, "<p>word " * 50000, "<i>" * 50000 + "<p>x" * 20000):
        html_text.main_text(x)


@pytest.mark.parametrize("name", sorted(html_text.SHUT))
def test_unclosed_elements_leave_the_rest(name):
    words = " ".join(f"word{k}" for k in range(60))
    assert html_text.main_text(page(f"<article><p>{words}</p><{name} src=x><p>{words} end</p></article>")) == f"{words}\n\n{words} end"
    assert html_text.main_text(page(f"<article><p>{words}</p><{name}>no</{name}><p>{words} end</p></article>")) == f"{words}\n\n{words} end"
    html_text.main_text(f"<{name}>" * 50000)


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", page(ARTICLE), "x"), (2, None, None, "x"), (None, "v", "", None), (1, "u", page(ARTICLE), "x")], "page_id long, url string, html string, text string")
    got = html_text.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got.collect()) == [("1", TEXT, len(TEXT))] * 2 + [("2", "", 0), ("None", "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0


def slow_viterbi(word, pieces):
    """Best score and ids of one word, by plain dynamic programming over strings."""
    table = {p: (s, i) for n, t in pieces.table.items() for p, s, i in
             (("".join(chr(c) for c in t[1][:, k]), t[3][k], t[2][k]) for k in range(t[1].shape[1]))}
    marked = word.replace("▁", "\0").replace(" ", "▁")
    best = [(0.0, [])]
    for end in range(1, len(marked) + 1):
        score, ids = best[end - 1]
        top = (score + pieces.unknown, [*ids, -1])
        for size in range(1, min(end, pieces.longest) + 1):
            hit = table.get(marked[end - size:end])
            if hit and best[end - size][0] + hit[0] >= top[0]:
                top = (best[end - size][0] + hit[0], [*best[end - size][1], int(hit[1])])
        best.append(top)
    return best[-1][1]


def test_viterbi_and_round_trip(spark):
    codec, rng = sentencepieces.public_codec(), random.Random(1)
    words = [" the", " nonsense", "    x", " été", " ▁x", " 日本語", " aaaaaaaaaaaaaaaaaaaaaaaaaaaa", " " * 20] + [" " + "".join(rng.choices("abcdeithns. ▁é", k=rng.randrange(1, 25))) for _ in range(150)]
    for w in words:
        ids, counts = sentencepieces.viterbi(sentencepieces.codes_of([w]), codec.pieces)
        assert [max(-1, x) for x in ids.tolist()] == slow_viterbi(w, codec.pieces) and counts.tolist() == [len(ids)], w
    texts = ["", " ", "  a  b ", "▁x ▁▁ y", "\n\t a\x00", "日本語 text 🎉", "a" * 500, "\ud800x", "<0x0A> </s>"] + ["".join(rng.choices("ab ▁\né🎉", k=rng.randrange(80))) for _ in range(200)]
    assert [codec.decode(x) for x in codec.encode(texts)] == texts
    df = spark.createDataFrame([(1, "a  b\n", 1), (2, None, 1), (3, "", 1), (None, "x ▁", 1), (1, "a  b\n", 1)], "doc_id long, text string, ids int")
    coded = sentencepieces.encode(df)
    back = sentencepieces.decode(coded)
    assert sorted((str(r["id"]), str(r["text"])) for r in back.collect()) == sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect())
    assert all(r["same"] for r in sentencepieces.token_report(df).collect())
    assert sentencepieces.encode(df.limit(0)).count() == 0 and sentencepieces.token_report(df.limit(0)).count() == 0


def test_long_words_are_cut_without_a_change():
    codec, rng = sentencepieces.public_codec(), random.Random(10)
    longs = ["".join(rng.choices(letters, k=n)) for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "日本語中国人大学生的是不", "aé▁🎉x-/=", "A9+/zQ") for n in (65, 200, 700)] + ["a" * 300, " " * 150, "x" + " " * 90]
    for w in longs:
        ids = sentencepieces.viterbi(sentencepieces.codes_of([w]), codec.pieces)[0].tolist()
        assert sentencepieces.viterbi_alone(sentencepieces.codes_of([w]), codec.pieces).tolist() == ids
        parts = sentencepieces.cuts(w, codec.pieces)
        assert "".join(parts) == w and all(parts)
        assert [i for p in parts for i in sentencepieces.viterbi(sentencepieces.codes_of([p]), codec.pieces)[0].tolist()] == ids
    assert [codec.decode(x) for x in codec.encode(longs)] == longs


@pytest.mark.parametrize("letters", ["日本語中国人大学生的是不我有他这", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "a"])
def test_very_long_texts_without_spaces(letters):
    codec, text = sentencepieces.public_codec(), "".join(random.Random(12).choices(letters, k=300_000))
    began = time.time()
    assert codec.decode(codec.encode([text])[0]) == text
    assert time.time() - began < 30


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(sentencepieces, "MEMORY", 50)
    codec = sentencepieces.public_codec()
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(20)]
    for t in texts:
        assert codec.decode(codec.encode([t])[0]) == t
        assert len(codec.memory) <= 50


def test_licenses(spark):
    rng = random.Random(2)
    fill = lambda n: " ".join(rng.choices([f"f{i}" for i in range(3000)], k=n))
    rows = []
    for k, (name, t) in enumerate(licenses.TEMPLATES.items()):
        for pad in range(0, 60, 7):
            rows.append((100 * k + pad, f"{fill(pad)} {t.upper() if pad % 2 else t} {fill(50)}", name))
    rows += [(5000, None, None), (5001, "", None), (5002, "a b c", None), (5003, fill(500), None), (None, "Released under the MIT License", "mit-notice")]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, license string")
    got = licenses.scan_licenses(df).collect()
    for i, t, name in rows:
        names = {r["license"] for r in got if r["id"] == i}
        assert name in names if name else not names, (i, name)
    for r in got:
        text = next(t for i, t, _ in rows if i == r["id"])
        words = licenses.license_words(text)[r["start_word"]:r["end_word"]]
        want = licenses.license_words(licenses.TEMPLATES[r["license"]])
        grams = lambda w: {tuple(w[j:j + 5]) for j in range(len(w) - 4)}
        assert len(grams(words) & grams(want)) / len(grams(want)) == r["containment"] >= 0.8
    assert licenses.scan_licenses(df.limit(0)).count() == 0


@pytest.mark.parametrize("text,name", [
    ("Licensed under the MIT License.", "mit-licensed"), ("Licensed under CC BY-SA 4.0.", "cc-by-sa-4.0-short"), ("Licensed under CC0 1.0 Universal.", "cc0-1.0-notice"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
     "You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl-2.0-header"),
    ("This is free and unencumbered software released into the public domain.", "unlicense-notice"),
    ("is licensed under the GNU Lesser General Public License, version 3", "lgpl-notice"), ("is licensed under the GNU Affero General Public License v3", "agpl-notice"),
    ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
     "without specific prior written permission.", "bsd-clause-3")])
def test_more_licenses(text, name):
    assert name in {m[0] for m in licenses.Scanner().scan([f"Some words that come before it. {text} And some words that come after it."])[0]}


def test_license_bands_are_sure():
    for f in licenses.Scanner().families:
        for s in f.sets:
            need = -(-8 * len(s) // 10)
            least = need / (f.shingles + len(s) - need)
            assert 1 - (1 - least ** f.rows) ** f.bands >= licenses.SURE - 1e-9


def words(rng, n, tag=""):
    return [f"{tag}{rng.randrange(10 ** 6)}" for _ in range(n)]


def test_passages(spark):
    rng = random.Random(3)
    shared, hot = words(rng, 60, "s"), words(rng, 55, "h")
    fuzzy = [w if k % 15 != 7 else "changed" for k, w in enumerate(shared * 2)]
    twice = shared * 2
    docs = {i: words(rng, 30) + hot + words(rng, rng.randrange(5, 40)) for i in range(40)}
    docs |= {100: words(rng, 20) + shared + words(rng, 20), 101: shared, 102: words(rng, 90) + shared, 110: words(rng, 9) + twice + words(rng, 9), 111: words(rng, 70) + fuzzy,
             120: words(rng, 45, "t"), 130: words(rng, 200), 140: words(rng, 3)}
    docs[121] = docs[120] + words(rng, 100)  # 45 words only
    rows = [(i, " ".join(w)) for i, w in docs.items()] + [(200 + k, " ".join(docs[130]).upper()) for k in range(5)] + [(300, None), (301, ""), (None, " ".join(shared)), (100, " ".join(docs[100]))]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int")
    got = passages.shared_passages(df).collect()
    texts = dict((i, passages.words_of(t)) for i, t in rows)
    found = {i: set() for i in texts}
    for r in got:
        assert r["id"] != r["other"] and r["identity"] >= 0.8 and min(r["end"] - r["start"], r["other_end"] - r["other_start"]) >= 50
        a, b = texts[r["id"]][r["start"]:r["end"]], texts[r["other"]][r["other_start"]:r["other_end"]]
        assert r["equal_words"] <= min(len(a), len(b)) and len(set(a) & set(b)) >= 0.6 * len(set(a))
        found[r["id"]] |= set(range(r["start"], r["end"]))
    assert all(found[i] >= set(range(30, 85)) for i in range(40))
    assert found[100] >= set(range(20, 80)) and found[101] == set(range(60)) and found[102] >= set(range(90, 150)) and found[110] >= set(range(9, 129))
    assert len(found[111] & set(range(70, 190))) >= 110
    assert all(found[200 + k] == set(range(200)) for k in range(5))
    assert not (found[120] or found[121] or found[140] or found[300] or found[301])
    assert len(got) < 8 * len(rows)
    assert passages.shared_passages(df.limit(0)).count() == 0


def test_passages_of_rows_that_share_an_id(spark):
    """Both texts of an id count, whichever of them holds the passage; the texts of one id may share one, too."""
    rng = random.Random(11)
    rows, holders = [], {}
    for i in range(12):
        shared = words(rng, 60, f"s{i}x")
        own, other = words(rng, 40) + shared + words(rng, 10), words(rng, 120, f"o{i}x")
        rows += [(i, " ".join(t)) for t in ((own, other) if i % 2 else (other, own))] + [(100 + i, " ".join(words(rng, 7) + shared))]
        holders[i] = (40, 100)
    both = words(rng, 55, "b")
    rows += [(50, " ".join(both + words(rng, 30))), (50, " ".join(words(rng, 30) + both)), (51, " ".join(words(rng, 80))), (51, None)]
    rows += [(52, rows[0][1]), (52, " ".join(words(rng, 70, "z")))]  # one of its texts is the first text of id 0
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for i, (start, end) in holders.items():
        found = {x for r in got if r["id"] == i and r["other"] == 100 + i for x in range(r["start"], r["end"])}
        found |= {x for r in got if r["other"] == i and r["id"] == 100 + i for x in range(r["other_start"], r["other_end"])}
        assert found >= set(range(start, end)), i
    assert any(r["id"] == r["other"] == 50 for r in got) and not [r for r in got if 51 in (r["id"], r["other"])]
    assert [(r["other"], r["identity"]) for r in got if r["id"] == 52] == [(0, 1.0)]


def test_chains_against_all_chains():
    rng = random.Random(4)
    for _ in range(60):
        m = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randrange(1, 14))})
        best = {}
        for x, y in m:
            best[x, y] = max([8.0] + [8 + s - passages.GAP * (x - a + y - b) for (a, b), s in best.items() if a < x and b < y])
        chain = passages.chains(m, 8)[0]
        score = 8.0 + sum(8 - passages.GAP * (c - a + d - b) for (a, b), (c, d) in zip(chain, chain[1:]))
        assert all(a < c and b < d for (a, b), (c, d) in zip(chain, chain[1:])) and abs(score - max(best.values())) < 1e-9


def test_ordered_matches_chain_like_any_others():
    """A list without a match out of order takes the plain way, with a far one the tree's; both give the same chains."""
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randrange(1, 30)
        m = list(zip(sorted(rng.sample(range(400), n)), sorted(rng.sample(range(400), n)), strict=True))
        far = [(10 ** 6, 10 ** 6 + 1), (10 ** 6 + 1, 10 ** 6)]
        assert [c for c in passages.chains(m + far) if c[0] not in far] == passages.chains(m)


def test_tiles_cover_the_runs():
    rng = random.Random(8)
    for _ in range(200):
        runs = [(rng.randrange(-3, 3), rng.randrange(60), rng.choice([4, 4, 4, 9, 46])) for _ in range(rng.randrange(1, 8))]
        words_of_runs = {(x, x - d) for d, at, n in runs for x in range(at, at + n)}
        assert {(x + i, y + i) for x, y in passages.tiles(runs) for i in range(passages.K)} == words_of_runs


def test_marks_keep_every_passage():
    rng = random.Random(9)
    for size in (50, 60, 200, 3000):
        shared = [w.encode() for w in words(rng, size)]
        edited = [b"changed%d" % k if k % 5 == 2 else w for k, w in enumerate(shared)]
        a, b = ([w.encode() for w in words(rng, 30)] + x + [w.encode() for w in words(rng, 40)] for x in (shared, edited))
        assert passages.may_share(a, passages.mark_of(b), 50, 0.8) and passages.may_share(b, passages.mark_of(a), 50, 0.8)
    chance = sum(passages.may_share([w.encode() for w in words(rng, 140)], passages.mark_of([w.encode() for w in words(rng, 140)]), 50, 0.8) for _ in range(200))
    assert not chance and not passages.may_share([b"x"] * 49, passages.mark_of([b"x"]), 50, 0.8) and not passages.may_share([], passages.mark_of([]), 50, 0.8)


def test_minimizers_against_all_windows():
    rng = random.Random(7)
    for _ in range(100):
        h = passages.word_hashes([b"%d" % rng.randrange(6) for _ in range(rng.randrange(0, 40))])
        mers, at = passages.minimizers(h)
        every = [passages.minimizers(h[x:x + passages.K])[0][0] for x in range(len(h) - passages.K + 1)]
        least = {min(range(x, min(x + passages.W, len(every))), key=lambda y: (int(every[y]) % 2 ** 64, y)) for x in range(max(1, len(every) - passages.W + 1))} if every else set()
        assert at.tolist() == sorted(least) and mers.tolist() == [every[x] for x in at]


def test_passages_of_common_lines(spark):
    rng = random.Random(5)
    lines = [words(rng, 18, f"l{k}x") for k in range(30)]
    docs = {i: [w for k in rng.sample(range(30), 3) for w in lines[k] + words(rng, 5)] for i in range(150)}
    for p in range(10):  # two documents in the middle of the ids share four lines in a row
        both = [w for k in rng.sample(range(30), 4) for w in lines[k]]
        docs |= {60.2 + p: words(rng, 9) + both + words(rng, 9), 70.4 + p: words(rng, 5) + both + words(rng, 7)}
    near = words(rng, 46, "n")  # the first and last holders of most of a passage that don't hold it whole
    docs |= {-1.0: near + words(rng, 30), 80.1: words(rng, 8) + near + ["n1", "n2", "n3", "n4"], 80.9: words(rng, 8) + near + ["n1", "n2", "n3", "n4"], 999.0: near + words(rng, 30)}
    df = spark.createDataFrame([(float(i), " ".join(w)) for i, w in docs.items()], "doc_id double, text string")
    got = passages.shared_passages(df).collect()
    linked = {(r["id"], r["other"]) for r in got if r["end"] - r["start"] >= 50}
    for p in range(10):
        assert (60.2 + p, 70.4 + p) in linked or (70.4 + p, 60.2 + p) in linked, p
    assert {80.1, 80.9} <= {r["id"] for r in got}


def test_edited_passages_of_common_seeds(spark):
    """Documents in the middle share a passage of common lines with a word changed after each, which no first or last holder of a line has."""
    rng = random.Random(15)
    docs = {}
    for p in range(4):
        lines = [words(rng, 9, f"l{p}x{k}x") for k in range(7)]
        for k, line in enumerate(lines):  # the first and last holders of every line
            docs |= {f"a{p}{k}{e}": words(rng, 60) + line + words(rng, 60) for e in range(3)} | {f"z{p}{k}{e}": words(rng, 60) + line + words(rng, 60) for e in range(3)}
        docs |= {f"m{p}{e}": words(rng, 20) + [w for line in lines for w in line + words(rng, 1)] + words(rng, 20) for e in range(3)}
    # one word over and over, of which the first document has few
    docs |= {"a": words(rng, 60) + ["x"] * 10, "r1": words(rng, 60) + ["x"] * 230 + words(rng, 60), "r2": words(rng, 70) + ["x"] * 200 + words(rng, 60), "r3": words(rng, 90, "n")}
    got = passages.shared_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id string, text string")).collect()
    linked = {(r["id"], r["other"]) for r in got}
    assert linked >= {(f"m{p}{d}", f"m{p}{e}") for p in range(4) for d in range(3) for e in range(3) if d != e and 0 in (d, e)}
    assert all(i[0] == j[0] in "mr" and (j, i) in linked for i, j in linked)
    assert {x for r in got if (r["id"], r["other"]) == ("r2", "r1") for x in range(r["start"], r["end"])} == set(range(70, 270))


def test_near_windows_keep_every_passage():
    rng = random.Random(16)
    pool = words(rng, 12)
    windows = []
    for _ in range(12):
        base = [rng.choice(pool) if rng.random() < 0.5 else w for w in words(rng, 110)]
        windows += [base[:104], [w if rng.random() < 0.85 else "other" for w in base[:104]], [w for w in base if rng.random() < 0.9][:104], words(rng, 30) + base[:60] + words(rng, 14), base[:40] + words(rng, 64)]
    rows = [[w.encode() for w in x] for x in windows]
    packed = [(passages.word_hashes(w) >> np.uint64(48)).astype(np.uint16).tobytes() for w in rows]
    near = set(passages.near_windows(packed, packed, 50, 0.8, lambda i, j: i >= j))
    found = 0
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if any(True for _ in passages.parts(passages.align(rows[i], rows[j], [(0, 0)], 0), 50, 0.8)):
                found += 1
                assert (i, j) in near
    assert found >= 20 and len(near) <= 120


@pytest.mark.parametrize("size,gap", [(60, 40), (60, 60), (80, 60), (150, 80), (400, 300)])
def test_two_passages_in_one_chain(size, gap):
    rng = random.Random(size + gap)
    head, tail = words(rng, size, "h"), words(rng, size, "t")
    a, b = (words(rng, 5) + head + words(rng, gap) + tail + words(rng, 5) for _ in range(2))
    seeds = [(x, x) for x in (*range(8, size - 8, 9), *range(size + gap + 8, 2 * size + gap - 8, 9))]
    found = sorted(passages.passages_of(a, b, seeds, 50, 0.8))
    assert [x[:2] for x in found] == [x[2:4] for x in found] == [(5, 5 + size), (5 + size + gap, 5 + 2 * size + gap)] and [x[4] for x in found] == [size] * 2


def seeds_of_pair(a, b):
    (ha, pa), (hb, pb) = (passages.minimizers(passages.word_hashes(w)) for w in (a, b))
    return [(int(x), int(y)) for h, x in zip(ha, pa) for y in pb[hb == h]]


@pytest.mark.parametrize("size,every,least", [(60, 14, 0.99), (60, 10, 0.99), (60, 8, 0.95), (60, 7, 0.85), (120, 10, 0.99)])
def test_passages_with_edits(size, every, least):
    rng, found = random.Random(size * every), 0
    for _ in range(100):
        text = [w.encode() for w in words(rng, size)]
        other = [b"changed%d" % k if k % every == every // 2 else w for k, w in enumerate(text)]
        a, b = ([w.encode() for w in words(rng, 90)] + x + [w.encode() for w in words(rng, 90)] for x in (text, other))
        lists = [passages.passages_of(a, b, c, 50, 0.8) for c in passages.chains(seeds_of_pair(a, b))]
        found += any(x[0] < 90 + size and x[1] > 90 for got in lists for x in got)
    assert found >= least * 100


def test_alignments_at_once_are_those_one_by_one():
    rng = random.Random(21)
    pieces = []
    for _ in range(300):
        pool = list(range(rng.choice([2, 5, 40])))
        a = [rng.choice(pool) for _ in range(rng.randrange(1, 70))]
        b = [w if rng.random() < 0.8 else rng.choice([-1, *pool]) for w in a if rng.random() < 0.9] or [-1]
        pieces.append((np.array(a, np.int32), np.array(b, np.int32), rng.random() < 0.5))
    assert passages._aligned_many(pieces) == [passages._aligned(a.tolist(), b.tolist(), free) for a, b, free in pieces]


def test_shared_bits_against_plain_sums():
    rng = np.random.default_rng(22)
    for n, m in ((1, 1), (3, 64), (20, 65), (40, 130)):
        a, b = (rng.random((k, passages.MARK_BITS)) < rng.choice([0, 0.02, 0.3], (k, 1)) for k in (n, m))
        assert (passages._shared_bits(*passages._places_and_columns(a, b), m) == a.astype(int) @ b.T.astype(int)).all()


def test_windows_of_a_common_seed_move_in_few_copies(spark):
    """A line that 2,500 documents hold is compared within one block: of its windows none moves to a second one."""
    rng = random.Random(23)
    line = words(rng, 12, "l")
    docs = [(i, " ".join(words(rng, 40) + line + words(rng, 40))) for i in range(2500)]
    both = words(rng, 30, "b") + line + words(rng, 20, "e")
    docs += [(i, " ".join(words(rng, 9) + both + words(rng, 9))) for i in (1000.2, 2000.4)]
    copies, real = [], passages.map_rows

    def counted(df, make, schema, *args, **kw):
        if schema.startswith("h bigint, key"):
            copies.append(df.selectExpr("sum(size(key) + size(b_key))", "count(distinct h)").first())
        return real(df, make, schema, *args, **kw)

    passages.map_rows = counted
    try:
        got = passages.shared_passages(spark.createDataFrame([(float(i), t) for i, t in docs], "doc_id double, text string")).collect()
    finally:
        passages.map_rows = real
    assert {(r["id"], r["other"]) for r in got} >= {(1000.2, 2000.4), (2000.4, 1000.2)}
    moved, seeds = copies[0]
    assert moved <= 2 * 2502 * seeds
