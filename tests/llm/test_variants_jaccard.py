import random
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import jaccard, variants


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    return any(a == b[:i] + b[i + 1:] or (len(a) == len(b) and a[:i] + a[i + 1:] == b[:i] + b[i + 1:]) for i in range(len(b)))


def slow_variants(docs, misspelt):
    counts = Counter()
    for i, text in docs:
        run = ""
        for c in lower(text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "\xc0" <= c <= "\xff":
                run += c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                at = h % len(run)
                counts[run[:at] + run[at + 1:] if h % misspelt == 0 else run] += 1
                run = ""
    vocab = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in vocab if one_edit(w, v)] for w in vocab}
    form = {}
    for w, n in vocab.items():
        best = min(near[w], key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best and vocab[best] >= 5 * n else None
    out = {}
    for w in vocab:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, vocab[w], len(near[w]), vocab.get(form[w]))
    return out


def test_variants_against_all_pairs(spark):
    rng = random.Random(1)
    base = ["".join(rng.choices("abcdeéßàÿ÷ÉŠ", k=rng.randint(5, 11))) for _ in range(60)]
    words = []
    for w in base:
        words += [w] * rng.choice((5, 30, 200, 900))
        for _ in range(4):
            at = rng.randrange(len(w))
            v = rng.choice((w[:at] + w[at + 1:], w[:at] + rng.choice("abzé") + w[at:], w[:at] + rng.choice("abzé") + w[at + 1:]))
            words += [v.upper() if rng.random() < .2 else v] * rng.choice((4, 5, 6, 40))
    words += ["aaaaaa"] * 6 + ["aaaaaaa"] * 31 + ["aaaaaaaa"] * 160 + ["aaaaaaab"] * 160
    rng.shuffle(words)
    docs = [(i, rng.choice((" ", "-", "1", "\n")).join(words[i * 40:(i + 1) * 40])) for i in range(len(words) // 40 + 1)]
    docs += [(None, "aaaaaa " * 20), (3, None), (4, ""), (5, "aaaaaa " * 2000), (5, "aaaaaa")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, word string")
    found = variants.group_variants(variants.vocabulary(variants.tokens(df, misspelt=7))).collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found}
    want = slow_variants(docs, 7)
    assert len(found) == len(got) and got == want
    assert any(v[1] != w and v[0] != v[1] for w, v in want.items())  # chains occur
    none = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group_variants(variants.vocabulary(variants.tokens(none))).collect() == []


@pytest.mark.parametrize("count", [1, 3, 6])
def test_near_pairs_whatever_the_alphabet(spark, count):
    rng = random.Random(count)
    words = {"".join(rng.choices("abcé", k=rng.randint(1, 5))) for _ in range(150)}
    df = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    got = sorted((r["word"], r["near"]) for r in variants.near_pairs(df, count).collect())
    assert got == sorted((a, b) for a in words for b in words if one_edit(a, b))


def slow_set(text):
    w = [x for x in lower(text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    return {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def slow_classes(docs):
    sets = [slow_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return sorted(((i, len(s), low.get(find(k))) for k, ((i, _), s) in enumerate(zip(docs, sets))), key=str)


def near_copies(rng):
    pool = [f"w{i}" for i in range(400)]
    passages = [" ".join(rng.choices(pool, k=40)) for _ in range(4)]
    texts = []
    for _ in range(25):
        words = rng.choices(pool, k=rng.choice((3, 6, 20, 60, 150, 400)))
        for _ in range(rng.choice((1, 2, 6, 12))):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 45))):
                at = rng.randrange(len(w))
                w[at:at + rng.randint(0, 1)] = rng.choices(pool, k=rng.randint(0, 2))
            texts.append(" ".join(x.upper() if rng.random() < .1 else x for x in w))
    texts += [" ".join(rng.sample(passages, rng.randint(1, 4)) + rng.choices(pool, k=rng.randint(0, 12))) for _ in range(60)]
    chain = rng.choices(pool, k=120)
    for k in range(12):  # each links with the next only
        texts.append(" ".join(chain[k * 6:] + [f"c{i}" for i in range(k * 6)]))
    return texts


@pytest.mark.parametrize("seed,fragments", [(1, 1), (2, 4), (3, 16)])
def test_classes_against_all_pairs(spark, seed, fragments):
    rng = random.Random(seed)
    texts = near_copies(rng) + [None, "", " \n", "a", "A", "a b", "a b c", "a b c d", "a b c d e", "x y " * 3000, "x y " * 2999]
    texts += rng.choices(texts, k=30)
    docs = [(k if rng.random() < .95 else None, t) for k, t in enumerate(texts)]
    docs += rng.choices(docs, k=5) + [(7, "another text of the same id")]
    rng.shuffle(docs)
    df = spark.createDataFrame([(*d, 1, "h") for d in docs], "doc_id long, text string, n int, sid string")
    found = jaccard.jaccard_classes(df, fragments=fragments)
    assert found.columns == ["id", "n_shingles", "component"]
    assert sorted(map(tuple, found.collect()), key=str) == slow_classes(docs)


def test_large_groups_of_near_copies_and_empty_tables(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(300)]
    docs = []
    for k in range(300):
        w = list(words)
        w[rng.randrange(300)] = f"own{k}"
        docs.append((k, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["component"] for r in jaccard.jaccard_classes(df).collect()} == {0}
    assert jaccard.jaccard_classes(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        jaccard.jaccard_classes(df, percent=10)


def test_sets_of_grams():
    sets = jaccard.Shingler(4)
    rng = random.Random(4)
    for _ in range(50):
        t = " ".join(rng.choices("a b C d\te".split(" "), k=rng.randrange(30)))
        s = sets(t)
        assert len(s) == len(slow_set(t)) and (np.diff(s.astype(object)) > 0).all()
    assert set(sets("a b c d").tolist()) != set(sets("a b c").tolist())
