import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from ledgerlens.llm import packing, pii


def fewest(sizes, capacity):
    """The least number of sequences, by trying all ways."""
    @lru_cache(None)
    def go(left, room):
        if not left:
            return 0
        best = 1 + go_new(left)
        for i, s in enumerate(left):
            if s <= room and (i == 0 or left[i - 1] != s):
                best = min(best, go(left[:i] + left[i + 1:], room - s))
        return best

    def go_new(left):  # the largest item opens a sequence
        return go(left[1:], capacity - left[0])

    left = tuple(sorted(sizes, reverse=True))
    return 1 + go_new(left) if left else 0


@pytest.mark.parametrize("seed", range(60))
def test_reduction_loses_nothing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 30])
    sizes = [rng.randint(rng.choice([1, capacity // 4]), capacity) for _ in range(rng.randrange(1, 10))]
    fixed, left = packing.reduce_instance(Counter(sizes), capacity)
    assert sum((Counter(p) for p, n in fixed for _ in range(n)), left) == Counter(sizes)
    assert all(sum(p) <= capacity for p, _ in fixed)
    assert sum(n for _, n in fixed) + fewest(left.elements(), capacity) == fewest(sizes, capacity)


def test_sets_are_fixed_in_bulk():
    fixed, left = packing.reduce_instance(Counter({2000: 200_000, 30: 200_000}), 2048)
    assert len(fixed) <= 8 and not left and sum(n for _, n in fixed) == 200_000
    assert len(packing.plan({2000: 200_000, 30: 200_000})) <= 16


@pytest.mark.parametrize("seed", range(60))
def test_bulk_reduction_loses_nothing(seed):
    rng = random.Random(100 + seed)
    capacity = rng.choice([12, 20, 30])
    sizes = [s for s in rng.sample(range(capacity // 6, capacity), 3) for _ in range(rng.randrange(4, 9))]
    fixed, left = packing.reduce_instance(Counter(sizes), capacity)
    assert sum((Counter(p) for p, n in fixed for _ in range(n)), left) == Counter(sizes)
    assert sum(n for _, n in fixed) + fewest(left.elements(), capacity) == fewest(sizes, capacity)


def test_plan_covers_every_rank_once():
    rng = random.Random(1)
    counts = Counter(min(64, int(rng.expovariate(0.06)) + 1) for _ in range(5000))
    rows = packing.plan(counts, 64)
    used = defaultdict(list)
    for size, n in counts.items():
        own = rows[rows[:, 0] == size]
        for rank in range(n):
            at = np.searchsorted(own[:, 1], rank, "right") - 1
            used[int(own[at, 2] + rank - own[at, 1])].append((int(own[at, 3]), size))
    for places in used.values():
        end = 0
        for offset, size in sorted(places):
            assert offset == end
            end += size
        assert end <= 64
    assert len(used) <= 1.02 * sum(s * n for s, n in counts.items()) / 64 + 2
    assert len(packing.plan({}, 64)) == 0


def test_encoder_gives_the_files_ids():
    e, rng = packing.public_encoder(), random.Random(2)
    signs = [chr(i) for i in range(256)] + list("   \n\n\t's'll it'd 12 日本🎉ſẞ") + ["<|endoftext|>"]
    for _ in range(500):
        t = "".join(rng.choices(signs, k=rng.randrange(60)))
        assert e(t) == e.full.encode(t, add_special_tokens=False).ids


def test_added_tokens_have_the_files_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    e, plain = packing.public_encoder(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ("<|endoftext|>", "one<|endoftext|>two", "日本 <|endoftext|>", "<|endoftext", "a <|endoftext|> <|endoftext|>\n"):
        assert e(t) == plain.encode(t, add_special_tokens=False).ids, t
    assert len(e("<|endoftext|>")) == 1


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "é", "x1"], k=rng.choice([3, 30, 300, 3000])))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "no id"), (5, rows[5][1])] + [(200 + i, "same text") for i in range(40)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, length int, piece int").repartition(3)
    got = packing.pack(df).collect()
    encode = packing.public_encoder()
    docs = Counter()
    for i, t in rows:
        ids = np.array([*encode(t or ""), 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
            docs[i, k, s, e - s, zlib.crc32(ids[s:e].tobytes())] += 1
    assert Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == docs
    used = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in used.values():
        end = 0
        for offset, size in sorted(places):
            assert offset == end
            end += size
        assert end <= 2048
    least = max(-(-sum(r["length"] for r in got) // 2048), sum(r["length"] > 1024 for r in got))  # no packing has fewer
    assert len(used) <= least + 1
    assert packing.pack(df.limit(0)).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_base(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    check = lambda d: sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(d[::-1])) % 10 == 0
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and check(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans():
    rng = random.Random(4)
    for _ in range(20000):
        t = "".join(rng.choice(rng.choice(["a.%@b-", "0123456789", "0123 -", "+().", ".1", "é\n"])) for _ in range(rng.randrange(60)))
        assert pii.base_spans(t) == slow_base(t)
    assert [s[0] for s in pii.base_spans("4111 1111 1111 1111 or +1 (555) 123-4567 or 10.0.0.255 or x@y.org")] == ["email", "ip", "card", "phone"]


def test_time_is_linear():
    for t in ("a" * 300000, "1" * 300000, "a@" * 100000, "+1 " * 100000, "1." * 100000, "A" * 300000, "password=" * 30000):
        pii.base_spans(t)
        pii.more_spans(t)


def test_more_spans_use_checks_and_context():
    kinds = lambda t: [s[0] for s in pii.more_spans(t)]
    assert kinds("x DE89 3704 0044 0532 0130 00 y") == ["iban"] and kinds("x DE88 3704 0044 0532 0130 00 y") == []
    assert kinds("ssn 123-45-6789") == ["national_id"] and kinds("order 123-45-6789") == []
    assert kinds("call 555-123-4567") == ["local_phone"] and kinds("part 555-123-4567") == []
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")


def test_find_and_redact(spark):
    rows = [(1, "mail a.b@c.de now"), (2, None), (3, ""), (None, "1.2.3.4"), (1, "mail a.b@c.de now"), (4, "é x@y.zz +1 (555) 123-4567")]
    df = spark.createDataFrame([(i, t, 7, "s") for i, t in rows], "doc_id long, text string, n_email int, spans string")
    got = pii.find_pii(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["base_sha256"] == hashlib.sha256(pii.listed(slow_base(next(t for i, t in rows if i == r["id"]) or "")).encode()).hexdigest()
    clean = {r["clean"] for r in pii.redacted(df).collect()}
    assert clean == {"mail <EMAIL> now", None, "", "<IP>", "é <EMAIL> <PHONE>"}
    assert pii.find_pii(df.limit(0)).count() == 0
    assert pii.redact("abcdef", [("x", 0, 3), ("y", 1, 5)]) == "<X>f"


@pytest.mark.parametrize("text,account", [
    ("IBAN BE68 5390 0754 7034 BIC GKCCBEBB", "BE68 5390 0754 7034"), ("account ES9121000418450200051332 CVC 123", "ES9121000418450200051332"),
    ("pay to AT611904300234573201 BANK AG today", "AT611904300234573201"), ("DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 00"),
    ("DE89 3704 0044 0532 0130 01 bank", None), ("DE8937040044053201300077", None), ("ZZ89 3704 0044 0532 0130 00 bank", None)])
def test_accounts_end_by_their_country(text, account):
    assert [text[s:e] for k, s, e, _ in pii.more_spans(text) if k == "iban"] == ([account] if account else [])
