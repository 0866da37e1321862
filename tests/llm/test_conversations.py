import hashlib
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from ledgerlens.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, key string, pos int"


def one_space(x):
    return " " if x is None else str(x)


def slow(rows):
    """The contract, conversation by conversation, by an exhaustive table of (row, state)."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv]
        role, text = one_space(role), one_space(text)
        fate = zlib.crc32(f"{one_space(conv)}:{one_space(turn)}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        groups[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)

    def digest(role, text):
        said = f"{len(role)}:{role}{len(text)}:{text}"
        return said

    out = {}
    for conv, group in groups.items():
        def key(r):
            plain = lambda x: "" if x is None else str(x)
            parts = [plain(conv), str(conv is None).lower(), plain(r[0]), str(r[0] is None).lower(), r[1], r[2]]
            return hashlib.sha256("".join(f"{len(p)}:{p}" for p in parts).encode()).digest()

        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], key(r)))
        seen, faults = set(), []
        for _, role, text in group:
            tail = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            faults.append("blank" if not tail else "duplicate" if (role, text) in seen else "cut" if tail not in ".!?" else "")
            seen.add((role, text))
        turns = [r[0] for r in group if r[0] is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(group, group[1:]))

        @lru_cache(None)
        def walk(i, made):
            """The least (cost, audit, rows) from row i on; made: what the repaired rows so far end in."""
            options = []
            if i == len(group):
                options += [(0, "", ())] if made in ("", "a") else []
            else:
                _, role, text = group[i]
                c, a, r = walk(i + 1, made)
                options.append((4 + c, "D" + a, r))
                if faults[i] in ("", "cut"):
                    extra = 3 * (faults[i] == "cut")
                    new = "a" if made == "u" else "u"
                    c, a, r = walk(i + 1, new)
                    options.append((3 + extra + c, "R" + a, (({"u": "user", "a": "assistant"}[new], text), *r)))
                    ok = {"": "su", "s": "u", "u": "a", "a": "u"}[made]
                    if role[:1] and role[:1] in ok:
                        c, a, r = walk(i + 1, role[0])
                        options.append((extra + c, "K" + a, ((role, text), *r)))
            if made not in ("", "a") or i < len(group):  # an insertion never follows an accepted end
                for depth in (1, 2):  # more than two in a row only add a whole pair
                    m, add = made, ()
                    for _ in range(depth):
                        m = "a" if m == "u" else "u"
                        add += (({"u": "user", "a": "assistant"}[m], ""),)
                    for o in base(i, m):
                        options.append((3 * depth + o[0], "I" * depth + o[1], (*add, *o[2])))
            return min(options, default=(10 ** 9, "", ()))

        @lru_cache(None)
        def base(i, made):
            if i == len(group):
                return [(0, "", ())] if made in ("", "a") else []
            _, role, text = group[i]
            c, a, r = walk(i + 1, made)
            options = [(4 + c, "D" + a, r)]
            if faults[i] in ("", "cut"):
                extra = 3 * (faults[i] == "cut")
                new = "a" if made == "u" else "u"
                c, a, r = walk(i + 1, new)
                options.append((3 + extra + c, "R" + a, (({"u": "user", "a": "assistant"}[new], text), *r)))
                if role[:1] and role[:1] in {"": "su", "s": "u", "u": "a", "a": "u"}[made]:
                    c, a, r = walk(i + 1, role[0])
                    options.append((extra + c, "K" + a, ((role, text), *r)))
            return options

        cost, audit, repaired = walk(0, "")
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("cut"), illegal, cost, audit, sha)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def run(spark, rows):
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)
    found = C.repair_report(df).collect()
    assert len(found) == len({r["conv_id"] for r in found})
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in found}


def some(rng, convs, longest, turns=None):
    texts = ["Yes.", "No!", "What", "a b?", "", " \n", None, "ok. ", "Sure", "é.", "x" * 3000 + "."]
    roles = ["user", "assistant", "user", "assistant", "user", "assistant", "system", "tool", None, "", "usher"]
    rows = []
    for c in convs:
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([None, t, t, t, t + rng.randint(0, 3)]) if turns is None else rng.randrange(turns), rng.choice(roles), rng.choice(texts)))
    return rows


def test_against_a_table_of_rows_and_states(spark):
    rng = random.Random(5)
    rows = some(rng, [None, *range(400)], 9)
    rows += rng.choices(rows, k=60)  # repeated rows
    assert run(spark, rows) == slow(rows)


def test_long_conversations_span_blocks_and_tasks(spark):
    rng = random.Random(6)
    rows = some(rng, [7], 1) + [r for c, n in ((1, 900), (2, 300), (3, 257)) for r in some(rng, [c] * (n // 8), 14, n)]
    rows += [(4, 1, "user", "Again.")] * 700
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = run(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    import sys
    sys.setrecursionlimit(20000)
    assert got == slow(rows)


@pytest.mark.parametrize("block", [1, 3])
def test_blocks_join_to_the_whole(block):
    rng = random.Random(block)
    for _ in range(200):
        steps = [(rng.choice("suat"), rng.choice((0, 0, 0, 1, 2, 3))) for _ in range(rng.randint(1, 12))]
        whole = {(p, q): w for p in range(4) for q, w in C.span(steps, p).items()}
        spans = None
        for at in range(0, len(steps), block):
            part = {(p, q): w for p in range(4) for q, w in C.span(steps[at:at + block], p).items()}
            spans = part if spans is None else C.join_spans(spans, part)
        assert spans == whole


def test_repaired_rows_and_empty_table(spark):
    rows = [(1, 0, "user", "Hi there."), (1, 1, "user", "Hm?"), (2, 0, "assistant", "Bye.")]
    done = C.repair(spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA))
    got = sorted((r["conv"], r["pos"], r["edit"], r["role"], r["text"]) for r in done.rows.collect())
    assert got == [(1, 0, "K", "user", "Hi there."), (1, 1, "R", "assistant", "Hm?"), (2, 0, "I", "user", ""), (2, 1, "K", "assistant", "Bye.")]
    assert {r["conv"]: (r["cost"], r["audit"]) for r in done.report.collect()} == {1: (3, "KR"), 2: (3, "IK")}
    assert C.repair_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_lost_conversations_keep_their_row(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256().hexdigest()
    assert run(spark, [(lost, 0, "user", "Gone.")]) == {lost: (0, 0, 0, 0, 0, 0, "", empty)}
