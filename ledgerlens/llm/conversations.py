"""Conversation structure repair: Knuth's lightest-derivation agenda.

A repaired conversation is empty, or an optional system row followed by pairs of a user
and an assistant row. Items are hypergraph vertices: ``(i, q)`` says that the first i rows
of a block are dealt with and the grammar is in state q; ``(p, q)`` says that a whole span
leads from p to q. Deductions are the edits of a row (one antecedent) and the joining of two
spans (two antecedents). A weight is (cost, audit): the audit lists the initials of the
edits, so all functions are monotone and superior and the agenda may finalise the item it
pops. Of equal costs the ASCII-least audit wins; two audits of one item and one cost are never
prefixes of each other, as equal edits of equal rows cost the same.

Conversations of any length: rows are sorted by range over all tasks and cut into blocks of
``BLOCK`` rows, whose spans are joined in a balanced tree, so a conversation that holds a
third of all rows is shared by many tasks. What stays together is its audit, a string of one
letter per edit, and the digest of its text, which is read as a stream.

A null role or text is one space, a null conversation id is a conversation of its own, null
turns come first. Rows of one turn are taken by role, then by a digest of the text; equal rows
collapse and are counted. An empty role can't be kept. Empty tables give empty results; texts
of any length are only hashed; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Hashable, Iterable, Iterator
from heapq import heappop, heappush
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import WHITE, map_rows, stored

BLOCK = 256
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the grammar: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = (USER, USER, ASSISTANT, USER)
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL, LETTERS = ("su", "ua", "au"), ("s", "u", "a")
#: What a row suffers from.
SOUND, BLANK, DUPLICATE, CUT = range(4)

Weight = tuple[int, str]


def lightest(axioms: Iterable[tuple[Hashable, Weight]], deduce: Callable[[Hashable, dict], Iterable[tuple[Hashable, Weight]]],
             goal: Hashable = None) -> dict[Hashable, Weight]:
    """The lightest derivation of every item up to the goal (of all items without one).

    ``deduce(item, done)`` gives the conclusions that the item and finalised others now allow.
    """
    agenda: list = []
    for item, weight in axioms:
        heappush(agenda, (weight, item))
    done: dict[Hashable, Weight] = {}
    while agenda:
        weight, item = heappop(agenda)
        if item in done:
            continue
        done[item] = weight
        if item == goal:
            break
        for found, heavier in deduce(item, done):
            if found not in done:
                heappush(agenda, (heavier, found))
    return done


def span(steps: list[tuple[str, int]], entry: int) -> dict[int, Weight]:
    """The lightest weight by exit state of a block of (role initial, fault) rows, entered in a state."""
    n = len(steps)

    def deduce(item, done):
        (i, q), (cost, audit) = item, done[item]
        yield (i, FOLLOWS[q]), (cost + INSERT, audit + "I")
        if i < n:
            initial, fault = steps[i]
            yield (i + 1, q), (cost + DELETE, audit + "D")
            if fault in (SOUND, CUT):
                cost += TRUNCATED * (fault == CUT)
                yield (i + 1, FOLLOWS[q]), (cost + REROLE, audit + "R")
                if (q, initial) in KEEPS:
                    yield (i + 1, KEEPS[q, initial]), (cost, audit + "K")

    done = lightest([((0, entry), (0, ""))], deduce)
    return {q: done[n, q] for q in range(4) if (n, q) in done}


def join_spans(left: dict, right: dict) -> dict:
    """Spans (p, q) and (q, r) of two neighbours to those of both."""

    def deduce(item, done):
        side, p, q = item
        if side < 2:
            for r in range(4):
                ends = ((0, p, q), (1, q, r)) if side == 0 else ((0, r, p), (1, p, q))
                if ends[0] in done and ends[1] in done:
                    (c, a), (d, b) = done[ends[0]], done[ends[1]]
                    yield (2, ends[0][1], ends[1][2]), (c + d, a + b)

    axioms = [((side, *k), w) for side, spans in enumerate((left, right)) for k, w in spans.items()]
    return {k[1:]: w for k, w in lightest(axioms, deduce).items() if k[0] == 2}


def best(spans: dict) -> Weight:
    """The weight of the goal: from the start to an accepting state."""
    ends = [((0, q), spans[START, q]) for q in (START, ASSISTANT) if (START, q) in spans]
    return lightest(ends, lambda item, done: [((1, 0), done[item])] if item[0] == 0 else [], (1, 0))[1, 0]


def _key(*parts: Column) -> Column:
    """A digest of texts that are told apart whatever characters they hold."""
    return F.unhex(F.sha2(F.concat(*(c for p in parts for c in (F.length(p).cast("string"), F.lit(":"), p))), 256))


def _faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, key, fault, n): equal rows once with their number; ``fault`` is that of the first."""
    tail = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    slim = rows.select("conv", "turn", "role", "key", _key(F.col("role"), F.col("text")).alias("said"),
                       F.when(tail == "", BLANK).when(~tail.isin(".", "!", "?"), CUT).otherwise(SOUND).alias("fault"))
    slim = slim.groupBy("conv", "turn", "role", "key", "said", "fault").agg(F.count(F.lit(1)).alias("n"))
    slim = stored(slim, "conversation-rows").withColumn("at", F.struct(F.col("turn").isNotNull().alias("has"), "turn"))
    talk = F.concat_ws(":", F.coalesce(F.col("conv").cast("string"), F.lit("")), F.col("conv").isNull().cast("string"))
    firsts = (slim.filter(F.col("fault") != BLANK).groupBy(talk.alias("talk"), "said").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("times"))
              .filter("times > 1").select("talk", "said", "first"))
    seen = slim.withColumn("talk", talk).join(firsts, ["talk", "said"], "left")
    fault = F.when((F.col("fault") != BLANK) & (F.col("at") > F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    return seen.select("conv", "turn", "role", "key", fault.alias("fault"), "n")


class _Block:
    """Rows of one conversation in order, up to ``BLOCK`` of them."""

    def __init__(self, conv, seq: int, inner: bool):
        self.conv, self.seq, self.inner = conv, seq, inner
        self.steps, self.keys, self.roles = [], [], []
        self.turns, self.counts, self.illegal = [], [0, 0, 0, 0], 0

    def add(self, turn, role: str, key: bytes | None, fault: int) -> None:
        initial = role[:1]
        self.illegal += bool(self.steps) and self.steps[-1][0] + initial not in LEGAL
        self.steps.append((initial, fault))
        self.keys.append(key)
        self.roles.append(role)
        self.counts[fault] += 1
        if turn is not None and self.turns[-1:] != [turn]:
            self.turns.append(turn)

    def row(self, part: int) -> dict:
        """``inner``: the conversation may begin earlier, so the block may be entered in any state."""
        spans = [{"p": p, "q": q, "cost": c, "audit": a} for p in (range(4) if self.inner else (START,)) for q, (c, a) in span(self.steps, p).items()]
        return {"conv": self.conv, "part": part, "seq": self.seq, "spans": spans, "keys": self.keys, "roles": self.roles,
                "initials": "".join(i if i in LETTERS else "?" for i, _ in self.steps), "first": self.steps[0][0], "last": self.steps[-1][0], "illegal": self.illegal, "blank": self.counts[BLANK],
                "duplicate": self.counts[DUPLICATE], "truncated": self.counts[CUT], "turns": len(self.turns),
                "low": self.turns[0] if self.turns else None, "high": self.turns[-1] if self.turns else None}


BLOCKS = ("conv {conv}, part int, seq bigint, spans array<struct<p: int, q: int, cost: bigint, audit: string>>, keys array<binary>, roles array<string>, "
          "initials string, first string, last string, illegal bigint, blank bigint, duplicate bigint, truncated bigint, turns bigint, low bigint, high bigint")
PLANS = ("conv {conv}, part int, seq bigint, slice string, state int, pos bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, "
         "illegal bigint, cost bigint, audit string")


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _emitter(schema: str, make: Callable[[Iterator[dict]], Iterator[dict]], most: int = 64) -> Callable:
    """A task over the rows of its batches in order, as dicts; output in batches of at most ``most`` rows."""
    arrow = _arrow(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for row in make(r for b in batches for at in range(0, b.num_rows, 256) for r in b.slice(at, 256).to_pylist()):
            out.append(row)
            if len(out) >= most:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return task


def _cut_blocks(rows: Iterator[dict]) -> Iterator[dict]:
    from pyspark import TaskContext

    part, block, first = TaskContext.get().partitionId(), None, True
    for r in rows:
        if block is not None and r["conv"] != block.conv:
            yield block.row(part)
            block, first = None, False
        for k in range(r["n"]):
            if block is None or len(block.steps) >= BLOCK:
                if block is not None:
                    yield block.row(part)
                seq = 0 if block is None else block.seq + 1
                block = _Block(r["conv"], seq, first or seq > 0)
            fault = r["fault"] if k == 0 or r["fault"] == BLANK else DUPLICATE
            block.add(r["turn"], r["role"], r["key"] if fault in (SOUND, CUT) else None, fault)
    if block is not None:
        yield block.row(part)


def _plan(rows: Iterator[dict]) -> Iterator[dict]:
    """Blocks in order to their parts of the cheapest audit; the first carries the report of its conversation."""
    for conv, blocks in groupby(rows, key=lambda r: r["conv"]):
        tree: list[tuple[int, dict]] = []  # spans of 1, 2, 4, ... blocks, the largest first
        parts, total, last, high, low, turns = [], dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), None, None, None, 0
        for b in blocks:
            parts.append((b["part"], b["seq"], b["initials"]))
            for k in total:
                total[k] += b[k]
            total["illegal"] += last is not None and last + b["first"] not in LEGAL
            last = b["last"]
            turns += b["turns"] - (b["low"] is not None and b["low"] == high)
            low, high = b["low"] if low is None else low, high if b["high"] is None else b["high"]
            node = (1, {(s["p"], s["q"]): (s["cost"], s["audit"]) for s in b["spans"]})
            while tree and tree[-1][0] <= node[0]:
                size, left = tree.pop()
                node = (size + node[0], join_spans(left, node[1]))
            tree.append(node)
        spans = tree.pop()[1]
        while tree:
            spans = join_spans(tree.pop()[1], spans)
        cost, audit = best(spans)
        report = {"cost": cost, "audit": audit, "gaps": 0 if low is None else high - low + 1 - turns, **total}
        at, state, pos = 0, START, 0
        for k, (part, seq, initials) in enumerate(parts):
            begin, entry, first, step = at, state, pos, 0
            while step < len(initials) or (k == len(parts) - 1 and at < len(audit)):
                edit = audit[at]
                if edit != "D":
                    state, pos = _next(state, edit, initials[step:step + 1]), pos + 1
                step += edit != "I"
                at += 1
            yield {"conv": conv, "part": part, "seq": seq, "slice": audit[begin:at], "state": entry, "pos": first, **(report if k == 0 else {})}


def _next(state: int, edit: str, initial: str) -> int:
    return KEEPS[state, initial] if edit == "K" else FOLLOWS[state]


def _replay(conv, plan: str, state: int, pos: int, keys: list, roles: list) -> Iterator[tuple]:
    """(conv, pos, edit, role, key) of the rows that a block keeps or inserts."""
    step = 0
    for edit in plan:
        if edit != "D":
            role = "" if edit == "I" else roles[step]
            state = _next(state, edit, role[:1])
            yield conv, pos, edit, role if edit == "K" else ROLES[state], None if edit == "I" else keys[step]
            pos += 1
        step += edit != "I"


class Repaired(NamedTuple):
    """``report``: one row per conversation with rows; ``rows``: the rows of the repaired conversations."""

    report: DataFrame
    rows: DataFrame


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repaired:
    """The cheapest repair of every conversation.

    report: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit); rows: (conv, pos, edit, role, text) in the order
    of ``pos`` from 0, an inserted row has an empty text. Texts move once, to the edits that keep them.
    """
    conv_type = rows.schema[conv_col].dataType.simpleString()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = _key(plain("conv"), F.col("conv").isNull().cast("string"), plain("turn"), F.col("turn").isNull().cast("string"), F.col("role"), F.col("text"))
    named = named.withColumn("key", key)

    order = ("conv", "turn", "role", "key")
    ranged = _faults(named).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = BLOCKS.format(conv=conv_type)
    blocks = stored(ranged.mapInArrow(_emitter(schema, _cut_blocks), schema), "conversation-blocks")
    schema = PLANS.format(conv=conv_type)
    light = blocks.drop("keys", "roles").repartition("conv").sortWithinPartitions("conv", "part", "seq")
    plans = stored(light.mapInArrow(_emitter(schema, _plan), schema), "conversation-plans")
    report = plans.filter("audit is not null").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    # a block is named by its task and number there; blocks of several conversations share neither a key nor a null
    same = blocks["conv"].eqNullSafe(plans["conv"]) & (blocks["part"] == plans["part"]) & (blocks["seq"] == plans["seq"])
    planned = plans.join(blocks, same).select(plans["conv"], "slice", "state", "pos", "keys", "roles")
    edits = map_rows(planned, lambda: _replay, f"conv {conv_type}, pos bigint, edit string, role string, key binary")
    texts = named.select("key", "text").dropDuplicates(["key"])
    kept = edits.filter("key is not null").join(texts, "key").select("conv", "pos", "edit", "role", "text")
    return Repaired(report, kept.union(edits.filter("key is null").select("conv", "pos", "edit", "role", F.lit("").alias("text"))))


def _digest(rows: Iterator[dict]) -> Iterator[dict]:
    for conv, turns in groupby(rows, key=lambda r: r["conv"]):
        h = hashlib.sha256()
        for k, r in enumerate(turns):
            h.update(("\n" if k else "").encode() + f"{r['role']}:{r['text']}".encode("utf-8", "surrogatepass"))
        yield {"conv": conv, "sha256": h.hexdigest()}


def digests(rows: DataFrame) -> DataFrame:
    """(conv, sha256) of the newline-joined ``role:text`` of repaired rows, read as a stream in their order."""
    schema = f"conv {rows.schema['conv'].dataType.simpleString()}, sha256 string"
    ordered = rows.select("conv", "pos", "role", "text").repartition("conv").sortWithinPartitions("conv", "pos")
    return ordered.mapInArrow(_emitter(schema, _digest), schema)


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` rows with the faults of a test, chosen by crc32(``conv_id:turn``) % 20: 0 drops the row, 1 empties
    its text, 2 removes its ``.!?``, 3 repeats it, 4 gives it to the user. Nulls are one space before that."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"),
                        (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).alias("fate"))
    changed = dealt.filter("fate <> 0").select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), "fate")
    return changed.withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("fate", "copy")


def repair_report(rows: DataFrame) -> DataFrame:
    """The report of the damaged rows for every conversation id of ``rows``, with the digest of what is repaired."""
    done = repair(damaged(rows))
    named = done.report.withColumnRenamed("conv", "conv_id").alias("r")
    ids = rows.select("conv_id").distinct().alias("i")
    found = ids.join(named, F.col("i.conv_id").eqNullSafe(F.col("r.conv_id")), "left").select("i.conv_id", *(c for c in named.columns if c != "conv_id"))
    sums = digests(done.rows).alias("s")
    found = found.alias("f").join(sums, F.col("f.conv_id").eqNullSafe(F.col("s.conv")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return found.select("f.conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
