"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Only lengths matter for packing, and there are at most ``capacity`` of them, so the
instance is a histogram of at most ``capacity`` rows however many documents there are.
``plan`` solves it on the driver: the dominance reduction of Martello and Toth fixes
sets that no other choice can beat, and best-fit decreasing packs the rest, both on
counts. Its patterns say which ranks of each length lie where; tasks then place their
pieces by rank. Ranks come from counts per (task, length), so no length, however
common, meets in one task.

A null or empty text is one piece, its closing id. Longer documents are cut into full
pieces from their end, so only the first piece may be shorter. Repeated rows and null
ids are packed like any others; an empty table gives an empty result; extra columns
aren't read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import map_rows, stored

CAPACITY, END_ID = 2048, 0


class Encoder:
    """Ids of a byte-level vocabulary file of the tokenizers library, with the file's own treatment of its added tokens.

    Texts of Latin-1 characters without an added token's string go through the same vocabulary as ranks (``ranks_path``), which gives the
    same ids at less cost; all others, whose character classes may differ between the libraries, through the file itself.
    """

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.added = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.quick = None
        if ranks_path and pattern:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.quick is not None and not any(t in text for t in self.added):
            try:
                text.encode("latin-1")
                return self.quick.encode_ordinary(text)
            except UnicodeEncodeError:
                pass
        return self.full.encode(text, add_special_tokens=False).ids


def public_encoder() -> Encoder:
    """The public 50k byte vocabulary, from wherever the machine that runs this has it."""
    import public_tokenizers

    return Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def pieces_of(ids: list[int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids with the closing id; only the first piece may be shorter."""
    a = np.array([*ids, END_ID], "<u4")
    first = len(a) % capacity or capacity
    cuts = [0, *range(first, len(a) + 1, capacity)]
    return [(k, s, e - s, zlib.crc32(a[s:e].tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]


def _fit(r: int, free: list[int]) -> int | None:
    """The largest of the sorted sizes that is at most r."""
    at = bisect_right(free, r)
    return free[at - 1] if at else None


def dominant_set(size: int, left: Counter, sizes: list[int], capacity: int) -> tuple[int, ...] | None:
    """Partners of an item of ``size`` in a sequence that some best packing has, if dominance proves one; ``left`` has the other items.

    A set beats another with the same item if the other's partners fit, in groups, into its own partners.
    """
    room = capacity - size
    free = [s for s in sizes if left[s] > 0]
    one = _fit(room, free)
    if one is None:
        return ()
    if one == room:  # any other partners together fit into this one
        return (one,)
    small = free[0]
    second = small if left[small] > 1 else (free[1] if len(free) > 1 else None)
    if second is None or small + second > room:  # one partner at most
        return (one,)
    third = small if left[small] > 2 else second if left[second] > (1 if second != small else 2) else next((s for s in free if s > second), None)
    if third is not None and small + second + third <= room:
        return None
    best_pair, most_second, pair_of = 0, 0, {}
    for a in free[:bisect_right(free, room)]:  # pairs (a, b), b the largest that goes with a and is no larger
        left[a] -= 1
        b = _fit(min(room - a, a), [s for s in free if left[s] > 0])
        left[a] += 1
        if b is not None:
            best_pair, most_second, pair_of[a] = max(best_pair, a + b), max(most_second, b), b
    if one >= best_pair:
        return (one,)
    if pair_of.get(one, -1) >= most_second:  # the largest partner, with a second no smaller than any pair's second
        return (one, pair_of[one])
    return None


def reduce_instance(counts: Counter, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], Counter]:
    """Fixes dominating sets, largest item first: ([(sizes of a sequence, how many)], what is left)."""
    left, fixed = Counter({s: n for s, n in counts.items() if n > 0}), []
    for size in sorted(left, reverse=True):
        while left[size] > 0:
            sizes = sorted(s for s, n in left.items() if n > 0)
            left[size] -= 1
            partners = dominant_set(size, left, sizes, capacity)
            left[size] += 1
            if partners is None:
                break
            chosen = Counter((size, *partners))
            # the same set stays proven while each of its sizes lasts, if its partners fill the room or nothing else fits;
            # else while enough of each are left, since the proof tells no more than three items of a size (and this one) apart
            exact = sum(partners) == capacity - size or not partners
            lasts = min(left[s] // n for s, n in chosen.items())
            times = lasts if exact else max(1, lasts - 3)
            for s, n in chosen.items():
                left[s] -= n * times
            fixed.append(((size, *partners), times))
    return fixed, +left


def best_fit(counts: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: equal sequences are kept as one pattern and a number."""
    by_room: dict[int, Counter] = defaultdict(Counter)  # room left -> patterns
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if n:
            if not by_room[room]:
                rooms.insert(bisect_left(rooms, room), room)
            by_room[room][pattern] += n

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            room = rooms[at] if at < len(rooms) else capacity
            each = room // size
            if at < len(rooms):
                pattern, have = next(iter(by_room[room].items()))
            else:
                pattern, have = (), n  # new sequences, as many as needed
            whole = min(have, n // each)
            rest = n - whole * each if whole < have and n - whole * each < each else 0
            taken = whole + bool(rest)
            if at < len(rooms):
                by_room[room][pattern] -= taken
                if not by_room[room][pattern]:
                    del by_room[room][pattern]
                    if not by_room[room]:
                        rooms.remove(room)
            put(room - each * size, pattern + (size,) * each, whole)
            if rest:
                put(room - rest * size, pattern + (size,) * rest, 1)
            n -= whole * each + rest
    return [(p, n) for room in by_room for p, n in by_room[room].items()]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: from that rank on, the items of a length fill one place of successive sequences."""
    fixed, left = reduce_instance(Counter(counts), capacity)
    sequence, ranks, rows = 0, Counter(), []
    for pattern, n in fixed + best_fit(left, capacity):
        offset = 0
        for size in pattern:
            rows.append((size, ranks[size], sequence, offset))
            ranks[size] += n
            offset += size
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, make_encoder=public_encoder, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece of each row of ``docs``."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        encode, counts, task = make_encoder(), Counter(), TaskContext.get().partitionId()

        def cut(i, text):
            for piece, start, length, crc in pieces_of(encode(text) if text else [], capacity):
                yield i, piece, start, length, crc, task, counts[length]
                counts[length] += 1

        return cut

    cut = map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), make,
                   f"id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint")
    cut = stored(cut, "pieces")
    per = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = stored(per.withColumn("before", F.coalesce(F.sum("n").over(by), F.lit(0))), "piece-counts")
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = plan(counts, capacity)
    ranked = cut.join(before.select("task", "length", "before"), ["task", "length"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    held = docs.sparkSession.sparkContext.broadcast(places)  # its size depends on the capacity alone

    def place(batches):
        rows = held.value
        low = rows[:, 0] * (1 << 48) + rows[:, 1]
        for b in batches:
            length, rank = (b.column(k).to_numpy() for k in (3, 5))
            at = np.searchsorted(low, length * (1 << 48) + rank, "right") - 1
            sequence = rows[at, 2] + rank - rows[at, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(rows[at, 3])],
                                             names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
