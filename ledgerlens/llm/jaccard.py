"""N-gram Jaccard join: vertical partitioning of the global n-gram order.

A document is the set of its word n-grams; equal sets collapse first. The n-grams that two sets
share are put in one global order, rarest first (by the octave of their document frequency, then
by hash). The order is cut into ``FRAGMENTS`` of equal weight, every set into segments by them;
the overlap of a pair is counted per fragment and summed.

Which pairs are counted follows from the prefix principle: sets that link share an n-gram among
the rarest few of each. Two steps keep that from becoming all pairs of a group:

* Sets that can have no partner leave before anything large moves: among its smallest hashes (15 %
  and a few more) a set must share so many with others (an l-prefix; the bound is exact).
* In a group of sets that share a rare n-gram, each is first counted against the hub, the set with
  the fewest rarer n-grams. Only pairs that the links so found leave in different components are
  then counted. Both steps skip a pair in a group unless its sizes and what follows the shared
  n-gram allow a link, were it their first common one; as it is that in one group, no link between
  components is lost, and a group of copies costs about its size, not its square.

N-grams are 64-bit hashes of their words, sets are named by 128 bits of their n-grams.

A text without words has an empty set and links with nothing; a text of fewer words than n is one
n-gram. Rows without an id take part; a component without ids has a null one. Repeated rows each
get their row; empty tables give empty results; extra columns aren't read. A very long text is
hashed as a whole in one task, eight bytes a word.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import as_bytes, map_rows, stored
from ledgerlens.llm.components import components

SHINGLE, PERCENT, FRAGMENTS = 4, 85, 16
#: How many word hashes a task remembers.
HELD = 1 << 20
#: Cells of the global order: octaves of frequency, each cut by the first bits of the hash.
CELLS = 256


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (multiply, shift, exclusive-or)."""
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA3B195354A39B70D)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Texts to their sorted sets of n-gram hashes (ASCII letters lower-cased)."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def _word(self, w: bytes) -> int:
        h = self.known.get(w)
        if h is None:
            if len(self.known) >= HELD:
                self.known.clear()
            h = self.known[w] = xxhash.xxh3_64_intdigest(w)
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        words = as_bytes(text).lower().split()
        h = np.fromiter(map(self._word, words), np.uint64, len(words))
        size = min(self.size, len(words))
        if not size:
            return h
        out = np.full(len(words) - size + 1, size, np.uint64)
        for k in range(size):
            out = _mixed(out * np.uint64(0x9FB21C651E98DF25) + h[k:k + len(out)])
        return np.unique(out)


def least_part(n: int, percent: int) -> int:
    """The least size of a set that links with one of n, and the least overlap of the two."""
    return -(-percent * n // 100)


def _depth(n):
    """How many n-grams of their prefixes two linked sets of at least n share at least."""
    return 1 + n // 20


def prints(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """(id, n, sid, key, few, need) for every row: size and name of its set, digest of its text, its smallest hashes."""
    def make():
        sets = Shingler(shingle)

        def f(i, text, key):
            s = sets(text)
            n = len(s)
            part = least_part(n, percent)
            few = s[:n - part + _depth(n)].view(np.int64).tolist() if n else []
            return [(i, n, xxhash.xxh3_128_digest(s.astype("<u8").tobytes()), key, few, _depth(part))]
        return f

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.unhex(F.md5(F.col(text_col))).alias("key"))
    return map_rows(rows, make, f"id {docs.schema[id_col].dataType.simpleString()}, n bigint, sid binary, key binary, few array<bigint>, need bigint", 512)


def _hopeful(sets: DataFrame) -> DataFrame:
    """(sid, n, key) of the sets (sid, n, key, few, need) that share enough of their smallest hashes with others."""
    rows = sets.select(F.xxhash64("sid").alias("s"), F.explode("few").alias("h"))
    shared = rows.groupBy("h").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("h")
    hits = stored(rows.join(shared, "h").groupBy("s").agg(F.count(F.lit(1)).alias("hits")), "ngram-hits")
    named = sets.select("sid", "n", "key", "need", F.xxhash64("sid").alias("s"))
    return named.join(hits, "s").filter("hits >= need").select("sid", "n", "key")


def _ordered(docs: DataFrame, sets: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(sid, n, grams): the n-grams that a set shares with any other, as (octave, h) in the global order."""
    def make():
        shingler = Shingler(shingle)
        return lambda sid, n, text: [(sid, n, shingler(text).view(np.int64).tolist())]

    texts = docs.select(F.col(text_col).alias("t"), F.unhex(F.md5(F.col(text_col))).alias("key"))
    wanted = texts.join(sets, "key").select("sid", "n", "t")
    full = map_rows(wanted, make, "sid binary, n bigint, grams array<bigint>", 512)
    full = stored(full.groupBy("sid", "n").agg(F.first("grams").alias("grams")), "ngram-sets")
    each = full.select("sid", "n", F.explode("grams").alias("h"))
    often = each.groupBy("h").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    octave = F.floor(F.log2("sets")).cast("int").alias("octave")
    return each.join(often, "h").groupBy("sid", "n").agg(F.sort_array(F.collect_list(F.struct(octave, "h"))).alias("grams"))


def _cell(gram: Column) -> Column:
    return gram["octave"] * CELLS + (F.shiftright(gram["h"], 56) + CELLS // 2).cast("int")


def _segments(ordered: DataFrame, fragments: int) -> DataFrame:
    """(sid, fragment, hs): the sets cut by fragments of the order that hold about as many n-grams each."""
    weight = ordered.select(F.explode(F.transform("grams", _cell)).alias("cell")).groupBy("cell").count().collect()  # at most 64 octaves of CELLS
    total, so_far, cuts = sum(w["count"] for w in weight), 0, []
    for cell, count in sorted(weight):
        if so_far * fragments >= total * (len(cuts) + 1):
            cuts.append(cell)
        so_far += count
    edges = [-1, *cuts, 1 << 30]

    def part(k: int) -> Column:
        inside = F.filter("grams", lambda g: (_cell(g) >= edges[k]) & (_cell(g) < edges[k + 1]))
        return F.struct(F.lit(k).alias("fragment"), F.transform(inside, lambda g: g["h"]).alias("hs"))

    parts = [part(k) for k in range(len(edges) - 1)]
    return ordered.select("sid", F.explode(F.array(*parts)).alias("p")).select("sid", "p.fragment", "p.hs").filter(F.size("hs") > 0)


def _postings(ordered: DataFrame, percent: int) -> DataFrame:
    """(h, sid, n, rank) of the rarest n-grams of every set; n-grams that no other set has come before all others."""
    part = F.ceil(F.col("n") * percent / 100)
    part = F.when((part - 1) * 100 >= F.col("n") * percent, part - 1).otherwise(part)  # the quotient is a double
    alone = F.col("n") - F.size("grams")
    take = (F.col("n") - part + 1 - alone).cast("int")
    kept = ordered.filter(take > 0).select("sid", "n", alone.alias("alone"), F.posexplode(F.slice("grams", F.lit(1), take)).alias("at", "gram"))
    return kept.select(F.col("gram.h").alias("h"), "sid", "n", (F.col("alone") + F.col("at") + 1).alias("rank"))


def _fits(percent: int) -> Column:
    """Whether two sets may link: their sizes allow it, and so does what follows an n-gram they share, if it is their first common one."""
    u, v = F.col("u_n"), F.col("v_n")
    most = F.least(u - F.col("u_rank"), v - F.col("v_rank")) + 1
    return (u * 100 >= v * percent) & (v * 100 >= u * percent) & (most * (100 + percent) >= (u + v) * percent)


def _linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """(u, v) of those pairs (u, v, u_n, v_n) whose overlaps, counted per fragment and summed, reach the threshold."""
    left = segments.select(F.col("sid").alias("u"), "fragment", F.col("hs").alias("left"))
    right = segments.select(F.col("sid").alias("v"), "fragment", F.col("hs").alias("right"))
    partial = pairs.join(left, "u").join(right, ["v", "fragment"]).select("u", "v", "u_n", "v_n", F.size(F.array_intersect("left", "right")).alias("part"))
    summed = partial.groupBy("u", "v", "u_n", "v_n").agg(F.sum("part").alias("both"))
    return summed.filter(F.col("both") * (100 + percent) >= (F.col("u_n") + F.col("v_n")) * percent).select("u", "v")


def _hub(*more: str) -> Column:
    """The set of a group in which the n-gram comes earliest: it has the fewest rarer ones, as the text that others were copied from."""
    return F.min(F.struct("rank", "sid", *more))


def _stars(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs of every set with the hub of each group it is in."""
    hub = postings.groupBy("h").agg(_hub("n").alias("c"))
    met = postings.join(hub, "h").select(F.col("c.sid").alias("u"), F.col("sid").alias("v"), F.col("c.n").alias("u_n"), F.col("n").alias("v_n"),
                                         F.col("c.rank").alias("u_rank"), F.col("rank").alias("v_rank"))
    return met.filter((F.col("u") != F.col("v")) & _fits(percent)).select("u", "v", "u_n", "v_n").distinct()


def _across(postings: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """All other pairs that may link: those of a group whose components differ, if their first common n-gram leaves room.

    Of two such sets one is outside the component of the group's hub, so the pairs are those of the sets outside.
    """
    named = postings.join(roots.withColumnsRenamed({"node": "sid"}), "sid", "left").select("h", "sid", "n", "rank", F.coalesce("root", "sid").alias("root"))
    named = stored(named, "ngram-postings")
    home = named.groupBy("h").agg(_hub("root")["root"].alias("home"))
    away = named.join(home, "h").filter("root <> home").select("h", *(F.col(c).alias(f"u_{c}") for c in ("sid", "n", "rank", "root")))
    other = named.join(home, "h").select("h", "home", *(F.col(c).alias(f"v_{c}") for c in ("sid", "n", "rank", "root")))
    met = away.join(other, "h").filter((F.col("u_root") != F.col("v_root")) & _fits(percent))
    met = met.filter((F.col("v_root") == F.col("home")) | (F.col("u_sid") < F.col("v_sid")))
    # a pair may come from either side in different groups
    flip = F.col("u_sid") > F.col("v_sid")
    pick = lambda c, d: F.when(flip, F.col(d)).otherwise(F.col(c))
    return met.select(pick("u_sid", "v_sid").alias("u"), pick("v_sid", "u_sid").alias("v"), pick("u_n", "v_n").alias("u_n"), pick("v_n", "u_n").alias("v_n")).distinct()


def set_links(docs: DataFrame, sets: DataFrame, text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """(u, v) between distinct sets (sid, n, key, few, need) of ``docs`` that link, up to transitivity."""
    hopeful = stored(_hopeful(sets), "ngram-hopeful")
    ordered = stored(_ordered(docs, hopeful, text_col, shingle), "ngram-ordered")
    postings = stored(_postings(ordered, percent), "ngram-prefixes")
    often = postings.groupBy("h").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("h")
    postings = stored(postings.join(often, "h"), "ngram-postings")
    candidates = postings.select("sid").distinct()
    segments = stored(_segments(ordered.join(candidates, "sid", "left_semi"), fragments), "ngram-segments")
    stars = stored(_linked(stored(_stars(postings, percent), "ngram-stars"), segments, percent), "ngram-star-links")
    roots = stored(components(stars), "ngram-roots")
    across = stored(_across(postings, roots, percent), "ngram-pairs")
    return stars.union(_linked(across, segments, percent))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
                    fragments: int = FRAGMENTS) -> DataFrame:
    """(id, n_shingles, component) for every row: component is the smallest id that links reach, its own included."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    rows = stored(prints(docs, id_col, text_col, shingle, percent), "ngram-prints")
    grouped = rows.filter("n > 0").groupBy("sid", "n", "need").agg(F.min("id").alias("low"), F.min("key").alias("key"), F.first("few").alias("few"))
    sets = stored(grouped, "ngram-distinct")
    root = stored(components(set_links(docs, sets, text_col, shingle, percent, fragments)), "ngram-classes")
    low = sets.select("sid", "low")
    linked = low.join(root.withColumnRenamed("node", "sid"), "sid")
    best = linked.groupBy("root").agg(F.min("low").alias("best"))
    named = low.join(linked.join(best, "root").select("sid", "best"), "sid", "left").select("sid", F.coalesce("best", "low").alias("component"))
    named = stored(named, "ngram-named")
    full = rows.filter("n > 0").select("id", "n", "sid").join(named, "sid").select("id", F.col("n").alias("n_shingles"), "component")
    return full.union(rows.filter("n = 0").select("id", "n", "id"))
