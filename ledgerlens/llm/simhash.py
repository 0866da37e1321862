"""SimHash near-dedup: tiled exact comparison with exclusive-or and bit counts.

Fingerprints that are equal collapse first. Each distinct fingerprint belongs to the
cell of its population counts (set bits in each of its four 16-bit quarters); two
fingerprints within the radius lie in cells whose counts differ by no more than the
radius in sum, so all other pairs of tiles are skipped unseen and no pair is lost.
Large cells are split into tiles of about ``TILE`` fingerprints, so a task never holds
more than two tiles. Tiles meet by an equi-join on the cell; a comparison of two tiles
yields a spanning forest of its links, not all pairs.

A null or empty text has no words and fingerprint 0, linked like any other. Rows with
a null id take part; they get the smallest non-null id of their component (null if
there is none). Repeated rows each get their row; extra columns aren't read.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import as_bytes, map_rows, stored
from ledgerlens.llm.components import components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: About how many fingerprints a tile holds, and how many hashes are held at once for a long text.
TILE, HELD = 2048, 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text's word shingles (ASCII letters lower-cased, repeats included)."""
    w = as_bytes(text).lower().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < shingle else list(map(b" ".join, zip(*(w[i:] for i in range(shingle)))))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), HELD):
        h = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams[at:at + HELD]], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) for every row."""
    return map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")),
                    lambda: lambda i, t: [(i, fingerprint(t, shingle))], f"id {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def neighbour_offsets(radius: int) -> list[int]:
    """Half of the cell offsets (and 0) that the radius allows; a cell is its four counts in base 32 (0 to 16 each)."""
    span = range(-radius, radius + 1)
    ball = [d for d in product(span, repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]
    return [((a * 32 + b) * 32 + c) * 32 + d for a, b, c, d in ball]


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles; ``same``: they are one tile."""
    lefts, rights = [], []
    for at in range(0, len(a), 512):
        i, j = np.nonzero(np.bitwise_count(a[at:at + 512, None] ^ b[None, :]) <= radius)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        lefts.append(i)
        rights.append(j if same else j + len(a))
    i, j = np.concatenate(lefts), np.concatenate(rights)
    nodes = a if same else np.concatenate([a, b])
    if len(i) <= len(nodes):
        return nodes[i], nodes[j]
    label = np.arange(len(nodes))
    while True:  # smallest label in reach, with pointer jumping
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[label[moved]]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) between the distinct fingerprints ``fp`` that differ in at most ``radius`` bits, up to transitivity."""
    count = lambda shift: F.bit_count(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(0xFFFF)))
    cell = ((count(48) * 32 + count(32)) * 32 + count(16)) * 32 + count(0)
    of = fps.select("fp", cell.cast("int").alias("cell"))
    per = of.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))  # at most 17 ** 4 rows
    tiles = (of.join(per, "cell").groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int").alias("tile"))
             .agg(F.collect_list("fp").alias("fps")))
    tiles = stored(tiles, "tiles")
    near = F.array(*(F.lit(x) for x in neighbour_offsets(radius)))
    left = tiles.select(F.col("cell").alias("home"), F.col("tile").alias("t"), F.col("fps").alias("a"), F.explode(near).alias("off"))
    left = left.select("t", "a", "off", (F.col("home") + F.col("off")).alias("cell"))
    right = tiles.select("cell", F.col("tile").alias("r"), F.col("fps").alias("b"))
    pairs = left.join(right, "cell").filter((F.col("off") != 0) | (F.col("t") <= F.col("r")))
    pairs = pairs.select("a", "b", ((F.col("off") == 0) & (F.col("t") == F.col("r"))).alias("same"))

    def compare(batches):
        for batch in batches:
            us, vs = [], []
            a_col, b_col, same = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            a_all, b_all = (c.values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (a_col, b_col))
            a_at, b_at = (c.offsets.to_numpy() for c in (a_col, b_col))
            for k, one in enumerate(same):
                u, v = tile_links(a_all[a_at[k]:a_at[k + 1]], b_all[b_at[k]:b_at[k + 1]], one, radius)
                if len(u):
                    us.append(u)
                    vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], names=["u", "v"])

    return pairs.mapInArrow(compare, "u bigint, v bigint")


def _named(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """The stored (id, fp) of every row, and the stored (fp, root, component) of every distinct fingerprint.

    ``root`` names a component by its smallest fingerprint, ``component`` by its smallest id (null if it has none).
    """
    if radius < 0 or radius > 15:
        raise ValueError("radius must be from 0 to 15")
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("id").alias("low")), "distinct-fingerprints")
    root = stored(components(links(distinct, radius)), "roots")
    linked = distinct.join(root, distinct["fp"] == root["node"]).select("fp", "root", "low")
    lows = linked.groupBy("root").agg(F.min("low").alias("best"))
    best = linked.join(lows, "root").select("fp", "root", "best")
    named = distinct.join(best, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.least("low", "best").alias("component"))
    return rows, stored(named, "named")  # both sides of a join by fp are then plain exchanges, of which Spark splits those that copies make large


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component) for every row: component is the smallest id that links reach, its own included."""
    rows, named = _named(docs, id_col, text_col, shingle, radius)
    return rows.join(named, "fp", "left").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component stays: that with the smallest id.

    A component without ids keeps one of its rows, and where the smallest id stands on several rows of a component one of
    those stays, so rows that share an id (or have none) but not the text are judged each by its own text. Only ids travel
    for the decision; texts move only if the ids to drop are too many to broadcast, or for rows that share an id.
    """
    rows, named = _named(docs, id_col, text_col, shingle, radius)
    found = stored(rows.join(named, "fp").select("id", "fp", "root", "component"), "near-duplicates")
    per_id = found.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("component"))
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    drop = stored(per_id.filter("n > 1 or component <> id").select("id", "n"), "to-drop")
    once = row.filter("id is not null").join(drop, "id", "left_anti").select("row")
    shared = stored(drop.filter("n > 1").select("id"), "shared-ids")
    if shared.isEmpty() and found.filter("id is null").isEmpty():
        return once.select("row.*")
    print_of = F.pandas_udf(lambda texts: texts.map(lambda t: fingerprint(t, shingle)), "bigint")
    odd = row.filter("id is null").union(row.join(shared, "id", "left_semi").select("row", "id", "t"))
    odd = odd.select("row", "id", print_of("t").alias("fp")).join(named, "fp").filter(F.col("id").eqNullSafe(F.col("component")))
    rest = odd.groupBy("root").agg(F.first("row").alias("row"))
    return once.union(rest.select("row")).select("row.*")
