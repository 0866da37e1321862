"""Cross-site line dedup by distinct-site spread (DataFrame functions only).

Lines become 64-bit hashes. One aggregation by hash merges HyperLogLog sketches of the
sites that hold the line. Where the estimate is clearly above or below ``min_sites``
it decides; within the sketch's error band the exact number of distinct sites does.
Lines on ``min_sites`` or more sites are boilerplate and go from every document.

Only hashes, sites and ids are shuffled for counting; map-side merging makes a line
that a third of all rows hold one row a task. The text moves once, to meet the set of
hashes it loses; that join is an ordinary one, so Spark broadcasts or splits it by
the sizes it meets.

Lines are compared with white space trimmed at both ends; blank lines stay. A null
site counts as no site, a null text stays null, a text whose lines all go becomes "".
Repeated rows and shared or null ids are fine: the set of lines to remove is global.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import WHITE, stored

MIN_SITES = 10
#: HyperLogLog registers as a power of two; its relative standard error is 1.04 / sqrt(2 ** LG_K).
LG_K = 10


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line, F.lit(WHITE)))


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    line = docs.select(F.col(id_col).alias("id"), F.col(site_col).cast("string").alias("site"), F.explode(F.split(F.col(text_col), "\n")).alias("line"))
    return line.filter(F.trim("line", F.lit(WHITE)) != "").select("id", "site", _key(F.col("line")).alias("h"))


def site_spread(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(h, n_rows, sites, exact): lines on ``min_sites`` or more sites; ``sites`` is exact near the threshold, else the estimate."""
    band = 4 * 1.04 / 2 ** (lg_k / 2)
    sketched = (lines.filter(F.col("site").isNotNull()).groupBy("h")
                .agg(F.count(F.lit(1)).alias("n_rows"), F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
                .filter(F.col("n_rows") >= min_sites)
                .select("h", "n_rows", F.hll_sketch_estimate("sketch").alias("sites")))
    sketched = stored(sketched.filter(F.col("sites") >= min_sites * (1 - band) - 1), "line-spread")
    near = F.col("sites") <= min_sites * (1 + band) + 1
    exact = (lines.filter(F.col("site").isNotNull()).join(sketched.filter(near).select("h"), "h", "left_semi")
             .groupBy("h", "site").agg(F.count(F.lit(1)).alias("k"))
             .groupBy("h").agg(F.sum("k").alias("n_rows"), F.count(F.lit(1)).alias("sites"))
             .filter(F.col("sites") >= min_sites).withColumn("exact", F.lit(True)))
    return sketched.filter(~near).withColumn("exact", F.lit(False)).unionByName(exact)


def boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> tuple[DataFrame, DataFrame]:
    """The stored (id, site, h) rows of all lines, and the stored boilerplate table of ``site_spread``."""
    lines = stored(_lines(docs, id_col, text_col, site_col), "lines")
    return lines, stored(site_spread(lines, min_sites), "boilerplate")


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``row`` (all columns of ``docs``), ``kept_text``, ``n_lines`` and ``n_removed``; one row for each row of ``docs``."""
    lines, bad = boilerplate(docs, id_col, text_col, site_col, min_sites)
    gone = lines.join(bad.select("h"), "h", "left_semi").groupBy("id").agg(F.collect_set("h").alias("gone"))
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    both = row.join(gone, row["id"].eqNullSafe(gone["id"]), "left").select("row", "t", "gone")
    parts = both.withColumn("lines", F.split("t", "\n"))
    gone_col = F.col("gone")
    left = F.when(gone_col.isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains(gone_col, _key(x)) | (F.trim(x, F.lit(WHITE)) == "")))
    parts = parts.withColumn("left", left)
    return parts.select("row", F.when(gone_col.isNull(), F.col("t")).otherwise(F.array_join("left", "\n")).alias("kept_text"),
                        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
                        F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).cast("long").alias("n_removed"))
