"""Class counts, class weights, per-row sample weights and stratified splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.ranking import row_number

MAX_CLASSES = 10_000  # class tables are broadcast / inlined; checked against this bound


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per class; a null label is its own class (``dropna=False``)."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def balanced_weights(df: DataFrame, label: str, *, fixed_k: int | None = None,
                     floor_one: bool = False) -> DataFrame:
    """``n / (k * count_c)`` per non-null class; ``n`` counts null-label rows too.

    ``fixed_k=2, floor_one=True`` gives the chunked form (k fixed, count at least 1).
    The class table has one row per class, so its totals come from a window over
    that tiny table.
    """
    all_classes = Window.partitionBy()  # the class table has one row per class (tiny)
    cc = class_counts(df, label).select(
        "label", "n", F.sum("n").over(all_classes).alias("_n"),
        F.count_if(F.col("label").isNotNull()).over(all_classes).alias("_k"))
    k = F.lit(float(fixed_k)) if fixed_k else F.col("_k").cast("double")
    cnt = F.greatest(F.col("n"), F.lit(1)) if floor_one else F.col("n")
    return cc.filter(F.col("label").isNotNull()).select("label", (F.col("_n") / (k * cnt)).alias("weight"))


def label01_counts(df: DataFrame, label: str) -> DataFrame:
    """Chunked form: only labels 0 and 1 are counted (one row: n0, n1)."""
    y = F.col(label)
    return df.agg(F.count_if(y == 0).alias("n0"), F.count_if(y == 1).alias("n1"))


def balanced_weights_01(df: DataFrame, label: str) -> DataFrame:
    """Chunked form of balanced weights: k fixed at 2, counts floored at 1,
    n = n0 + n1 (other labels ignored). One aggregation, two output rows."""
    c = label01_counts(df, label)
    n = F.col("n0") + F.col("n1")
    return c.select(F.explode(F.array(
        F.struct(F.lit(0).alias("label"), (n / (2.0 * F.greatest(F.col("n0"), F.lit(1)))).alias("weight")),
        F.struct(F.lit(1).alias("label"), (n / (2.0 * F.greatest(F.col("n1"), F.lit(1)))).alias("weight")),
    )).alias("w")).select("w.*")


def inverse_weights(counts: DataFrame) -> DataFrame:
    """``total / count`` per class (0 for a zero count); total over all classes."""
    tot = F.sum("n").over(Window.partitionBy())  # one row per class (tiny)
    return counts.select("label", F.when(F.col("n") == 0, F.lit(0.0))
                         .otherwise(tot / F.col("n")).alias("weight"))


def weight_map(weights: DataFrame) -> dict[int, float]:
    """Collect a (label, weight) table after a size check; keys normalised to int."""
    rows = weights.limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError("too many classes for a weight table")
    return {int(float(r["label"])): float(r["weight"]) for r in rows if r["label"] is not None}


def sample_weights(df: DataFrame, label: str, weights: dict[int, float] | None,
                   out: str = "weight") -> DataFrame:
    """Per-row weight from the class table, default 1.0; no table → unweighted (1.0).

    The table is inlined as a CASE expression (bounded by ``MAX_CLASSES``), so
    this is a projection: no join, no shuffle.
    """
    if not weights:
        return df.withColumn(out, F.lit(1.0))
    lab = F.col(label).cast("int")
    e = None
    for k, w in sorted(weights.items()):
        e = (F.when(lab == F.lit(k), F.lit(float(w))) if e is None
             else e.when(lab == F.lit(k), F.lit(float(w))))
    return df.withColumn(out, e.otherwise(F.lit(1.0)))


def hash_order_key(id_col: str, seed: int) -> Column:
    """Seeded pseudo-random order: md5 of ``id|seed``."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))


def stratified_split(df: DataFrame, id_col: str, label: str, frac: float = 0.2, seed: int = 42,
                     out: str = "part") -> DataFrame:
    """Exactly ``round(frac * n_c)`` rows of each class go to ``val``, the rest (and null labels) to ``fit``.

    Rows are ranked per class in a seeded hash order with the distributed
    row number (no whole class in one task), which counts the class as well.
    """
    ranked = row_number(df.withColumn("_h", hash_order_key(id_col, seed)), ["_h", id_col], [label], out="_rn", total="_rows")
    quota = F.when(F.col(label).isNull(), 0).otherwise(F.floor(F.lit(frac) * F.col("_rows") + F.lit(0.5)))
    return ranked.withColumn(out, F.when(F.col("_rn") <= quota, "val").otherwise("fit")).drop("_h", "_rn", "_rows")


def row_index(df: DataFrame, key: str, out: str = "row_idx") -> DataFrame:
    """Contiguous 0-based index in ``key`` order (exact, distributed)."""
    return row_number(df, [key], out=out).withColumn(out, F.col(out) - 1)
