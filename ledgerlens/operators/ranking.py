"""Distributed order statistics: row numbers, running sums and exact quantiles.

A window ``over (order by x)`` without a partition key pulls every row into one task. The operators
here give the same exact answers with the work spread out:

1. rows are partitioned by range on the group and the order columns themselves (any types, several
   columns, nulls first), sorted within their partition and written once with their partition and
   their place in it, so that no later pass can cut the ranges elsewhere;
2. the rows of each partition are counted, a table of one row per partition;
3. a row's place overall is the rows of the partitions before its own, and its place in it.

A tie column after a hot value spreads that value over several partitions. Results don't depend on
where the ranges are cut.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import written

#: ``monotonically_increasing_id`` holds the place within the partition in its lower bits.
PLACE_BITS = 33


def ranged(df: DataFrame, order_cols: list[Column | str], group_cols: list[str] | None = None) -> DataFrame:
    """The rows in order by group and order columns, written, with ``_part`` and their place ``_at`` in it."""
    keys = [*(group_cols or []), *order_cols]
    d = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return written(d.withColumns({"_part": F.spark_partition_id(), "_at": place}), "ranged")


def _offsets(d: DataFrame) -> DataFrame:
    """(_part, _off, _all): rows before each partition and rows overall; at most ``spark.sql.shuffle.partitions`` rows."""
    c = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")
    return c.select("_part", before.alias("_off"), F.sum("_c").over(Window.partitionBy()).alias("_all"))


def _group_join(left: DataFrame, right: DataFrame, keys: list[str], group_cols: list[str]) -> DataFrame:
    """Inner join on ``keys`` and the group columns, in which a null group meets itself; ``right`` is a written table, so Spark knows its size."""
    group = F.struct(*group_cols) if group_cols else F.lit(0)
    named = right.withColumn("_grp", group).drop(*group_cols)
    return left.withColumn("_grp", group).join(named, [*keys, "_grp"]).drop("_grp")


def row_number(df: DataFrame, order_cols: list[Column | str], group_cols: list[str] | None = None, out: str = "rn",
               total: str | None = None) -> DataFrame:
    """Exact ``row_number() over (partition by group order by order_cols)``, 1-based; ``total`` adds the rows of the group.

    Rows that agree in all order columns are numbered in any order. One shuffle; the rest are joins to
    one row per partition (broadcast, its size is bounded) and one row per group.
    """
    g = list(group_cols or [])
    d = ranged(df, order_cols, g)
    offs = F.broadcast(_offsets(d))
    if not g:
        d = d.join(offs, "_part").withColumn(out, F.col("_off") + F.col("_at") + 1)
        return (d.withColumn(total, F.col("_all")) if total else d).drop("_part", "_at", "_off", "_all")
    heads = d.groupBy(*g).agg(F.min(F.struct("_part", "_at")).alias("_h"), F.count(F.lit(1)).alias("_n"))
    heads = heads.join(offs, F.col("_h._part") == F.col("_part")).select(*g, (F.col("_off") + F.col("_h._at")).alias("_start"), "_n")
    d = _group_join(d, written(heads, "heads"), [], g).join(offs, "_part")
    d = d.withColumn(out, F.col("_off") + F.col("_at") - F.col("_start") + 1)
    return (d.withColumn(total, F.col("_n")) if total else d).drop("_part", "_at", "_off", "_all", "_start", "_n")


def running_sums(df: DataFrame, order_col: str, value_cols: list[str], group_cols: list[str] | None = None, descending: bool = True,
                 prefix: str = "cum_", totals: bool = False, lower_col: str | None = None, lower_values: bool = False) -> DataFrame:
    """Inclusive running sums of ``value_cols`` in ``order_col`` order, per group.

    Rows sharing an order value are summed together (range frame), which is the
    curve semantics when the input is pre-aggregated per distinct value.
    ``totals`` adds ``tot_<c>`` (group totals); ``lower_col`` names a column with
    the next lower ``order_col`` value in the group (null for the lowest), and ``lower_values``
    adds its row's values as ``<lower_col>_<c>``.
    """
    g = list(group_cols or [])
    d = ranged(df, [order_col], g)
    row = F.struct(order_col, *value_cols)
    tot = d.groupBy("_part", *g).agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(value_cols)], F.max(row).alias("_mx"))
    whole, up = Window.partitionBy(*g), Window.partitionBy(*g).orderBy("_part")
    run = Window.partitionBy(*g).orderBy(F.col("_part").desc()) if descending else up
    sel = ["_part", *g, *[(F.sum(f"_t{i}").over(run) - F.col(f"_t{i}")).alias(f"_o{i}") for i in range(len(value_cols))]]
    if totals:
        sel += [F.sum(f"_t{i}").over(whole).alias(f"tot_{c}") for i, c in enumerate(value_cols)]
    if lower_col:
        sel.append(F.lag("_mx").over(up).alias("_below"))
    d = _group_join(d, written(tot.select(*sel), "offsets"), ["_part"], g)
    local = Window.partitionBy("_part", *g).orderBy(F.col(order_col).desc() if descending else F.col(order_col).asc())
    frame = local.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cols = {f"{prefix}{c}": F.sum(c).over(frame) + F.col(f"_o{i}") for i, c in enumerate(value_cols)}
    if lower_col:
        below = F.coalesce((F.lead if descending else F.lag)(row).over(local), F.col("_below"))
        cols[lower_col] = below.getField(order_col)
        if lower_values:
            cols |= {f"{lower_col}_{c}": below.getField(c) for c in value_cols}
    return d.withColumns(cols).drop("_part", "_at", "_below", *[f"_o{i}" for i in range(len(value_cols))])


def exact_quantiles(df: DataFrame, col: str, probs: list[float]) -> list[float]:
    """Exact linear-interpolated quantiles (numpy 'linear') of a numeric column; nulls and NaN ignored.

    Values collapse to (value, count) map-side, so a hot value costs one row. The value at a rank is the
    least one whose running count passes it: one aggregation over the running counts for all ranks.
    """
    v = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    run = running_sums(v.groupBy("v").agg(F.count(F.lit(1)).alias("c")), "v", ["c"], descending=False, totals=True)
    last = F.col("tot_c") - 1
    aggs = [F.max("tot_c").alias("n")]
    for i, q in enumerate(probs):
        low = F.floor(F.lit(float(q)) * last)
        aggs += [F.min(F.when(F.col("cum_c") > low, F.col("v"))).alias(f"lo{i}"),
                 F.min(F.when(F.col("cum_c") > F.least(low + 1, last), F.col("v"))).alias(f"hi{i}")]
    row = run.agg(*aggs).first()
    if not row["n"]:
        raise ValueError(f"no numeric values in {col!r}")
    out = []
    for i, q in enumerate(probs):
        at = float(q) * (row["n"] - 1)
        out.append(row[f"lo{i}"] + (row[f"hi{i}"] - row[f"lo{i}"]) * (at - math.floor(at)))
    return out
