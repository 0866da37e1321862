"""Registered queries: scan, coercion, chronological split, fit/apply features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import prep
from ledgerlens.plans.registry import CALIB, EMBARGO, SPLIT_SQL, TEST, TXN_SQL, register
from ledgerlens.session import scratch_path
from ledgerlens.sources import io, tables as T

TXN_COLS = ["txn_id", "step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig",
            "nameDest", "oldbalanceDest", "newbalanceDest", "isFraud"]
NUMERIC = ["step", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]
ID_COLS = ["txn_id", "nameOrig", "nameDest"]


def split_txn(spark: SparkSession, sf: str, with_party: bool = True) -> DataFrame:
    t = T.txn(spark, sf, with_party=with_party)
    c = prep.step_cutoffs(t, "step", CALIB, TEST)
    return prep.assign_split(t, "step", c, EMBARGO)


# ------------------------------------------------------------------ step 1


@register("scan_txn", sql=f"with {TXN_SQL} select * exclude (party) from txn")
def scan_txn(spark, sf):
    return T.txn(spark, sf)


@register("numeric_coerce", sql=f"""
with {TXN_SQL}
select txn_id,
       try_cast(cast(amount as varchar) as double) as amount,
       try_cast(type as double) as type_num,
       try_cast(substr(nameOrig, 2) as double) as orig_num,
       try_cast(nameDest as double) as dest_num,
       cast(trunc(coalesce(try_cast(case when type = '1-URGENT' then 'x' else cast(isFraud as varchar) end
                                    as double), 0.0)) as integer) as isFraud
from txn""")
def numeric_coerce(spark, sf):
    """Lenient coercion on string renderings: bad text → null, bad label → 0."""
    t = T.txn(spark, sf)
    raw = t.select(
        "txn_id",
        F.col("amount").cast("string").alias("amount"),
        F.col("type").alias("type_num"),
        F.substring("nameOrig", 2, 1 << 30).alias("orig_num"),
        F.col("nameDest").alias("dest_num"),
        F.when(F.col("type") == "1-URGENT", F.lit("x")).otherwise(F.col("isFraud").cast("string")).alias("isFraud"),
    )
    out = prep.coerce_numeric(raw, ["amount", "type_num", "orig_num", "dest_num"])
    return prep.coerce_label(out, "isFraud")


@register("bad_step_count", sql=f"""
with {TXN_SQL}
select count(*) as n_rows,
       count(*) filter (where try_cast(cast(step as varchar) as double) is null) as bad_step,
       count(*) filter (where try_cast(type as double) is null) as bad_type,
       count(*) filter (where try_cast(substr(nameOrig, 2) as double) is null) as bad_orig_digits
from txn""")
def bad_step_count(spark, sf):
    t = T.txn(spark, sf).select(F.col("step").cast("string").alias("step"), "type",
                                F.substring("nameOrig", 2, 1 << 30).alias("orig_digits"))
    return prep.bad_numeric_counts(t, ["step", "type", "orig_digits"])


@register("step_cutoffs", sql=f"""
with {TXN_SQL}
select round(quantile_cont(step, {1.0 - (CALIB + TEST)!r}), 6) as train_end,
       round(quantile_cont(step, {1.0 - TEST!r}), 6) as cal_end
from txn""")
def step_cutoffs(spark, sf):
    c = prep.step_cutoffs(T.txn(spark, sf), "step", CALIB, TEST)
    return spark.createDataFrame([(round(c.train_end, 6), round(c.cal_end, 6))],
                                 "train_end double, cal_end double")


@register("step_split", sql=f"with {SPLIT_SQL} select * from split_txn")
def step_split(spark, sf):
    return split_txn(spark, sf)


@register("split_counts", sql=f"with {SPLIT_SQL} select split, count(*) as n from split_txn group by split")
def split_counts(spark, sf):
    return split_txn(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("split_audit", sql=f"with {SPLIT_SQL} select txn_id, step, split as window from split_txn")
def split_audit(spark, sf):
    return split_txn(spark, sf).select("txn_id", "step", F.col("split").alias("window"))


# ------------------------------------------------------------------ files with bad records

#: Every so many transactions are written with text in a number, or cut short.
TEXT_EVERY, CUT_EVERY = 97, 89
_KIND_SQL = f"case when txn_id % {TEXT_EVERY} = 0 then 'text' when txn_id % {CUT_EVERY} = 0 then 'cut' end"


@register("bad_records", sql=f"""
with {TXN_SQL}, t as (select *, {_KIND_SQL} as kind from txn), f as (select unnest(['csv', 'json']) as format)
select format, coalesce(kind, 'row') as kind, count(*) as n,
       cast(case when kind is null then sum(cast(round(amount * 100) as bigint)) end as bigint) as cents
from t, f group by format, kind""")
def bad_records(spark, sf):
    """All transactions as CSV and JSON lines, some of them damaged, read against the declared schema: rows, and bad records apart."""
    t = T.txn(spark, sf).select("txn_id", "step", "type", "amount")
    i = F.col("txn_id")
    kind = F.when(i % TEXT_EVERY == 0, "text").when(i % CUT_EVERY == 0, "cut").otherwise("row")
    amount = F.when(kind == "text", "n/a").otherwise(F.col("amount").cast("string"))
    whole = {"csv": F.concat_ws(",", "txn_id", "step", "type", amount),
             "json": F.when(kind == "text", F.to_json(F.struct("txn_id", "step", "type", F.lit("n/a").alias("amount")))).otherwise(F.to_json(F.struct("*")))}
    short = {"csv": F.concat_ws(",", "txn_id", "step"), "json": F.substring_index(whole["json"], ",", 2)}
    out = None
    for fmt in whole:
        path = scratch_path(spark, f"lines-{fmt}")
        t.select(F.when(kind == "cut", short[fmt]).otherwise(whole[fmt]).alias("value")).write.text(path)
        rows, bad = io.read_checked(spark, path, t.schema, fmt, header=False)
        rows = rows.select(F.lit("row").alias("kind"), F.round(F.col("amount") * 100).cast("bigint").alias("cents"))
        bad = bad.select(F.when(F.col("record").contains("n/a"), "text").otherwise("cut").alias("kind"), F.lit(None).cast("bigint").alias("cents"))
        both = rows.union(bad).groupBy(F.lit(fmt).alias("format"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
        out = both if out is None else out.union(both)
    return out
