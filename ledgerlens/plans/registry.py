"""Named queries over the driver tables, each with an optional DuckDB twin.

A query is ``fn(spark, sf_dir) -> DataFrame``. ``sql`` is the equivalent ANSI SQL
over the same parquet tables (views ``orders``, ``customer``, ... registered by
the checker); leave it out for iterative or random operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def rnd(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits)


# Shared SQL views (DuckDB dialect) mirroring ledgerlens.sources.tables.
TXN_SQL = """
txn as (
  select o_orderkey as txn_id,
         cast(datediff('day', cast('1995-01-01' as date), cast(o_orderdate as date)) as bigint) as step,
         o_orderpriority as type, o_totalprice as amount,
         concat('C', cast(o_custkey as varchar)) as nameOrig,
         c_acctbal as oldbalanceOrg, c_acctbal - o_totalprice as newbalanceOrig,
         concat('M', cast(c_nationkey as varchar)) as nameDest,
         cast(0.0 as double) as oldbalanceDest, o_totalprice as newbalanceDest,
         cast(case when o_orderstatus = 'F' then 1 else 0 end as integer) as isFraud,
         cast(c_nationkey % 3 as integer) as party
  from orders join customer on o_custkey = c_custkey
)"""

# split parameters used by the registered queries (ours)
CALIB, TEST, EMBARGO = 0.15, 0.2, 5

SPLIT_SQL = TXN_SQL + f""",
cut as (select quantile_cont(step, {1.0 - (CALIB + TEST)!r}) as train_end,
               quantile_cont(step, {1.0 - TEST!r}) as cal_end from txn),
labeled as (
  select txn.*, case when step <= train_end then 'train'
                     when step > train_end + {EMBARGO} and step <= cal_end then 'cal'
                     when step > cal_end + {EMBARGO} then 'test' end as split
  from txn, cut),
split_txn as (select * from labeled where split is not null)"""

UPDATES_SQL = """
updates as (
  select event_id, ts, concat('c', cast(user_id % 4 as varchar)) as client_id,
         cast(datediff('day', cast('2024-01-01' as date), cast(ts as date)) + 1 as integer) as round,
         event_type as model, value
  from events)"""
