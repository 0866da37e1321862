"""Driver tables and the derived views every query starts from.

``txn`` maps the TPC-H-like ``orders ⋈ customer`` onto the transaction layout
the fraud pipeline expects (step, type, amount, nameOrig, balances, nameDest,
isFraud). ``party`` adds a party tag so per-party (federated) operators have
several parties to work with. ``updates`` maps ``events`` onto federated update
rows (client, round, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed values of our test views (origins of the derived time axes).
STEP_ORIGIN = "1995-01-01"
ROUND_ORIGIN = "2024-01-01"
N_PARTIES = 3
N_CLIENTS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def txn(spark: SparkSession, sf_dir: str, with_party: bool = False) -> DataFrame:
    """Transactions view: one row per order, joined to its customer.

    The join is a plain equi-join on the customer key; AQE picks broadcast or
    sort-merge from the runtime size of ``customer`` (no forced broadcast: the
    customer table grows with the data).
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                              "o_totalprice", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    cols = [
        F.col("o_orderkey").alias("txn_id"),
        F.datediff(F.to_date("o_orderdate"), F.lit(STEP_ORIGIN).cast("date")).cast("bigint").alias("step"),
        F.col("o_orderpriority").alias("type"),
        F.col("o_totalprice").alias("amount"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("nameOrig"),
        F.col("c_acctbal").alias("oldbalanceOrg"),
        (F.col("c_acctbal") - F.col("o_totalprice")).alias("newbalanceOrig"),
        F.concat(F.lit("M"), F.col("c_nationkey").cast("string")).alias("nameDest"),
        F.lit(0.0).cast("double").alias("oldbalanceDest"),
        F.col("o_totalprice").alias("newbalanceDest"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("int").alias("isFraud"),
    ]
    if with_party:
        cols.append((F.col("c_nationkey") % N_PARTIES).cast("int").alias("party"))
    return j.select(*cols)


def party_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn(spark, sf_dir, with_party=True)


def scored_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-party transactions with a score column ``p`` (ties on purpose)."""
    return party_txn(spark, sf_dir).withColumn("p", F.round(F.col("amount") / 1000.0))


def round_col(ts: Column) -> Column:
    return (F.datediff(F.to_date(ts), F.lit(ROUND_ORIGIN).cast("date")) + 1).cast("int")


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Federated update rows derived from ``events``: arrival order is (ts, event_id)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id"),
        F.col("ts"),
        F.concat(F.lit("c"), (F.col("user_id") % N_CLIENTS).cast("string")).alias("client_id"),
        round_col(F.col("ts")).alias("round"),
        F.col("event_type").alias("model"),
        F.col("value"),
    )


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents left-joined to labels: unlabeled documents carry a null class."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "left").select("doc_id", F.col("quality").alias("label"))
