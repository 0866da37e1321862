"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, PII, best-fit packing.

Each stage takes (spark, docs, sf_dir), calls one operator of ``ledgerlens.llm`` and
returns a DataFrame that is written as Parquet and read again for the next. All but the
last return the columns of the documents; where a stage changes a text, ``n_chars`` (if
there is such a column) follows. Texts that lose all their lines stay as empty texts.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.llm import line_spread, packing, pii, quality, simhash  # noqa: E402
from ledgerlens.llm.common import read, stored  # noqa: E402


def _with_text(changed: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs`` from column ``row`` of ``changed``, with another text and its length."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return changed.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(line_spread.remove_boilerplate(docs), docs, F.col("kept_text"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(pii.redacted(docs), docs, F.col("clean"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_duplicates", near_duplicate_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: Tokenising and packing can't be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
