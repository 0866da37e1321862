"""Small helpers that the text operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import checkpoint_root, scratch_path

#: The white space of the word rule ``[^\x20\x09-\x0D]+``.
WHITE = " \t\n\x0b\x0c\r"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` under the shared checkpoint folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the scratch tables that these read, which nothing needs any more, and has Spark remove the shuffle files of finished steps.

    Spark removes those when the driver's collector meets their plans, by default each half hour; a job of many steps asks for
    it between them. Files outside the scratch folder stay.
    """
    spark = tables[0].sparkSession
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    root = path_of(checkpoint_root(spark)).toUri().getPath()
    for folder in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        path = path_of(folder)
        if path.toUri().getPath().startswith(f"{root}/"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()  # what Python holds keeps the driver's
    spark._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as an array; built-in functions only."""
    spaced = F.translate(text, WHITE[1:], " " * (len(WHITE) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str, out_rows: int = 4096, many: bool = False) -> DataFrame:
    """Arrow-batched flat map: ``make()`` runs once a task and returns ``f(*row) -> rows``; ``many``: ``f(list of rows) -> rows``.

    Output batches hold about ``out_rows`` rows, so memory stays bounded whatever one row yields.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, rows = make(), []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * len(arrow)
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow.types, strict=True)], schema=arrow)
            rows.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                given = zip(*(c.to_pylist() for c in part.columns), strict=True)
                for row in [(list(given),)] if many else given:
                    rows.extend(f(*row))
                    if len(rows) >= out_rows:
                        yield flush()
        if rows:
            yield flush()

    return df.mapInArrow(task, schema)


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")
