"""Structured Streaming versions of feature preparation, statistics and scoring.

Sources are file streams (``readStream`` over a directory with a glob filter). A run
writes its sink and its checkpoint under one base folder: a fresh one in the session's
shared checkpoint folder, or the caller's ``base``. Only a caller's stable ``base``
resumes: run again with it, a stream goes on after the files it has already taken.
Runs use ``trigger(availableNow=True)``: process everything present, then stop.

* ``run_append``: static fitted parameters or a stored model applied per row, append.
* ``running_stats``: per-key running aggregates, complete output rewritten per batch.
* ``windows``: event-time windows with a watermark in update mode; state for windows
  behind the watermark is dropped, and the sink keeps the latest version of each window.
* ``sessions``: each micro-batch closes its own session pieces, which are merged when read.
* ``round_barrier``: distinct (round, client) keys, then a count.

Rows behind a watermark can't reach a state any more. A stateful run that met such rows
raises ``LateRows`` with their number instead of giving a short result. Files of a
folder come in no promised order, so ``span`` gives the delay that loses none of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.session import scratch_path


class LateRows(ValueError):
    """Rows arrived behind the watermark; ``n`` of them, after partial aggregation."""

    def __init__(self, n: int, watermark: str):
        super().__init__(f"{n} rows came more than {watermark} late and are missing; take a longer watermark")
        self.n = n


def _located(spark: SparkSession, directory: str, file_glob: str) -> tuple[str, str]:
    """Folder and file pattern of the file or files, or of a table folder of that name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{directory.rstrip('/')}/{file_glob}")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    if found is not None and len(found) == 1 and found[0].isDirectory():
        return f"{directory.rstrip('/')}/{file_glob}", "*.parquet"
    return directory, file_glob


def source(spark: SparkSession, directory: str, file_glob: str, schema=None, max_files: int | None = None) -> DataFrame:
    """Streaming file source over the file or files ``file_glob`` in ``directory``, or over a table folder of that name."""
    directory, file_glob = _located(spark, directory, file_glob)
    if schema is None:
        schema = spark.read.option("pathGlobFilter", file_glob).parquet(directory).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(directory)


def span(spark: SparkSession, directory: str, file_glob: str, ts: str) -> str:
    """A watermark delay as long as the present files' event times reach (one aggregate over one column)."""
    directory, file_glob = _located(spark, directory, file_glob)
    t = F.col(ts).cast("timestamp").cast("double")
    row = spark.read.option("pathGlobFilter", file_glob).parquet(directory).agg((F.max(t) - F.min(t)).alias("s")).first()
    return f"{math.ceil((row['s'] or 0.0) / 3600) + 1} hours"


def _late_before(spark: SparkSession, base: str) -> int:
    """Rows that an earlier run under ``base`` dropped as late: its sink lacks them whatever a resumed run adds."""
    try:
        return spark.read.schema("late long").parquet(f"{base}/_late").agg(F.sum("late")).first()[0] or 0
    except AnalysisException:  # no such folder: no run has failed here
        return 0


def _run(spark: SparkSession, writer, base: str, watermark: str | None = None) -> None:
    """Runs a stream to its end; late rows raise, in this run and in every later one under the same ``base``."""
    missing = _late_before(spark, base)
    if missing:
        raise LateRows(missing, watermark or "the watermark")
    key = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(key)
    spark.conf.set(key, "100000")  # progress of all batches, not of the last hundred only
    try:
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    late = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    if late:
        spark.createDataFrame([(late,)], "late long").coalesce(1).write.mode("append").parquet(f"{base}/_late")
        raise LateRows(late, watermark or "the watermark")


def run_append(stream: DataFrame, name: str, base: str | None = None, watermark: str | None = None) -> DataFrame:
    """Append-mode stream into a parquet sink; returns the sink as a batch frame."""
    spark = stream.sparkSession
    base = base or scratch_path(spark, f"stream-{name}")
    _run(spark, stream.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{base}/_checkpoint").option("path", f"{base}/out"), base, watermark)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_batches(stream: DataFrame, name: str, mode: str, handler: Callable[[DataFrame, int, str], None],
                base: str | None = None, watermark: str | None = None) -> str:
    """Run a stream with ``foreachBatch``; the handler writes under the returned path."""
    spark = stream.sparkSession
    base = base or scratch_path(spark, f"stream-{name}")

    def each(batch: DataFrame, batch_id: int) -> None:
        handler(batch, batch_id, f"{base}/out")

    _run(spark, stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/_checkpoint").foreachBatch(each), base, watermark)
    return f"{base}/out"


def _overwrite(batch: DataFrame, batch_id: int, path: str) -> None:
    batch.write.mode("overwrite").parquet(path)


def _batch_folder(batch: DataFrame, batch_id: int, path: str) -> None:
    """A folder for each batch: a batch that runs again after a failure replaces its own output."""
    batch.write.mode("overwrite").parquet(f"{path}/_b={int(batch_id)}")


def running_stats(stream: DataFrame, keys: list[str], aggs: list, name: str = "stats", base: str | None = None) -> DataFrame:
    """Complete-mode running aggregates; the final table is the last batch's output."""
    spark = stream.sparkSession
    agg = stream.groupBy(*keys).agg(*aggs)
    path = run_batches(agg, name, "complete", _overwrite, base)
    return spark.read.schema(agg.schema).parquet(path)


def _as_instant(stream: DataFrame, ts: str) -> tuple[DataFrame, Callable[[str], Column]]:
    """The stream with ``ts`` as an instant, as watermarks need it, and the way back for a column.

    A time without zone is read as a UTC wall clock, whatever the session zone, so windows align to wall-clock days.
    """
    if stream.schema[ts].dataType.typeName() != "timestamp_ntz":
        return stream, F.col
    tz = stream.sparkSession.conf.get("spark.sql.session.timeZone")
    return (stream.withColumn(ts, F.from_utc_timestamp(F.col(ts).cast("timestamp"), tz)),
            lambda c: F.to_utc_timestamp(F.col(c), tz).cast("timestamp_ntz"))


def windows(stream: DataFrame, ts: str, keys: list[str], aggs: list, duration: str, slide: str | None = None,
            watermark: str = "1 hour", name: str = "windows", base: str | None = None) -> DataFrame:
    """Watermarked tumbling / sliding windows in update mode.

    Each micro-batch writes its updated windows under its batch id; the result keeps
    the latest version per (window, keys) – a keyed aggregation, no driver-side state.
    """
    spark = stream.sparkSession
    w = F.window(ts, duration, slide) if slide else F.window(ts, duration)
    stream, back = _as_instant(stream, ts)
    s = stream.withWatermark(ts, watermark).groupBy(w.alias("w"), *keys).agg(*aggs)
    s = s.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys,
                 *[c for c in s.columns if c not in ("w", *keys)])
    path = run_batches(s, name, "update", _batch_folder, base, watermark)
    k = ["window_start", "window_end", *keys]
    vals = [c for c in s.columns if c not in k]
    latest = spark.read.parquet(path).groupBy(*k).agg(F.max_by(F.struct(*vals), F.col("_b")).alias("_v"))
    return latest.select(back("window_start").alias("window_start"), back("window_end").alias("window_end"), *keys, "_v.*")


def sessions(stream: DataFrame, ts: str, keys: list[str], sums: dict[str, Column], gap: str, name: str = "sessions",
             base: str | None = None) -> DataFrame:
    """Session windows per key: (session_start, session_end, keys, sums), whatever the order of arrival.

    ``sums`` are additive aggregates (name -> value to add up). A micro-batch reduces its
    rows to session pieces; pieces that overlap are merged when the sink is read. No state
    is kept between batches, so none grows and no row can come too late.
    """
    spark = stream.sparkSession
    stream, back = _as_instant(stream, ts)

    def pieces(batch: DataFrame, batch_id: int, path: str) -> None:
        w = F.session_window(ts, gap)
        part = batch.groupBy(*keys, w.alias("_w")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
        _batch_folder(part.select(*keys, F.col("_w.start").alias("_s"), F.col("_w.end").alias("_e"), *sums), batch_id, path)

    found = spark.read.parquet(run_batches(stream, name, "append", pieces, base)).drop("_b")
    by = Window.partitionBy(*keys).orderBy("_s", "_e")
    reach = F.max("_e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("_new", F.when(F.col("_s") < reach, 0).otherwise(1))
    found = found.withColumn("_k", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    done = found.groupBy(*keys, "_k").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), *[F.sum(n).alias(n) for n in sums])
    return done.select(back("_s").alias("session_start"), back("_e").alias("session_end"), *keys, *sums)


def dedup_within_watermark(stream: DataFrame, keys: list[str], ts: str, watermark: str = "1 day") -> DataFrame:
    """Streaming duplicate rejection: the first arrival per key is kept; state for a
    key is dropped once the watermark passes its event time."""
    stream, _ = _as_instant(stream, ts)
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def round_barrier(stream: DataFrame, round_col: str, client_col: str, expected: int, ts: str, watermark: str = "1 day",
                  name: str = "barrier", base: str | None = None) -> DataFrame:
    """Each round once whose distinct clients reach ``expected``: (round, n_clients).

    The stream keeps the first update per (round, client), its state evicted by the
    watermark; the sink then holds at most one row per client, round and eviction,
    and its distinct clients are counted.
    """
    keys = dedup_within_watermark(stream.select(round_col, client_col, ts), [round_col, client_col], ts, watermark)
    seen = run_append(keys.select(round_col, client_col), name, base, watermark)
    return seen.groupBy(round_col).agg(F.count_distinct(client_col).alias("n_clients")).filter(F.col("n_clients") >= expected)
