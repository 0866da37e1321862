"""Training rows of trees as counted cells: each feature in at most ``maxBins`` bins, equal binned rows once with their number.

A tree of ``pyspark.ml`` only sees the bin of a value, so rows of one cell (same bins, label and weight) are alike to
it. Features of b1, b2, ... bins have at most b1 * b2 * ... cells, however many rows there are; where nearly every row has a cell of its
own, the table is as long as the rows. Edges are quantiles of all rows; a feature of few values has them all.
A value lies in the bin numbered by the edges below it, so "bin <= k" is "value <= edge k"; a missing value, to be scored, is in the last bin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Accuracy of the quantiles: one part in so many.
ACCURACY = 1_000


def edges(rows: DataFrame, bins: int, col: str = "features") -> list[list[float]]:
    """The edges between the bins of every feature of a vector column, at most ``bins`` - 1 a feature; missing and infinite values are refused, as by Spark's trees."""
    x, first = vector_to_array(col), rows.select(F.size(vector_to_array(col)).alias("d")).first()
    if first is None:
        raise ValueError("no rows to train on")
    xs = [F.get(F.col("x"), F.lit(i)) for i in range(first["d"])]
    rows = rows.select(x.alias("x"))
    at = [k / bins for k in range(1, bins)]
    found = rows.agg(*(f(v).alias(f"{name}{i}") for i, v in enumerate(xs) for name, f in (
        ("q", lambda v: F.percentile_approx(v, at, ACCURACY)), ("most", F.max), ("least", F.min), ("n", F.approx_count_distinct)))).first()
    if not all(math.isfinite(found[f"{end}{i}"]) for i in range(len(xs)) for end in ("least", "most")):  # NaN is the greatest
        raise ValueError("features must not be NaN or infinite")
    few = [i for i in range(len(xs)) if found[f"n{i}"] <= 2 * bins]  # a bound for the sets below
    values = rows.agg(*(F.collect_set(xs[i]).alias(f"v{i}") for i in few)).first() if few else None
    out = []
    for i in range(len(xs)):
        cuts = found[f"q{i}"] or []
        if i in few and len(values[f"v{i}"]) <= bins:
            cuts = values[f"v{i}"]
        out.append(sorted({float(v) for v in cuts if v < found[f"most{i}"]}))
    return out


def binned(x: np.ndarray, cuts: Sequence[Sequence[float]]) -> np.ndarray:
    """The bins of rows of features."""
    return np.stack([np.searchsorted(np.asarray(c, dtype=float), x[:, i], "left") for i, c in enumerate(cuts)], axis=1).astype(np.int16)


def counted(rows: DataFrame, cuts: Sequence[Sequence[float]], by: Sequence[str], col: str = "features") -> DataFrame:
    """(cell, the columns ``by`` as doubles, n): the cells of the rows and how many rows each has."""
    d, by = len(cuts), list(by)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
            rest = np.empty((b.num_rows, len(by)))
            for j in range(len(by)):
                rest[:, j] = b.column(1 + j).to_numpy(zero_copy_only=False)
            rec = np.concatenate([binned(x, cuts).view(np.uint8), rest.view(np.uint8)], axis=1)
            one, n = np.unique(np.ascontiguousarray(rec).view(f"V{rec.shape[1]}").ravel(), return_counts=True)
            rec = one.view(np.uint8).reshape(len(one), -1)
            cell = np.ascontiguousarray(rec[:, :2 * d]).view(np.int16).ravel()
            rest = np.ascontiguousarray(rec[:, 2 * d:]).view(float)
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array(np.arange(len(one) + 1, dtype=np.int32) * d), pa.array(cell)),
                                   *(pa.array(rest[:, j]) for j in range(len(by))), pa.array(n.astype(np.int64))], names=["cell", *by, "n"])

    schema = ", ".join(["cell array<smallint>", *(f"`{c}` double" for c in by), "n long"])
    given = rows.select(vector_to_array(col).alias("x"), *(F.col(c).cast("double").alias(c) for c in by))
    return given.mapInArrow(part, schema).groupBy("cell", *by).agg(F.sum("n").alias("n"))


def as_vector(cell: str = "cell"):
    """A cell as a vector of its bin numbers."""
    return array_to_vector(F.col(cell).cast("array<double>"))
