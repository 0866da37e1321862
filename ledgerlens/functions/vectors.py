"""Vector and linear-model helpers as native Column expressions.

Features are wide columns (one per dimension) for small dimensions, or an
``array<double>`` column; both forms stay in codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = 35.0


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sigmoid(z: Column, clip: float = CLIP) -> Column:
    """``1 / (1 + exp(-clip(z, -35, 35)))``."""
    zc = F.greatest(F.lit(-clip), F.least(F.lit(clip), z))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-zc))


def dot_wide(cols: Sequence[str], theta: Sequence[float]) -> Column:
    """``x · θ`` over wide feature columns; θ one longer than x → trailing bias."""
    if len(theta) == len(cols) + 1:
        cols = list(cols) + [None]
    if len(theta) != len(cols):
        raise ValueError(f"dimension mismatch: {len(cols)} features, {len(theta)} weights")
    terms = [F.lit(float(t)) * (F.col(c).cast("double") if c else F.lit(1.0)) for c, t in zip(cols, theta)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def dot_array(x: Column | str, theta: Sequence[float]) -> Column:
    """``x · θ`` for an array column; θ one longer than x → trailing bias 1.0."""
    th = F.array(*[F.lit(float(t)) for t in theta])
    xa = _c(x).cast("array<double>")
    xa = F.when(F.size(xa) + 1 == len(theta), F.concat(xa, F.array(F.lit(1.0)))).otherwise(xa)
    return F.aggregate(F.zip_with(xa, th, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def vec_add(a: Column | str, b: Column | str) -> Column:
    """Element-wise sum; a size mismatch raises at run time."""
    a, b = _c(a), _c(b)
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x + y)).otherwise(
        F.raise_error(F.lit("vector dimensions differ")))


def blend(p1: Column | str, p2: Column | str, alpha: float) -> Column:
    a = F.lit(float(alpha))
    return a * _c(p1) + (F.lit(1.0) - a) * _c(p2)


def distinct_in_order(arr: Column | str) -> Column:
    """Order-keeping de-duplication of a list (first occurrence wins)."""
    return F.array_distinct(_c(arr))


def sorted_distinct(arr: Column | str) -> Column:
    return F.array_sort(F.array_distinct(_c(arr)))
