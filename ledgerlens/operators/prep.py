"""Feature preparation: coercion, validation, chronological split, fit/apply.

Every fitted parameter (cutoffs, mean/std, vocabularies) is a small, size-checked
result of one distributed aggregation; it is brought to the driver once and
inlined as literals into a single projection over all splits, so the apply step
stays inside whole-stage codegen with no join and no extra shuffle.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ranking import exact_quantiles

# ---------------------------------------------------------------- coercion / checks


def try_double(c: Column | str) -> Column:
    """Lenient numeric coercion: anything unparsable, and NaN, becomes null (ANSI-safe)."""
    c = F.col(c) if isinstance(c, str) else c
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: try_double(c) for c in present})


def coerce_label(df: DataFrame, label: str) -> DataFrame:
    """Label coercion: unparsable or null → 0, then truncated to int."""
    return df.withColumn(label, F.coalesce(try_double(label), F.lit(0.0)).cast("int"))


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def drop_optional(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def require_columns(df: DataFrame, required: list[str], label: str) -> DataFrame:
    """Checks the schema for ``required`` and the label; a label in other letter case is renamed."""
    by_name = {f.name.casefold(): f.name for f in df.schema.fields}
    absent = sorted(set(required).difference(df.columns))
    found = label if label in df.columns else by_name.get(label.casefold())
    problems = ([f"no columns {', '.join(absent)}"] if absent else []) + ([f"no label column {label}"] if found is None else [])
    if problems:
        raise ValueError("the table has " + " and ".join(problems))
    return df if found == label else df.withColumnRenamed(found, label)


def split_types(df: DataFrame, exclude: list[str]) -> tuple[list[str], list[str]]:
    """Numeric vs categorical feature columns, by Spark type, in schema order."""
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        tn = f.dataType.typeName()
        if tn in ("byte", "short", "integer", "long", "float", "double", "decimal"):
            num.append(f.name)
        else:
            cat.append(f.name)
    return num, cat


def feature_columns(df: DataFrame, id_col: str, label: str, exclude: tuple = ("split", "party")) -> list[str]:
    """All columns but id, label and bookkeeping columns, in schema order."""
    return [c for c in df.columns if c not in (id_col, label, *exclude)]


def apply_feature_policy(df: DataFrame, keep: list[str], include: list[str] | None = None,
                         exclude: list[str] | None = None) -> DataFrame:
    """Configured include/exclude lists: keep ``keep``, then included (or all)
    columns minus excluded ones, in schema order."""
    inc = set(include) if include else None
    exc = set(exclude or [])
    cols = [c for c in df.columns if c in keep or ((inc is None or c in inc) and c not in exc)]
    return df.select(*cols)


def bad_numeric_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: total rows and, per column, rows that do not parse as numbers."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.count_if(try_double(c).isNull()).alias(f"bad_{c}") for c in cols]
    return df.agg(*aggs)


def assert_numeric(df: DataFrame, col: str) -> None:
    """Counts the values of ``col`` that are no numbers, and stops if there are any."""
    require_columns(df, [], col)
    bad = df.select(F.count_if(try_double(col).isNull())).first()[0]
    if bad:
        raise ValueError(f"{bad} rows hold no number in column {col}")


# ---------------------------------------------------------------- chronological split


@dataclass
class Cutoffs:
    train_end: float
    cal_end: float
    embargo: float = 0.0


def step_cutoffs(df: DataFrame, step: str, calib_frac: float, test_frac: float) -> Cutoffs:
    """Exact linear-interpolated quantile cutoffs of the step column."""
    held_out = (calib_frac, test_frac)
    if min(held_out) < 0 or sum(held_out) >= 1 or any(math.isnan(x) for x in held_out):
        raise ValueError(f"shares of calibration and test rows must leave some for training, not {held_out}")
    probs = [1.0 - (calib_frac + test_frac)]
    if test_frac > 0:
        probs.append(1.0 - test_frac)
    else:
        probs.append(1.0)  # the maximum
    q = exact_quantiles(df.select(try_double(step).alias("v")), "v", probs)
    return Cutoffs(q[0], q[1])


def split_expr(step: Column, c: Cutoffs, embargo: float = 0.0) -> Column:
    """train ``s<=T``; cal ``T+e<s<=C``; test ``s>C+e``; null for rows in the gaps."""
    t, k, e = float(c.train_end), float(c.cal_end), float(embargo)
    return (F.when(step <= F.lit(t), "train")
            .when((step > F.lit(t + e)) & (step <= F.lit(k)), "cal")
            .when(step > F.lit(k + e), "test"))


def assign_split(df: DataFrame, step: str, c: Cutoffs, embargo: float = 0.0,
                 col: str = "split") -> DataFrame:
    s = try_double(step)
    return df.withColumn(col, split_expr(s, c, embargo)).filter(F.col(col).isNotNull())


# ---------------------------------------------------------------- fit / apply


@dataclass
class ScaleParams:
    mean: dict[str, float] = field(default_factory=dict)
    std: dict[str, float] = field(default_factory=dict)


def fit_scale(train: DataFrame, cols: list[str], *, zero_fill: bool = False,
              std_floor: float | None = None) -> ScaleParams:
    """Mean and population std per column in ONE aggregation (partial + final).

    Default (in-memory form): nulls skipped, std 0 → 1.
    ``zero_fill``: nulls count as 0 first; std floored at ``std_floor`` (1e-12
    in the chunked form) and 1.0 when there is at most one row.
    """
    if not cols:
        return ScaleParams()
    aggs = []
    for i, c in enumerate(cols):
        x = F.coalesce(try_double(c), F.lit(0.0)) if zero_fill else try_double(c)
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    aggs.append(F.count(F.lit(1)).alias("n"))
    row = train.agg(*aggs).first()
    p = ScaleParams()
    n = row["n"]
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        m = 0.0 if m is None else float(m)
        s = None if s is None else float(s)
        if zero_fill:
            if n <= 1 or s is None:
                s = 1.0
            else:
                s = max(std_floor if std_floor is not None else 1e-12, s)
        else:
            if s is None or s == 0.0 or math.isnan(s):
                s = 1.0
        p.mean[c], p.std[c] = m, s
    return p


def scale_params_frame(spark, p: ScaleParams) -> DataFrame:
    rows = [(c, float(p.mean[c]), float(p.std[c])) for c in p.mean]
    return spark.createDataFrame(rows, "feature string, mean double, std double")


def scale_exprs(p: ScaleParams, *, zero_fill: bool = False, suffix: str = "") -> list[Column]:
    """One projection per column; what the fit took as missing (text, NaN) is missing here too."""
    out = []
    for c in p.mean:
        x = F.coalesce(try_double(c), F.lit(0.0)) if zero_fill else try_double(c)
        std = p.std.get(c) or 1.0
        out.append(((x - F.lit(p.mean.get(c, 0.0))) / F.lit(std)).alias(c + suffix))
    return out


def apply_scale(df: DataFrame, p: ScaleParams, keep: list[str], *, zero_fill: bool = False) -> DataFrame:
    return df.select(*[F.col(k) for k in keep], *scale_exprs(p, zero_fill=zero_fill))


def fit_vocab(train: DataFrame, cols: list[str], max_levels: int = 10_000) -> dict[str, list[str]]:
    """Sorted distinct non-null string levels per column (one distributed distinct).

    The result decides the output width, so it is size-checked before it is
    brought to the driver.
    """
    if not cols:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level"))
                                for c in cols]))
    lv = train.select(pairs.alias("p")).select("p.column", "p.level").filter(F.col("level").isNotNull()).distinct()
    rows = lv.limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"vocabulary has more than {max_levels} levels; use a hashed or sparse encoding")
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        out[r["column"]].append(r["level"])
    return {c: sorted(v) for c, v in out.items()}


def vocab_frame(spark, vocab: dict[str, list[str]]) -> DataFrame:
    rows = [(c, lv, i) for c, levels in vocab.items() for i, lv in enumerate(levels)]
    return spark.createDataFrame(rows, "feature string, level string, pos int")


def onehot_exprs(vocab: dict[str, list[str]]) -> list[Column]:
    """``{col}__{level}`` tinyint per training level; unseen or null level → all 0."""
    out = []
    for c, levels in vocab.items():
        s = F.col(c).cast("string")
        for lv in levels:
            out.append(F.coalesce(s == F.lit(lv), F.lit(False)).cast("tinyint").alias(f"{c}__{lv}"))
    return out


def apply_onehot(df: DataFrame, vocab: dict[str, list[str]], keep: list[str]) -> DataFrame:
    return df.select(*[F.col(k) for k in keep], *onehot_exprs(vocab))


def fit_scale_and_vocab(train: DataFrame, numeric: list[str], categorical: list[str], *,
                        zero_fill: bool = False, std_floor: float | None = None,
                        max_levels: int = 10_000) -> tuple[ScaleParams, dict[str, list[str]]]:
    """Both fits at once: two independent Spark jobs submitted concurrently."""
    with ThreadPoolExecutor(max_workers=2) as pool:
        fs = pool.submit(fit_scale, train, numeric, zero_fill=zero_fill, std_floor=std_floor)
        fv = pool.submit(fit_vocab, train, categorical, max_levels)
        return fs.result(), fv.result()


def preprocess(df: DataFrame, *, id_col: str, label: str, step_col: str | None = None,
               calib_frac: float = 0.0, test_frac: float = 0.0, embargo: float = 0.0,
               external_test: DataFrame | None = None, required: list[str] | None = None,
               drop: list[str] | None = None, id_columns: list[str] | None = None,
               numeric: list[str] | None = None, categorical: list[str] | None = None,
               zero_fill: bool = False, max_levels: int = 10_000) -> tuple[DataFrame, dict]:
    """The preprocessing job in one call: validate → coerce → split → fit on train →
    one projection over every split. Returns (frame with ``split``, schema document).

    * no ``step_col``: every input row is ``train``;
    * ``external_test``: transformed with the training fit and labelled ``test``;
      in-file rows that the step split would call ``test`` are then excluded;
    * id columns are never features; numeric/categorical default to schema types.
    """
    df = trim_headers(df)
    df = require_columns(df, (required or []) + [id_col], label)
    df = coerce_label(drop_optional(df, drop or []), label)
    ids = set([id_col] + list(id_columns or []))
    if step_col:
        assert_numeric(df, step_col)
        cuts = step_cutoffs(df, step_col, calib_frac, test_frac)
        df = assign_split(df, step_col, cuts, embargo)
        split_meta = {"cutoffs": {"train_end": cuts.train_end, "cal_end": cuts.cal_end},
                      "fractions": {"train": 1.0 - calib_frac - test_frac, "calib": calib_frac, "test": test_frac},
                      "embargo_steps": embargo}
    else:
        df = df.withColumn("split", F.lit("train"))
        split_meta = {}
    if external_test is not None:
        ext = coerce_label(drop_optional(trim_headers(external_test), drop or []), label)
        df = df.filter(F.col("split") != "test").unionByName(ext.withColumn("split", F.lit("test")),
                                                             allowMissingColumns=True)
    num, cat = split_types(df, exclude=[label, "split", *ids])
    num = numeric if numeric is not None else num
    cat = categorical if categorical is not None else cat
    train = df.filter(F.col("split") == "train")
    params, vocab = fit_scale_and_vocab(train, num, cat, zero_fill=zero_fill,
                                        std_floor=1e-12 if zero_fill else None, max_levels=max_levels)
    out = df.select(F.col(id_col).cast("string").alias(id_col), *scale_exprs(params, zero_fill=zero_fill),
                    *onehot_exprs(vocab), F.col(label), F.col("split"))
    schema = {"target": label, "id_column": id_col, "numeric": num, "categorical": cat,
              "ohe_categories": vocab, "scaler": {"mean": params.mean, "std": params.std},
              "time_splits": split_meta}
    return out, schema
