"""Readers and writers for the pipeline's files (sources S*, sinks K*).

Readers are lazy DataFrame scans: column pruning and filter pushdown reach the
Parquet reader; CSV gets an explicit schema where the layout is known. Writers
are single distributed writes (no per-chunk writers, no driver loops).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.session import written

# The transaction layout (required columns, label, optional and id columns).
REQUIRED = ["step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig",
            "nameDest", "oldbalanceDest", "newbalanceDest"]
LABEL = "isFraud"
OPTIONAL_DROP = ["isFlaggedFraud"]
ID_COLUMNS = ["nameOrig", "nameDest"]
NUMERIC_COLUMNS = ["step", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]


def _suffix(path: str) -> str:
    p = path.rstrip("/").lower()
    return p[p.rfind("."):] if "." in p.rsplit("/", 1)[-1] else ""


# The file kinds by suffix.
KINDS = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet", ".txt": "csv"}


def detect_format(path: str) -> str:
    """The kind of a table file by its suffix; a file of no known kind is an error, never a guess."""
    kind = KINDS.get(_suffix(path))
    if kind is None:
        raise ValueError(f"{path}: a table file ends in one of {', '.join(KINDS)}")
    return kind


def read_frame(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Lenient dispatch: .parquet/.pq → Parquet, anything else → CSV with a header."""
    if _suffix(path) in (".parquet", ".pq"):
        return spark.read.parquet(path)
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def transactions_schema(float_type: str = "double") -> T.StructType:
    """Declared CSV schema of the transaction layout (fixed names and types); floats as float or double."""
    ft = T.FloatType() if float_type in ("float", "float32") else T.DoubleType()
    fields = [T.StructField("step", ft), T.StructField("type", T.StringType()), T.StructField("amount", ft),
              T.StructField("nameOrig", T.StringType()), T.StructField("oldbalanceOrg", ft),
              T.StructField("newbalanceOrig", ft), T.StructField("nameDest", T.StringType()),
              T.StructField("oldbalanceDest", ft), T.StructField("newbalanceDest", ft),
              T.StructField("isFraud", T.ByteType()), T.StructField("isFlaggedFraud", T.ByteType())]
    return T.StructType(fields)


def read_checked(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv", header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, bad records) of CSV or JSON lines against a declared schema.

    A record with a value of another type, with too few or too many fields, or that is no JSON, is not a row with nulls: it is
    kept whole as (source_path, record). The files are parsed once, all columns of them, so that both tables agree.
    """
    if fmt not in ("csv", "json"):
        raise ValueError(f"{fmt}: only csv and json records are checked")
    if "_record" in schema.fieldNames():
        raise ValueError("_record is the column of the bad records")
    r = spark.read.schema(T.StructType([*schema.fields, T.StructField("_record", T.StringType())])).option("mode", "PERMISSIVE")
    r = r.option("columnNameOfCorruptRecord", "_record")
    raw = r.option("header", header).csv(path) if fmt == "csv" else r.json(path)
    both = written(raw.withColumn("_path", F.col("_metadata.file_path")), "checked")
    bad = F.col("_record").isNotNull()
    return both.filter(~bad).drop("_record", "_path"), both.filter(bad).select(F.col("_path").alias("source_path"), F.col("_record").alias("record"))


def read_key_document(spark: SparkSession, path: str) -> tuple[bytes, bytes]:
    """(key, salt) of a JSON key document, its fields ``k`` and ``salt`` in base64; no salt is an empty one."""
    doc = spark.read.schema("k string, salt string").option("multiLine", True).json(path)
    rows = doc.select(F.unbase64("k").alias("k"), F.coalesce(F.unbase64("salt"), F.unhex(F.lit(""))).alias("salt")).limit(2).collect()
    if len(rows) != 1 or not rows[0]["k"]:
        raise ValueError(f"{path} holds no single key document")
    return bytes(rows[0]["k"]), bytes(rows[0]["salt"])


def write_key_document(spark: SparkSession, key: bytes, salt: bytes, path: str) -> None:
    """The key and the salt in base64, as ``read_key_document`` reads them; a secret, to be kept where only its owner reads."""
    row = spark.createDataFrame([(bytearray(key), bytearray(salt))], "k binary, salt binary")
    row.select(F.base64("k").alias("k"), F.base64("salt").alias("salt")).coalesce(1).write.mode("overwrite").json(path)


def read_id_column(spark: SparkSession, path: str, id_col: str) -> DataFrame:
    """One-column scan, ids as strings (CSV reads everything as text)."""
    fmt = detect_format(path)
    df = spark.read.parquet(path) if fmt == "parquet" else spark.read.option("header", True).csv(path)
    return df.select(F.col(id_col).cast("string").alias(id_col))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed tokens of a file: the column ``token`` (or the first) of a table, or the lines that aren't blank of any other text."""
    if _suffix(path) in (".txt", "") or _suffix(path) not in KINDS:
        found = spark.read.text(path).select(F.trim("value").alias("token"))
        return found.where("token <> ''")
    table = spark.read.load(path, format=detect_format(path), header=True)
    named = [c for c in table.columns if c == "token"] + table.columns
    return table.select(F.trim(F.col(named[0]).cast("string")).alias("token"))


def read_json_records(spark: SparkSession, paths: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """One JSON document per file (pretty-printed allowed), with its source path."""
    r = spark.read.option("multiLine", True)
    if schema is not None:
        r = r.schema(schema)
    return r.json(paths).withColumn("source_path", F.col("_metadata.file_path"))


def discover(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Recursive file listing under ``root`` (path, length, content as binary)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob).load(root))


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """A file holding one JSON list of numbers → one row ``vec array<double>``."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", "array<double>").alias("vec"))


# ---------------------------------------------------------------- sinks


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", compression: str | None = None) -> None:
    w = df.write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    w.parquet(path)


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """All splits in one write, one directory per split (partition pruning on read)."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def write_tokens(tokens: DataFrame, path: str, order_col: str | None = None) -> None:
    """Tokens as Parquet and as text lines (one token per line).

    With ``order_col`` the lines are in its order over all files and the Parquet copy keeps it, so that the k-th
    token stays that of the k-th row.
    """
    rows = tokens.select("token", *([order_col] if order_col else []))
    rows.write.mode("overwrite").parquet(f"{path}/tokens.parquet")
    lines = rows.orderBy(order_col).select("token") if order_col else rows
    lines.write.mode("overwrite").text(f"{path}/tokens.txt")


def read_placed_tokens(spark: SparkSession, path: str, order_col: str = "row_idx") -> DataFrame:
    """(token, ``order_col``) of the ordered copy that ``write_tokens`` made."""
    return spark.read.parquet(f"{path.rstrip('/')}/tokens.parquet").select(F.trim("token").alias("token"), order_col)


def write_id_map(df: DataFrame, path: str) -> None:
    """Optional id → token map, zstd Parquet (holds raw ids: write only when asked)."""
    write_parquet(df, path, compression="zstd")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_sorted_text(df: DataFrame, col: str, path: str) -> None:
    """Globally sorted text output (range-partitioned sort, no single task)."""
    df.select(F.col(col).cast("string").alias("value")).orderBy("value").write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def party_from_path(path_col: str = "_metadata.file_path") -> "F.Column":
    """Party tag = the name of the file's parent directory."""
    return F.element_at(F.split(F.col(path_col), "/"), -2)


def write_bundle(df: DataFrame, path: str, params: dict, split_col: str = "split") -> None:
    """Feature bundle: rows partitioned by split + a JSON document of fitted params."""
    import json
    write_splits(df, f"{path}/data", split_col)
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "value string") \
        .coalesce(1).write.mode("overwrite").text(f"{path}/schema")


def read_bundle(spark: SparkSession, path: str, split: str, id_col: str, label: str):
    """(rows of one split, feature columns); the split filter prunes partitions."""
    import json
    params = json.loads(spark.read.text(f"{path}/schema").first()[0])
    df = spark.read.parquet(f"{path}/data").filter(F.col("split") == split).drop("split")
    feats = [c for c in df.columns if c not in (id_col, label)]
    return df, feats, params


def matrix_bundle(df: DataFrame, features: list[str], id_col: str, label: str) -> DataFrame:
    """Matrix form: (row, x array<double>, y) with a contiguous row index by id."""
    from ledgerlens.operators.weights import row_index
    m = df.select(id_col, F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
                  F.col(label).cast("long").alias("y"))
    return row_index(m, id_col, out="row").select("row", "x", "y")
