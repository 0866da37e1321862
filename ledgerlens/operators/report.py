"""Run artefact jobs: scoreboard, checksums, manifest sanitising, secret listing,
and the membership-inference probe of the privacy audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators import metrics as M
from ledgerlens.sources.io import discover

# Glob patterns of secret-bearing artefacts, relative to a run root
# (listed here, never wiped).
SECRET_GLOBS = [
    "he/paillier/private.json", "he/ckks/context_server.bin",
    "psi/hmac_key.json", "**/hmac_key.bin", "**/ids_hmac_map.csv",
    "psi/**/*.key", "psi/**/*.salt", "psi/**/*.tokens", "psi/**/*.txt",
    "oprf/**/*.json", "oprf/**/*.bin",
    "secureagg/**/mask.npy", "secureagg/**/pairwise_secrets.json", "secureagg/**/commit.json",
    "tools/**/server.key", "tools/**/client.key", "tools/**/ca.key",
    "**/*.pem.key", "**/*.p12", "**/*.pfx",
]


def glob_to_regex(g: str) -> str:
    """Path glob → regex anchored at a path-component boundary and the end."""
    out, i = [], 0
    while i < len(g):
        if g.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif g[i] == "*":
            out.append("[^/]*")
            i += 1
        else:
            out.append("\\" + g[i] if g[i] in ".+()[]{}^$|?\\" else g[i])
            i += 1
    return "(?:^|/)" + "".join(out) + "$"


def _field(schema: T.StructType, *names: str) -> Column:
    """First non-null field among those of ``names`` that the schema has (dotted for a struct's); letter case counts only between fields."""
    cols = []
    for name in names:
        kind, path = schema, []
        for part in name.split("."):
            fields = kind.fieldNames() if isinstance(kind, T.StructType) else []
            found = part if part in fields else next((f for f in fields if f.lower() == part.lower()), None)
            if found is None:
                break
            kind, path = kind[found].dataType, [*path, found]
        else:
            cols.append(F.col(".".join(f"`{x}`" for x in path)))
    return F.coalesce(*cols) if cols else F.lit(None)


def load_metrics(spark: SparkSession, root: str, glob: str = "*.json", lines: bool = False) -> DataFrame:
    """All metric records under ``root`` (recursive), with their source path.

    A file holds one document, indented or not, or with ``lines`` a record a line, as Spark writes them.
    """
    r = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
         .option("multiLine", not lines).json(root))
    return r.withColumn("source_path", F.col("_metadata.file_path"))


def scoreboard(metrics: DataFrame) -> DataFrame:
    """(source, family, path, auprc, roc_auc, f1, precision, recall, threshold, notes) of metric records, and their party if they have one.

    A record with both ``per_client`` and ``micro`` is a report of clients and gives its micro metrics; any other gives its
    own. Family is ``family``, else ``model``, else 'unknown'. Ordered by family, then the higher AUPRC.
    """
    schema = metrics.schema
    both = _field(schema, "per_client").isNotNull() & _field(schema, "micro").isNotNull()

    def pick(flat: tuple[str, ...], micro: str, kind: str = "double") -> Column:
        return F.when(both, _field(schema, f"micro.{micro}").cast(kind)).otherwise(_field(schema, *flat).cast(kind))

    out = metrics.select(
        F.when(both, "fl_clients").otherwise("single").alias("source"),
        F.coalesce(_field(schema, "family", "model").cast("string"), F.lit("unknown")).alias("family"),
        _field(schema, "source_path").cast("string").alias("path"),
        *[F.col(c) for c in ("party",) if c in metrics.columns],
        *[pick((x,), x).alias(x.lower()) for x in ("AUPRC", "ROC_AUC", "F1", "precision", "recall")],
        pick(("threshold", "threshold_used"), "threshold_used").alias("threshold"),
        F.when(both, "micro aggregation of clients").otherwise(_field(schema, "threshold_source").cast("string")).alias("notes"))
    return out.orderBy(F.col("family").asc(), F.coalesce(F.col("auprc"), F.lit(0.0)).desc())


def checksum_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, sha256) of every file under ``root``: one distributed scan."""
    files = discover(spark, root)
    return files.select(F.col("path"), F.col("length").alias("bytes"), F.sha2(F.col("content"), 256).alias("sha256"))


def sanitize(df: DataFrame, drop: Sequence[str]) -> DataFrame:
    """Drop top-level columns and nested struct fields given as dotted paths."""
    out = df
    for path in drop:
        parts = path.split(".")
        if parts[0] not in out.columns:
            continue
        if len(parts) == 1:
            out = out.drop(parts[0])
        else:
            out = out.withColumn(parts[0], F.col(parts[0]).dropFields(".".join(parts[1:])))
    return out


def secret_listing(spark: SparkSession, root: str, globs: Sequence[str] = tuple(SECRET_GLOBS)) -> DataFrame:
    """Paths of secret-bearing artefacts under ``root`` (listing only; nothing is deleted)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
             .select("path", "length"))
    rx = "|".join(f"(?:{glob_to_regex(g)})" for g in globs)
    return files.filter(F.col("path").rlike(rx))


def membership_probe(pred: DataFrame, members: DataFrame, id_col: str = "id", p: str = "p_hat") -> DataFrame:
    """Predictions ⋈ (id, is_member), then AP / ROC AUC of the score as a
    membership signal (0.5 AUC = no leakage)."""
    j = pred.join(members, id_col, "inner")
    cv = M.curve(j, "is_member", p)
    s = cv.agg(M.ap_agg(), M.auc_agg(), F.sum("pos").alias("n_members"), F.sum(F.col("pos") + F.col("neg")).alias("n"))
    return s
