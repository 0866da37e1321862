"""Private set intersection over keyed tokens, and membership filters.

Tokens are computed where the ids live (one projection), so only 64-hex tokens
cross the shuffle. The N-party intersection is a single aggregation keyed by
token: rows are first reduced to distinct (token, party) map-side, so a token
that appears in a third of all rows costs one row per party and partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.crypto import hmac_token
from ledgerlens.operators.ranking import row_number

MAX_PARTIES = 10_000


def tokenize(df: DataFrame, id_col: str, key: bytes, salt: bytes = b"", canon: str = "none",
             keep: list[str] | None = None, drop_null: bool = True) -> DataFrame:
    """One token per input row (duplicates kept), next to the ``keep`` columns.

    Null ids are dropped by default (they would all hash to the token of ''),
    see :func:`null_id_counts` for how many.
    """
    if drop_null:
        df = df.filter(F.col(id_col).isNotNull())
    return df.select(*(keep or []), hmac_token(id_col, key, salt, canon).alias("token"))


def null_id_counts(df: DataFrame, id_col: str, party: str = "party") -> DataFrame:
    """Per party: rows whose id is null (excluded from the intersection)."""
    return df.groupBy(party).agg(F.count_if(F.col(id_col).isNull()).alias("null_ids"))


def id_token_map(df: DataFrame, id_col: str, key: bytes, salt: bytes = b"", canon: str = "none") -> DataFrame:
    """Distinct (id, token) pairs (one global map rather than one per chunk); null ids skipped."""
    return (df.filter(F.col(id_col).isNotNull())
            .select(F.col(id_col).alias("id"), hmac_token(id_col, key, salt, canon).alias("token")).distinct())


def id_hash_map(df: DataFrame, id_cols: list[str], key: bytes) -> DataFrame:
    """Audit map (id, hmac, column): keyed hash without salt or canonicalisation."""
    parts = [df.select(F.col(c).cast("string").alias("id"),
                       hmac_token(c, key, b"", None).alias("hmac"),
                       F.lit(c).alias("column")) for c in id_cols if c in df.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def parties_of(rows: DataFrame, party: str = "party") -> list:
    """The parties of the raw rows, also those whose ids are all null; without a null party. Size-checked before it is brought to the driver."""
    found = rows.select(party).filter(F.col(party).isNotNull()).distinct().limit(MAX_PARTIES + 1).collect()
    if len(found) > MAX_PARTIES:
        raise ValueError(f"more than {MAX_PARTIES} parties")
    return sorted(r[0] for r in found)


def intersect(tokens: DataFrame, parties: Sequence, party: str = "party") -> DataFrame:
    """Tokens held by every one of ``parties``: one aggregation keyed by token.

    The list is not read off the tokens, since a party without any token makes the intersection empty (see
    :func:`parties_of`). Tokens of other parties don't count; without parties there is no common token.
    """
    names = list(dict.fromkeys(parties))
    held = tokens.filter(F.col(party).isin(names))
    return (held.groupBy("token").agg(F.count_distinct(party).alias("_np"))
            .filter(F.col("_np") == F.lit(len(names))).select("token"))


def party_counts(tokens: DataFrame, inter: DataFrame, party: str = "party") -> DataFrame:
    """Per party: tokens (rows), distinct tokens, distinct tokens in the intersection."""
    base = tokens.groupBy(party).agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.count_distinct("token").alias("n_distinct"))
    hit = (tokens.select(party, "token").distinct().join(inter, "token", "left_semi")
           .groupBy(party).agg(F.count(F.lit(1)).alias("n_intersection")))
    return (base.join(hit, party, "left")
            .select(party, "n_rows", "n_distinct",
                    F.coalesce(F.col("n_intersection"), F.lit(0)).cast("bigint").alias("n_intersection")))


def semi_filter(df: DataFrame, id_col: str, inter: DataFrame, key: bytes, salt: bytes = b"",
                canon: str = "none") -> DataFrame:
    """Rows whose token is in the intersection; rows with a null id never match.

    Each distinct id is hashed once, however many rows hold it.
    """
    ids = df.select(id_col).filter(F.col(id_col).isNotNull()).distinct().withColumn("_tok", hmac_token(id_col, key, salt, canon))
    kept = ids.join(inter.withColumnRenamed("token", "_tok"), "_tok", "left_semi").select(id_col)
    return df.join(kept, id_col, "left_semi")


def positional_filter(rows: DataFrame, tokens: DataFrame, inter: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """k-th token belongs to k-th row (of each group): both sides carry ``row_idx``; counts must agree in every group.

    The counts of all groups come from one aggregation over both sides.
    """
    g = list(group_cols)
    sides = rows.select(*g, F.lit(1).alias("_r"), F.lit(0).alias("_t")).unionByName(tokens.select(*g, F.lit(0).alias("_r"), F.lit(1).alias("_t")))
    odd = sides.groupBy(*g).agg(F.sum("_r").alias("_r"), F.sum("_t").alias("_t")).filter("_r <> _t").limit(1).collect()
    if odd:
        raise ValueError(f"token count {odd[0]['_t']} != row count {odd[0]['_r']}; tokens must align with rows")
    kept = tokens.join(inter, "token", "left_semi")
    return rows.join(kept, [*g, "row_idx"], "inner")


def with_row_idx(df: DataFrame, order_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """``row_idx``: the place of a row from 0 (within its group) by ``order_col``."""
    return row_number(df, [order_col], list(group_cols), out="row_idx").withColumn("row_idx", F.col("row_idx") - 1)
