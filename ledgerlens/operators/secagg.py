"""Pairwise-masked secure aggregation as joins, generators and aggregations.

Each unordered client pair (a < b) shares a key; a keyed PRG expands it into a
``dim``-vector m_ab. Client a adds m_ab and client b subtracts it, so the masks
cancel in the server's sum. The PRG block c is ``HMAC(key, salt || be64(c))``;
its 32 bytes are read as four little-endian uint64 ``u`` and mapped to
``u / 2^64 − 0.5``. Everything is native expressions: hex XOR for the padded
column keys, ``sha2`` for the hash, ``conv`` → ``decimal(20,0)`` for uint64.

A session's clients are the parties of a round. Every pair of them shares a key by
the protocol, so a session has as many pairs as its parties have; the number of
sessions grows with the data, the number of parties in one doesn't. Each client
meets the session's sorted client list (one row per session), and only the ids
after its own become pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.crypto import pair_salt, utf8

TWO_64 = 18446744073709551616.0
# Domain-separation prefix of the per-client commitment key (ours).
COMMIT_PREFIX = "ledgerlens-mask-commit|"


def roster(df: DataFrame, session: str, client: str) -> DataFrame:
    """Sorted distinct clients per session; a session needs at least two."""
    return df.select(F.col(session).alias("session"), F.col(client).cast("string").alias("client_id")).distinct()


def roster_summary(r: DataFrame) -> DataFrame:
    return r.groupBy("session").agg(
        F.array_join(F.array_sort(F.collect_set("client_id")), ",").alias("clients"),
        F.count(F.lit(1)).alias("n_clients")).withColumn("ok", F.col("n_clients") >= 2)


def pairs(r: DataFrame) -> DataFrame:
    """All unordered pairs (a < b) of a session's clients; null sessions and clients have none."""
    r = r.filter(F.col("session").isNotNull() & F.col("client_id").isNotNull())
    listed = r.groupBy("session").agg(F.array_sort(F.collect_set("client_id")).alias("_all"))
    each = listed.select("session", F.posexplode("_all").alias("_i", "a"), "_all")
    later = F.slice("_all", F.col("_i") + 2, F.size("_all"))
    return each.select("session", "a", F.explode(later).alias("b"))


def directed(p: DataFrame) -> DataFrame:
    """Each pair in both directions: (session, client_id, peer)."""
    return p.select("session", F.col("a").alias("client_id"), F.col("b").alias("peer")).unionByName(
        p.select("session", F.col("b").alias("client_id"), F.col("a").alias("peer")))


def missing_peers(expected: DataFrame, provided: DataFrame) -> DataFrame:
    """Expected (client, peer) secrets that are absent (left anti join)."""
    return expected.join(provided, ["session", "client_id", "peer"], "left_anti")


def session_salt_hex(session: Column) -> Column:
    """Per-session salt (ours): md5 of the session name, 16 bytes."""
    return F.md5(session.cast("string"))


def pair_salts(p: DataFrame, salt_hex: Column | None = None) -> DataFrame:
    sh = salt_hex if salt_hex is not None else session_salt_hex(F.col("session"))
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    msg = F.concat(F.unhex(sh), utf8(F.concat(F.lit("|"), lo, F.lit("|"), hi)))
    return p.withColumn("pair_salt", F.sha2(msg, 256))


def _xor_hex(hex32: Column, byte: int) -> Column:
    """XOR each byte of a 32-byte hex key with ``byte``, as 8 native 4-byte words."""
    word = int.from_bytes(bytes([byte]) * 4, "big")
    parts = []
    for i in range(8):
        w = F.conv(F.substring(hex32, 8 * i + 1, 8), 16, 10).cast("bigint").bitwiseXOR(F.lit(word))
        parts.append(F.lpad(F.hex(w), 8, "0"))
    return F.concat(*parts)


def hmac_hex_colkey(key_hex: Column, msg: Column) -> Column:
    """HMAC-SHA256 with a per-row 32-byte key given as 64 hex chars."""
    ipad = F.unhex(F.concat(_xor_hex(key_hex, 0x36), F.lit("36" * 32)))
    opad = F.unhex(F.concat(_xor_hex(key_hex, 0x5C), F.lit("5c" * 32)))
    return F.sha2(F.concat(opad, F.unhex(F.sha2(F.concat(ipad, msg), 256))), 256)


def _u64_le_to_unit(hex16: Column) -> Column:
    """8 bytes (16 hex, little-endian) → uint64 → ``u / 2^64 − 0.5``."""
    rev = F.concat(*[F.substring(hex16, 15 - 2 * i, 2) for i in range(8)])
    u = F.conv(rev, 16, 10).cast("decimal(20,0)").cast("double")
    return u / F.lit(TWO_64) - F.lit(0.5)


def prg(df: DataFrame, key_hex: str, salt_hex: str, dim: int) -> DataFrame:
    """Expand each row's (key, salt) into ``dim`` rows (pos, m) with m in (−0.5, 0.5)."""
    blocks = (dim + 3) // 4
    b = df.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    ctr = F.unhex(F.lpad(F.hex(F.col("_c").cast("bigint")), 16, "0"))
    b = b.withColumn("_blk", hmac_hex_colkey(F.col(key_hex), F.concat(F.unhex(F.col(salt_hex)), ctr)))
    words = F.array(*[F.struct(F.lit(k).alias("k"), _u64_le_to_unit(F.substring("_blk", 16 * k + 1, 16)).alias("m"))
                      for k in range(4)])
    out = b.withColumn("_w", F.explode(words)).withColumn("pos", (F.col("_c") * 4 + F.col("_w.k")).cast("int"))
    return out.filter(F.col("pos") < dim).withColumn("m", F.col("_w.m")).drop("_c", "_blk", "_w")


def client_masks(p: DataFrame, dim: int, scale: float | None = None) -> DataFrame:
    """Per (session, client, pos): Σ over peers of ±PRG(pair key, pair salt).

    ``p`` has (session, a, b, key_hex, pair_salt). The PRG runs once per pair and
    is emitted as +m for the lower id and −m for the higher. With ``scale``
    (fixed-point mode) each pair's contribution is ``bround(m * scale)`` before
    the sum, so the masks cancel exactly in integers.
    """
    g = prg(p, "key_hex", "pair_salt", dim)
    m = F.bround(F.col("m") * F.lit(float(scale)), 0) if scale else F.col("m")
    signed = g.select("session", "pos", F.array(
        F.struct(F.col("a").alias("client_id"), m.alias("v")),
        F.struct(F.col("b").alias("client_id"), (-m).alias("v"))).alias("_s"))
    e = signed.select("session", "pos", F.explode("_s").alias("_e")).select(
        "session", "pos", "_e.client_id", "_e.v")
    return e.groupBy("session", "client_id", "pos").agg(F.sum("v").alias("mask"))


def mask_norms(masks: DataFrame) -> DataFrame:
    return masks.groupBy("session", "client_id").agg(F.sqrt(F.sum(F.col("mask") * F.col("mask"))).alias("l2"))


def apply_masks(updates: DataFrame, masks: DataFrame) -> DataFrame:
    """Long-form updates (session, client_id, pos, value) + masks; a position
    present on one side only is a dimension mismatch and fails the job."""
    j = updates.join(masks, ["session", "client_id", "pos"], "full_outer")
    bad = F.col("value").isNull() | F.col("mask").isNull()
    return j.select("session", "client_id", "pos",
                    F.when(bad, F.raise_error(F.lit("update and mask dimensions differ")))
                    .otherwise(F.col("value") + F.col("mask")).alias("masked"))


def server_sum(masked: DataFrame) -> DataFrame:
    return masked.groupBy("session", "pos").agg(F.sum("masked").alias("total"))


def mask_commitments(masks: DataFrame, salt_hex: Column | None = None) -> DataFrame:
    """Per client: HMAC(sha256(prefix || salt || client), canonical text of the mask).

    The mask vector (bounded by ``dim``) is gathered in position order and
    rendered as comma-separated ``%.17e`` values (Java formatting); the
    commitment is over that text rather than a raw float64 buffer.
    """
    sh = salt_hex if salt_hex is not None else session_salt_hex(F.col("session"))
    vec = masks.groupBy("session", "client_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "mask"))).alias("_v"))
    text = F.array_join(F.transform("_v", lambda x: F.format_string("%.17e", x["mask"])), ",")
    key_hex = F.sha2(F.concat(utf8(F.lit(COMMIT_PREFIX)), F.unhex(sh), utf8(F.col("client_id"))), 256)
    return vec.select("session", "client_id", F.size("_v").alias("dim"),
                      hmac_hex_colkey(key_hex, utf8(text)).alias("commit"))
