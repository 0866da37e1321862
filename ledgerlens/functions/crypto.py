"""Keyed hashing and id canonicalisation as native Column expressions.

HMAC-SHA256 (RFC 2104) is composed from ``sha2`` and ``unhex``:
``H((K ^ opad) || H((K ^ ipad) || msg))`` with the key padded to the 64-byte
SHA-256 block. The padded keys are computed once on the driver; the per-row work
stays inside whole-stage codegen with no Python in the task.

Keys become literals in the plan (visible in ``explain``); callers that must keep
keys out of plans can use :func:`hmac_hex_udf`, a pandas UDF closing over the key.
"""

from __future__ import annotations

import hashlib
import hmac as _hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64
# Characters removed by "strip" (Python's ASCII whitespace).
WHITESPACE = " \t\n\r\x0b\x0c"
CANON_MODES = ("none", "lower", "upper", "strip", "alnum_lower")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def padded_keys(key: bytes) -> tuple[bytes, bytes]:
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256_hex(msg: Column, key: bytes) -> Column:
    """Lower-case hex HMAC-SHA256 of a binary column."""
    ipad, opad = padded_keys(key)
    inner = F.sha2(F.concat(F.unhex(F.lit(ipad.hex())), msg), 256)
    return F.sha2(F.concat(F.unhex(F.lit(opad.hex())), F.unhex(inner)), 256)


def utf8(c: Column | str) -> Column:
    return F.encode(_col(c).cast("string"), "UTF-8")


def canonize(c: Column | str, mode: str = "none") -> Column:
    """Canonical id text: null → ''; ``none``/``strip`` trim outer whitespace,
    ``lower``/``upper`` trim and fold case, ``alnum_lower`` keeps [0-9a-zA-Z] lower-cased."""
    if mode not in CANON_MODES:
        raise ValueError(f"unknown canonicalisation {mode!r}")
    s = F.coalesce(_col(c).cast("string"), F.lit(""))
    if mode == "alnum_lower":
        return F.lower(F.regexp_replace(s, "[^0-9a-zA-Z]+", ""))
    s = F.btrim(s, F.lit(WHITESPACE))
    if mode == "lower":
        return F.lower(s)
    if mode == "upper":
        return F.upper(s)
    return s


def hmac_token(c: Column | str, key: bytes, salt: bytes = b"", canon: str | None = "none") -> Column:
    """Token = hex HMAC(key, salt || utf8(canonize(id)))."""
    text = canonize(c, canon) if canon else _col(c).cast("string")
    msg = utf8(text)
    if salt:
        msg = F.concat(F.unhex(F.lit(salt.hex())), msg)
    return hmac_sha256_hex(msg, key)


def sha256_hex(c: Column | str) -> Column:
    """SHA-256 of a string (UTF-8) or binary column, hex."""
    return F.sha2(_col(c), 256)


def pair_salt(session_salt: bytes, a: Column, b: Column) -> Column:
    """``sha256(salt || '|' || min(a,b) || '|' || max(a,b))`` as hex."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    msg = F.concat(F.unhex(F.lit(session_salt.hex())), utf8(F.concat(F.lit("|"), lo, F.lit("|"), hi)))
    return F.sha2(msg, 256)


def hmac_hex_udf(key: bytes, salt: bytes = b""):
    """Arrow-batched alternative that keeps the key out of the query plan."""

    @F.pandas_udf("string")
    def _tok(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else _hmac.new(key, salt + str(v).encode("utf-8", "ignore"),
                                         hashlib.sha256).hexdigest())
    return _tok
