"""Registered queries: canonicalisation, keyed tokens, intersection and filters.

Parties (ours): the five order-priority groups of ``txn``; a party's ids are the
``nameOrig`` of its transactions, rendered with party-specific case and blank
variants so that canonicalisation matters. All rows of ``txn`` are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ledgerlens.functions import crypto as C
from ledgerlens.operators import psi
from ledgerlens.plans.registry import TXN_SQL, register
from ledgerlens.session import scratch_path
from ledgerlens.sources import io, tables as T

# Fixed test secrets (literals for tests and oracles, never production keys).
KEY = bytes(range(32))
SALT = bytes(range(0xA0, 0xB0))
CANON = "lower"

_WS_SQL = "(' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


def sql_canon(x: str, mode: str) -> str:
    s = f"coalesce(cast({x} as varchar), '')"
    if mode == "alnum_lower":
        return f"lower(regexp_replace({s}, '[^0-9a-zA-Z]+', '', 'g'))"
    s = f"trim({s}, {_WS_SQL})"
    return {"lower": f"lower({s})", "upper": f"upper({s})"}.get(mode, s)


def sql_hmac(msg_blob: str, key: bytes) -> str:
    ipad, opad = C.padded_keys(key)
    return (f"sha256(unhex('{opad.hex()}') || unhex(sha256(unhex('{ipad.hex()}') || {msg_blob})))")


def sql_token(x: str, key: bytes, salt: bytes = b"", canon: str | None = "none") -> str:
    text = sql_canon(x, canon) if canon else f"cast({x} as varchar)"
    msg = f"encode({text})"
    if salt:
        msg = f"unhex('{salt.hex()}') || {msg}"
    return sql_hmac(msg, key)


PSI_SQL = TXN_SQL + f""",
psi_ids as (
  select txn_id, type as party, nameOrig,
         case type when '2-HIGH' then lower(nameOrig)
                   when '3-MEDIUM' then concat('  ', nameOrig, ' ')
                   when '4-NOT SPECIFIED' then concat(chr(9), lower(nameOrig))
                   else nameOrig end as id
  from txn),
tok as (select party, txn_id, id, {sql_token('id', KEY, SALT, CANON)} as token from psi_ids),
inter as (select token from tok group by token
          having count(distinct party) = (select count(distinct party) from tok))"""


def psi_ids(spark, sf):
    t = T.txn(spark, sf)
    ty, n = F.col("type"), F.col("nameOrig")
    rid = (F.when(ty == "2-HIGH", F.lower(n))
           .when(ty == "3-MEDIUM", F.concat(F.lit("  "), n, F.lit(" ")))
           .when(ty == "4-NOT SPECIFIED", F.concat(F.lit("\t"), F.lower(n)))
           .otherwise(n))
    return t.select("txn_id", ty.alias("party"), "nameOrig", rid.alias("id"))


def party_tokens(spark, sf):
    return psi.tokenize(psi_ids(spark, sf), "id", KEY, SALT, CANON, keep=["party", "txn_id"])


def intersection(spark, sf, tokens=None):
    if tokens is None:  # each id of a party is hashed once
        tokens = psi.tokenize(psi_ids(spark, sf).select("party", "id").distinct(), "id", KEY, SALT, CANON, keep=["party"])
    return psi.intersect(tokens, psi.parties_of(psi_ids(spark, sf)))


@register("canonize_ids", sql=f"""
with {PSI_SQL}
select txn_id, party, id as raw, {sql_canon('id', 'none')} as canon_none, {sql_canon('id', 'lower')} as canon_lower,
       {sql_canon('id', 'upper')} as canon_upper, {sql_canon('id', 'strip')} as canon_strip,
       {sql_canon('id', 'alnum_lower')} as canon_alnum_lower
from psi_ids""")
def canonize_ids(spark, sf):
    d = psi_ids(spark, sf)
    return d.select("txn_id", "party", F.col("id").alias("raw"),
                    *[C.canonize("id", m).alias(f"canon_{m}") for m in C.CANON_MODES])


@register("hmac_tokens", sql=f"with {PSI_SQL} select party, txn_id, token from tok")
def hmac_tokens(spark, sf):
    return party_tokens(spark, sf)


@register("id_token_map", sql=f"with {PSI_SQL} select distinct id, token from tok")
def id_token_map(spark, sf):
    return psi.id_token_map(psi_ids(spark, sf), "id", KEY, SALT, CANON)


@register("id_hash_map", sql=f"""
with {TXN_SQL}
select distinct nameOrig as id, {sql_token('nameOrig', KEY, b'', None)} as hmac, 'nameOrig' as "column" from txn
union
select distinct nameDest, {sql_token('nameDest', KEY, b'', None)}, 'nameDest' from txn""")
def id_hash_map(spark, sf):
    return psi.id_hash_map(T.txn(spark, sf), ["nameOrig", "nameDest"], KEY)


@register("psi_intersect", sql=f"with {PSI_SQL} select token from inter")
def psi_intersect(spark, sf):
    return intersection(spark, sf)


@register("psi_counts", sql=f"""
with {PSI_SQL},
base as (select party, count(*) as n_rows, count(distinct token) as n_distinct from tok group by party),
hit as (select party, count(*) as n_intersection
        from (select distinct party, token from tok) d where token in (select token from inter) group by party)
select base.party, n_rows, n_distinct, coalesce(n_intersection, 0) as n_intersection
from base left join hit on base.party = hit.party""")
def psi_counts(spark, sf):
    tok = party_tokens(spark, sf)
    return psi.party_counts(tok, intersection(spark, sf, tok))


@register("psi_empty_party", sql=f"""
with {PSI_SQL}
select party, count(*) as n_rows, count(distinct token) as n_distinct, cast(0 as bigint) as n_intersection from tok group by party""")
def psi_empty_party(spark, sf):
    """A sixth party whose ids are all null has no token, so no token is held by every party."""
    ids = psi_ids(spark, sf)
    silent = ids.select("txn_id", F.lit("6-SILENT").alias("party"), "nameOrig", F.lit(None).cast("string").alias("id"))
    both = ids.unionByName(silent)
    tok = psi.tokenize(both, "id", KEY, SALT, CANON, keep=["party", "txn_id"])
    return psi.party_counts(tok, psi.intersect(tok, psi.parties_of(both)))


@register("psi_semi_filter", sql=f"""
with {PSI_SQL}
select txn_id, nameOrig, amount, isFraud from txn
where {sql_token('nameOrig', KEY, SALT, CANON)} in (select token from inter)""")
def psi_semi_filter(spark, sf):
    inter = intersection(spark, sf)
    t = T.txn(spark, sf).select("txn_id", "nameOrig", "amount", "isFraud")
    return psi.semi_filter(t, "nameOrig", inter, KEY, SALT, CANON)


POSITIONAL_SQL = f"""
with {PSI_SQL},
r as (select party, txn_id, row_number() over (partition by party order by txn_id) - 1 as row_idx from psi_ids),
k as (select party, token, row_number() over (partition by party order by txn_id) - 1 as row_idx from tok)
select r.party, r.txn_id, r.row_idx, k.token from r join k on r.party = k.party and r.row_idx = k.row_idx
where k.token in (select token from inter)"""


@register("positional_filter", sql=POSITIONAL_SQL)
def positional_filter(spark, sf):
    """The rows of every party and its token list are aligned by position (row_idx)."""
    tok = party_tokens(spark, sf)
    rows = psi.with_row_idx(psi_ids(spark, sf).select("party", "txn_id"), "txn_id", ["party"])
    toks = psi.with_row_idx(tok.select("party", "txn_id", "token"), "txn_id", ["party"]).drop("txn_id")
    return psi.positional_filter(rows, toks, intersection(spark, sf, tok), ["party"]).select("party", "txn_id", "row_idx", "token")


@register("positional_filter_files", sql=POSITIONAL_SQL)
def positional_filter_files(spark, sf):
    """The same from files: the key from its document, every party's tokens from the ordered file it wrote, the intersection from text lines."""
    root = scratch_path(spark, "psi")
    io.write_key_document(spark, KEY, SALT, f"{root}/hmac_key.json")
    key, salt = io.read_key_document(spark, f"{root}/hmac_key.json")
    ids = psi_ids(spark, sf).select("party", "txn_id", "id")
    tok = psi.with_row_idx(psi.tokenize(ids, "id", key, salt, CANON, keep=["party", "txn_id"]).select("party", "txn_id", "token"), "txn_id", ["party"])
    parties = psi.parties_of(ids)
    for p in parties:
        io.write_tokens(tok.filter(F.col("party") == p), f"{root}/{p}", "row_idx")
    read = [io.read_placed_tokens(spark, f"{root}/{p}").withColumn("party", F.lit(p)) for p in parties]
    toks = reduce(lambda a, b: a.unionByName(b), read)
    psi.intersect(toks, parties).select("token").write.text(f"{root}/inter.txt")
    rows = psi.with_row_idx(ids.select("party", "txn_id"), "txn_id", ["party"])
    return psi.positional_filter(rows, toks, io.read_tokens(spark, f"{root}/inter.txt"), ["party"]).select("party", "txn_id", "row_idx", "token")


@register("checksum_rows", sql="""
select doc_id, sha256(text) as sha256, cast(strlen(text) as bigint) as n_bytes from documents""")
def checksum_rows(spark, sf):
    d = T.table(spark, sf, "documents")
    return d.select("doc_id", C.sha256_hex("text").alias("sha256"),
                    F.octet_length("text").cast("bigint").alias("n_bytes"))
