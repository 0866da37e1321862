"""Registered queries: rosters, pairs, salts, masks and the masked sum.

Rosters (ours): a session per round (day of the event stream); its clients are the
parties with an update in that round. Secrets are "provided" for pairs whose clients
both return in the next round. The masked-sum example uses ``embeddings``: one
session, a client per label, each client's update is the sum of its vectors.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import rounds as R, secagg as S
from ledgerlens.plans.registry import TXN_SQL, register, rnd
from ledgerlens.sources import tables as T

MASK_DIM = 8
N_MASK_CLIENTS = 12  # parties of the masked rounds
FIXED_SCALE = 1000.0

EV_SQL = f"""
r1 as (select distinct cast(datediff('day', cast('{T.ROUND_ORIGIN}' as date), cast(ts as date)) + 1 as integer) as session,
              concat('c', cast(user_id % {N_MASK_CLIENTS} as varchar)) as client_id from events),
r2 as (select session - 1 as session, client_id from r1),
pairs as (select a.session, a.client_id as a, b.client_id as b
          from r1 a join r1 b on a.session = b.session and a.client_id < b.client_id)"""


def _roster(spark, sf, ahead=0):
    """Clients of each round of all events; ``ahead``: those of so many rounds later."""
    e = T.table(spark, sf, "events").select(
        (T.round_col(F.col("ts")) - ahead).alias("session"),
        F.concat(F.lit("c"), (F.col("user_id") % N_MASK_CLIENTS).cast("string")).alias("client_id"))
    return S.roster(e, "session", "client_id")


def _pair_key(p):
    """Per-pair test secret (ours): sha256 of the pair's names."""
    return p.withColumn("key_hex", F.sha2(F.concat_ws("|", "session", "a", "b", F.lit("key")), 256))


@register("distinct_clients", sql=f"""
with {EV_SQL}
select session, array_to_string(list_sort(list(client_id)), ',') as clients, count(*) as n_clients,
       count(*) >= 2 as ok
from r1 group by session""")
def distinct_clients(spark, sf):
    return S.roster_summary(_roster(spark, sf))


@register("client_pairs", sql=f"with {EV_SQL} select session, a, b from pairs")
def client_pairs(spark, sf):
    return S.pairs(_roster(spark, sf))


@register("pair_salts", sql=f"""
with {EV_SQL}
select session, a, b,
       sha256(unhex(md5(cast(session as varchar))) || encode('|' || least(a, b) || '|' || greatest(a, b))) as pair_salt
from pairs""")
def pair_salts(spark, sf):
    return S.pair_salts(S.pairs(_roster(spark, sf)))


@register("missing_peers", sql=f"""
with {EV_SQL},
expected as (select session, a as client_id, b as peer from pairs union all select session, b, a from pairs),
provided as (select x.session, x.client_id, y.client_id as peer
             from r2 x join r2 y on x.session = y.session and x.client_id <> y.client_id)
select * from expected e
where not exists (select 1 from provided p
                  where p.session = e.session and p.client_id = e.client_id and p.peer = e.peer)""")
def missing_peers(spark, sf):
    expected = S.directed(S.pairs(_roster(spark, sf)))
    provided = S.directed(S.pairs(_roster(spark, sf, 1)))
    return S.missing_peers(expected, provided)


def _xor_sql(key: str, byte: int) -> str:
    """A 64-digit hex key with each byte XORed with ``byte``, four bytes at a time."""
    word = int.from_bytes(bytes([byte]) * 4, "big")
    return " || ".join(f"printf('%08X', xor(cast('0x' || substr({key}, {8 * i + 1}, 8) as ubigint), {word}::ubigint))" for i in range(8))


def _u64_sql(k: int) -> str:
    """The k-th eight bytes of block ``h``, little-endian, as a double in (-0.5, 0.5)."""
    digits = " || ".join(f"substr(h, {16 * k + 15 - 2 * i}, 2)" for i in range(8))
    return f"cast(cast('0x' || {digits} as ubigint) as double) / 18446744073709551616.0e0 - 0.5e0"


def masks_sql(pairs: str, dim: int) -> str:
    """CTEs from ``pairs`` (session, a, b) to ``masks`` (session, client_id, pos, mask)."""
    return f"""
keyed as (select session, a, b, sha256(cast(session as varchar) || '|' || a || '|' || b || '|key') as k,
                 unhex(sha256(unhex(md5(cast(session as varchar))) || encode('|' || least(a, b) || '|' || greatest(a, b)))) as salt
          from {pairs}),
pads as (select session, a, b, salt, unhex({_xor_sql("k", 0x36)} || repeat('36', 32)) as ip,
                unhex({_xor_sql("k", 0x5C)} || repeat('5c', 32)) as op from keyed),
ctr as (select *, unnest(range(0, {(dim + 3) // 4})) as c from pads),
blk as (select session, a, b, c, sha256(op || unhex(sha256(ip || salt || unhex(printf('%016X', c))))) as h from ctr),
wrd as (select session, a, b, c * 4 + k as pos, m from (
          {" union all ".join(f"select session, a, b, c, {k} as k, {_u64_sql(k)} as m from blk" for k in range(4))}) z
        where c * 4 + k < {dim}),
masks as (select session, client_id, cast(pos as integer) as pos, sum(v) as mask
          from (select session, a as client_id, pos, m as v from wrd union all select session, b, pos, -m from wrd) y
          group by all)"""


@register("client_masks", sql=f"""
with {EV_SQL}, {masks_sql("pairs", MASK_DIM)},
norm as (select session, client_id, sqrt(sum(mask * mask)) as l2 from masks group by all)
select session, client_id, pos, round(mask, 9) as mask, round(l2, 9) as l2 from masks join norm using (session, client_id)""")
def client_masks(spark, sf):
    """Per client: Σ ±PRG over its pairs (float mode)."""
    p = _pair_key(S.pair_salts(S.pairs(_roster(spark, sf))))
    m = S.client_masks(p, MASK_DIM)
    return m.join(S.mask_norms(m), ["session", "client_id"]).select(
        "session", "client_id", "pos", rnd("mask", 9).alias("mask"), rnd("l2", 9).alias("l2"))


def _emb_updates(spark, sf):
    e = T.table(spark, sf, "embeddings").select(
        F.lit("emb").alias("session"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("client_id"),
        "embedding")
    upd = R.vector_sum(e, "embedding", ["session", "client_id"]).withColumnRenamed("total", "value")
    ros = e.select("session", "client_id").distinct()
    return upd, ros


def _emb_masked(spark, sf):
    upd, ros = _emb_updates(spark, sf)
    dim = R.check_dims(T.table(spark, sf, "embeddings"), "embedding")
    p = _pair_key(S.pair_salts(S.pairs(ros)))
    return S.apply_masks(upd, S.client_masks(p, dim))


EMB_DIM = 64  # of the embeddings table; the query itself reads it from the data


@register("masked_updates", sql=f"""
with upd as (select 'emb' as session, concat('L', cast(label as varchar)) as client_id, cast(i - 1 as integer) as pos,
                    sum(cast(v as double)) as value
             from (select label, unnest(embedding) as v, unnest(range(1, len(embedding) + 1)) as i from embeddings) z group by all),
ros as (select distinct session, client_id from upd),
pairs as (select x.session, x.client_id as a, y.client_id as b from ros x join ros y on x.session = y.session and x.client_id < y.client_id),
{masks_sql("pairs", EMB_DIM)}
select session, client_id, pos, round(value + mask, 6) as masked from upd join masks using (session, client_id, pos)""")
def masked_updates(spark, sf):
    """Each label-client's vector sum plus its pairwise mask."""
    return _emb_masked(spark, sf).select("session", "client_id", "pos", rnd("masked").alias("masked"))


@register("masked_sum", sql="""
select cast(i - 1 as integer) as pos, round(sum(cast(v as double)), 6) as total
from (select unnest(embedding) as v, unnest(range(1, len(embedding) + 1)) as i from embeddings) z group by i""")
def masked_sum(spark, sf):
    """Server sum of masked updates; masks cancel, so it equals the plain sum."""
    s = S.server_sum(_emb_masked(spark, sf))
    return s.select("pos", rnd("total").alias("total"))


@register("fixed_point", sql=f"""
select vec_id, cast(i - 1 as integer) as pos, round_even(cast(v as double) * {FIXED_SCALE}, 0) as fx
from (select vec_id, unnest(embedding) as v, unnest(range(1, len(embedding) + 1)) as i from embeddings) z""")
def fixed_point(spark, sf):
    e = T.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return e.select("vec_id", F.col("pos").cast("int").alias("pos"),
                    F.bround(F.col("v").cast("double") * F.lit(FIXED_SCALE), 0).alias("fx"))


# Fixed test key material for the encrypted-sum query (two 128-bit primes; test
# literals only, never production keys).
TEST_P = 170141183460469231731687303715884118099
TEST_Q = 170141183460469231731687303715884205727


@register("encrypted_sum", sql=f"""
with {TXN_SQL}
select party, cast(sum(cast(round(amount * 100) as bigint)) as bigint) as total, count(*) as n
from txn group by party""")
def encrypted_sum(spark, sf):
    """Per-party totals of amounts in cents: each party sums its own rows in the clear,
    one encryption per party; only those totals are decrypted by the key holder."""
    from ledgerlens.operators import paillier as PL
    sk = PL.PrivateKey.from_primes(TEST_P, TEST_Q)
    t = T.party_txn(spark, sf).select("party", F.round(F.col("amount") * 100).cast("bigint").alias("cents"))
    rows = PL.decrypt_frame(PL.encrypted_sums(t, "cents", sk.public, ["party"]), sk)
    return spark.createDataFrame([(int(p), int(s), int(n)) for p, s, n in rows], "party int, total bigint, n bigint")
