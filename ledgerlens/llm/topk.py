"""Exact top-k inner products by no-random-access aggregation.

Candidates are cut into blocks; a block holds one sorted list for each dimension. For
a block of queries the lists are read from their best ends in steps. Every candidate
then has a lower bound (what was seen, plus the least its unseen lists can add) and an
upper bound (what was seen, plus the list heads it has not passed). Reading stops when
no outsider's upper bound reaches the k-th best lower bound; the few candidates left
get their final scores. A block of candidates moves once and its lists are sorted once; the
queries go to every block.

Scores are integers: every component x becomes floor(1024 * x). Ties go to the smaller
id. Vectors that are null, empty, or hold null or non-finite components take no part,
nor do rows with a null id; a query meets only vectors of its own length. A query is a row:
its candidates are all other rows, also one of the same id, and a repeated query row
gets its own ranks. Vectors so large that a score could reach 2 ** 53 raise an error.
An empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import stored

K, SCALE = 10, 1024
#: Rows of a candidate block and of a query block; a block also holds at most ``BYTES`` of components.
BLOCK, QUERIES, BYTES = 2048, 256, 1 << 24
#: Sums below this are exact in doubles.
EXACT = 2.0 ** 53


class Lists:
    """The sorted lists of a block: for each dimension the places of its rows by falling value."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, keys: np.ndarray | None = None):
        self.ids, self.rows, self.keys = ids, rows, ids if keys is None else keys
        self.rank = np.argsort(np.argsort(-rows, axis=0, kind="stable"), axis=0, kind="stable")
        self.value = -np.sort(-rows, axis=0)


def block_topk(q_keys: np.ndarray, q: np.ndarray, lists: Lists, best: list[tuple[np.ndarray, np.ndarray]], k: int) -> int:
    """Merges the block's k best for each query into ``best`` [(scores, ids)]; returns list entries read for each dimension.

    Lists are read from both ends, twice as far in every step. For a query component above 0 an entry counts once it is passed
    from the top, until then it lies between the last value read there and the end of the list; below 0 likewise from the
    bottom. So both bounds of all pairs are matrix products over the entries passed and the list heads.
    """
    n = len(lists.rows)
    if lists.rows.size and q.size and np.abs(q).max() * np.abs(lists.rows).max() * q.shape[1] >= EXACT:
        raise ValueError("components too large: scores of 2 ** 53 and more are not exact")
    signs = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)
    floor_ = np.array([s[k - 1] if len(s) >= k else -np.inf for s, _ in best])
    alive = np.ones((len(q), n), bool)
    alive[q_keys[:, None] == lists.keys[None, :]] = False
    open_q, some, depth = np.arange(len(q)), np.arange(n), 0
    while len(open_q) and len(some):
        depth = min(n, max(64, n // 8, 2 * depth))
        rows, rank = lists.rows[some], lists.rank[some]
        top, low = lists.value[depth - 1], lists.value[n - depth]
        from_top, from_low = rank < depth, rank >= n - depth
        most = np.concatenate([np.where(from_top, rows, top), np.where(from_low, rows, low)], axis=1)
        upper = signs[open_q] @ most.T
        live = alive[np.ix_(open_q, some)]
        if depth < n:
            least = np.concatenate([np.where(from_top, rows, lists.value[-1]), np.where(from_low, rows, lists.value[0])], axis=1)
            lower = np.where(live, signs[open_q] @ least.T, -np.inf)
        else:
            lower = np.where(live, upper, -np.inf)
        if len(some) > k:
            floor_[open_q] = np.maximum(floor_[open_q], np.partition(lower, len(some) - k, axis=1)[:, len(some) - k])
        live &= upper >= floor_[open_q][:, None] - 0.5
        left = live.sum(1)
        done = (left <= max(2 * k, n // 64)) | (depth >= n)
        for x, keep_x in zip(open_q[done], live[done]):  # resolve final scores
            c = some[keep_x]
            s = np.concatenate([best[x][0], lists.rows[c] @ q[x]])
            i = np.concatenate([best[x][1], lists.ids[c]])
            keep = np.lexsort((i, -s))[:k]
            best[x] = (s[keep], i[keep])
        alive[np.ix_(open_q, some)] = live
        open_q = open_q[~done]
        some = some[live[~done].any(0)]
    return depth


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    x: Column = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    df = df.select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    df = df.filter(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & ~F.coalesce(bad, F.lit(False)))
    return df.select(F.monotonically_increasing_id().alias("row"), "id", F.size("x").alias("dims"), F.transform("x", lambda v: F.floor(v * SCALE).cast("long")).alias("x"))


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(dims, block, keys, ids, xs): about ``size`` rows a block, dealt by the row's hash; xs is the rows' components one after the other."""
    room = F.least(F.lit(size), F.greatest(F.lit(1), F.floor(F.lit(BYTES) / (F.col("dims") * 8))))
    per = rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).select("dims", F.ceil(F.col("n") / room).alias("blocks"))
    dealt = rows.join(per, "dims").withColumn("block", F.pmod(F.xxhash64("row", F.lit(size)), F.col("blocks")).cast("int"))
    return stored(dealt.groupBy("dims", "block").agg(F.collect_list(F.struct("row", "id", "x")).alias("r"))
                  .select("dims", "block", F.col("r.row").alias("keys"), F.col("r.id").alias("ids"), F.flatten("r.x").alias("xs")), name)


def exact_topk(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` (over column ``id``) holds, its k best other rows."""
    rows = stored(_usable(vectors, id_col, vec_col), "vectors")  # written, so that a row keeps its key
    asked = _blocks(rows.filter(is_query), QUERIES, "query-blocks")
    cand = _blocks(rows, BLOCK, "candidate-blocks")
    # the stated query set meets all rows, block by block: the queries go to each block of candidates, which moves once
    places = cand.select("dims", "block").withColumnRenamed("block", "run")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = asked.join(places, "dims").select("dims", "run", F.col("keys").alias("q_keys"), F.col("ids").alias("q_ids"), F.col("xs").alias("qs"))
    right = cand.withColumnRenamed("block", "run").repartition(parts, "dims", "run")
    met = left.repartition(parts, "dims", "run").join(right, ["dims", "run"]).select("dims", "run", "q_keys", "q_ids", "qs", "keys", "ids", "xs")

    def search(batches):
        flat = lambda a: np.asarray(a.values.to_numpy(zero_copy_only=False), np.int64)
        held, lists = None, None  # rows of one block of candidates follow each other: its lists are sorted once
        for batch in batches:
            for at in range(batch.num_rows):
                dims, run, q_keys, q_ids, qs, keys, ids, xs = (c[at] for c in batch.columns)
                place = (dims.as_py(), run.as_py())
                if held != place:
                    held, lists = place, Lists(flat(ids), flat(xs).reshape(-1, place[0]).astype(np.float64), flat(keys))
                q_keys, q_ids, q = flat(q_keys), flat(q_ids), flat(qs).reshape(-1, place[0]).astype(np.float64)
                best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in q_ids]
                block_topk(q_keys, q, lists, best, k)
                times = [len(s) for s, _ in best]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(q_keys, times)), pa.array(np.repeat(q_ids, times)),
                    pa.array(np.concatenate([i for _, i in best]).astype(np.int64)),
                    pa.array(np.concatenate([s for s, _ in best]).astype(np.int64))], names=["query", "query_id", "vec_id", "score"])

    found = met.mapInArrow(search, "query bigint, query_id bigint, vec_id bigint, score bigint")
    by = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
