"""Exact search for the highest inner products with a KD-tree in each shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 5
SHARD_ROWS = 4096
#: Queries of a block; points are copied once for each block.
QUERY_BLOCK = 8192
LEAF = 64


class KdTree:
    """Median splits on the widest side, each node with the tight box of its points."""

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        self.spans, self.children = [(0, len(points))], [None]
        todo = [0]
        while todo:
            node = todo.pop()
            a, b = self.spans[node]
            if b - a > LEAF:
                part = points[self.order[a:b]]
                side = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                self.order[a:b] = self.order[a:b][np.argsort(part[:, side], kind="stable")]
                mid = (a + b) // 2
                self.children[node] = (len(self.spans), len(self.spans) + 1)
                self.spans += [(a, mid), (mid, b)]
                self.children += [None, None]
                todo += self.children[node]
        boxes = [points[self.order[a:b]] for a, b in self.spans]
        self.low, self.high = np.array([x.min(axis=0) for x in boxes]), np.array([x.max(axis=0) for x in boxes])

    def bounds(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The greatest inner product that any point of a node's box can have (queries x nodes)."""
        return np.maximum(queries, 0) @ self.high[nodes].T + np.minimum(queries, 0) @ self.low[nodes].T

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (score, id) of each query among points with another id, ids ascending in ties.

        least: a score that k points elsewhere are known to reach; what is below it need not be found. Boxes that can't
        reach it are left out on the way down the tree; the leaves that remain are visited best first, a round for all
        queries at a time, until the next leaf's bound is below the kth score so far.
        """
        n = len(queries)
        score, best = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        level, leaves, floor = [0], [], least.copy()
        while level:
            reach = (self.bounds(queries, np.array(level)) >= floor[:, None]).any(axis=0)
            level = [x for x, r in zip(level, reach, strict=True) if r]
            leaves += [x for x in level if self.children[x] is None]
            level = [c for x in level if self.children[x] for c in self.children[x]]
        if not leaves:
            return score, best
        leaves = np.array(leaves)
        bound = self.bounds(queries, leaves)
        ranked = np.argsort(-bound, axis=1, kind="stable")
        active = np.arange(n)
        for r in range(len(leaves)):
            at = ranked[active, r]
            going = bound[active, at] >= floor[active]
            active, at = active[going], at[going]
            if not len(active):
                break
            by = np.argsort(at, kind="stable")
            for group in np.split(by, np.flatnonzero(np.diff(at[by])) + 1):
                q = active[group]
                a, b = self.spans[leaves[at[group[0]]]]
                inside = self.order[a:b]
                got = queries[q] @ self.points[inside].T
                got[own[q][:, None] == ids[inside][None, :]] = -np.inf
                s = np.concatenate([score[q], got], axis=1)
                i = np.concatenate([best[q], np.broadcast_to(ids[inside], got.shape)], axis=1)
                pick = np.lexsort((i, -s), axis=1)[:, :k]
                score[q], best[q] = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)
                floor[q] = np.maximum(floor[q], score[q, -1])
        return score, best


def quantised(embedding: Column) -> Column:
    """floor(256 * x) for each component x."""
    return F.transform(embedding, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))


def usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return embedding.isNotNull() & F.coalesce(finite, F.lit(False))


def _least_ids(ids: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the best for any query: of equal vectors those of the k + 1 smallest ids, and of one id no more than k rows."""
    order = np.lexsort((ids, *points.T)) if points.shape[1] else np.argsort(ids)
    p, i = points[order], ids[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]).any(axis=1)
    other = new.copy()
    other[1:] |= i[1:] != i[:-1]
    since = lambda starts, x: x - np.maximum.accumulate(np.where(starts, x, 0))
    return order[(since(new, np.cumsum(other)) <= k) & (since(other, np.arange(len(p))) < k)]


def _own(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def top_k(vectors: DataFrame, is_query: Column, id: str = "vec_id", embedding: str = "embedding", k: int = K, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of is_query the k other rows of highest inner product of floor(256 x), ties to the smaller id.

    Rows are dealt by hash into shards of about shard_rows, queries into blocks; a task holds one shard and one block.
    First each block searches one shard, which gives every query a kth score; all other shards search with it as a
    bound, so that most of them return few rows or none. Vectors that are null or hold null or non-finite components,
    and rows without an id, take no part; vectors of different lengths are not compared. Rows with the query's own id
    are no candidates for it; of repeated rows each is a candidate. A query id with several vectors has the best of all of
    them. Ids must be whole numbers. Products are exact while they stay under 2**53. An empty table gives no rows; other
    columns of vectors, whatever their names, are not read.
    """
    rows = vectors.where(usable(F.col(embedding)) & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("vec_id"), quantised(F.col(embedding)).alias("v"), F.size(embedding).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("q"))
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q")).first()
    shards, blocks = max(1, -(-n.n // shard_rows)), max(1, -(-n.q // query_block))
    points = rows.select("vec_id", "v", "dim", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).alias("shard"))
    queries = rows.where("q").select("vec_id", "v", "dim", F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(blocks)).alias("block")).distinct()

    def search(key: tuple, ps: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "block": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        if not len(ps) or not len(qs):
            return out
        p, q = np.stack(ps["v"].to_numpy()).astype(np.float64), np.stack(qs["v"].to_numpy()).astype(np.float64)
        ids = ps["vec_id"].to_numpy()
        keep = _least_ids(ids, p, k)
        score, best = KdTree(p[keep]).search(q, qs["vec_id"].to_numpy(), ids[keep], qs["least"].fillna(-np.inf).to_numpy(dtype=np.float64), k)
        at, j = np.nonzero((score > -np.inf) & (score >= qs["least"].fillna(-np.inf).to_numpy(dtype=np.float64)[:, None]))
        return pd.DataFrame({"query_id": qs["vec_id"].to_numpy()[at], "block": qs["block"].to_numpy()[at], "vec_id": best[at, j], "score": score[at, j].astype(np.int64)})

    schema = "query_id long, block long, vec_id long, score long"
    keys = ["dim", "shard", "block"]
    # each side of a cogroup or join gets columns of its own
    home = _own(queries).withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards))).withColumn("least", F.lit(None).cast("long"))
    homes = _own(home.select(*keys).distinct())
    first = _own(points.join(homes, ["dim", "shard"])).groupBy(*keys).cogroup(home.groupBy(*keys)).applyInPandas(search, schema)
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).select("query_id", F.when(F.col("n") >= k, F.col("kth")).alias("least"))
    bounded = _own(queries).join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    dealt = _own(points).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = dealt.groupBy(*keys).cogroup(bounded.groupBy(*keys)).applyInPandas(search, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
