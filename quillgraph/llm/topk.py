"""Exact top-k inner products: norm buckets pruned by local cosine thresholds, then verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, ship, written

K = 10
SCALE = 1024
#: Rows of a bucket at most, queries of one broadcast block at most, and the longest vectors that give first bounds.
BUCKET_ROWS, QUERY_BLOCK, SEEDS = 2048, 8192, 1024
#: Coordinates of the query that coordinate pruning looks at, and the local cosine from which it is preferred.
FOCUS, COORDINATE_FROM = 4, 0.3
_SLACK = 1e-9
_MAX, _MIN = 2**63 - 1, -(2**63)


def scaled(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): floor(1024 * x) of every component x as double; rows without a finite whole vector are gone."""
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products of two blocks of integral doubles; beyond the long range they saturate."""
    if not q.size or not p.size:
        return np.zeros((len(q), len(p)), np.int64)
    bound = q.shape[1] * float(np.abs(q).max()) * float(np.abs(p).max())
    if bound < 2**53:
        return (q @ p.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in q], dtype=object) @ np.array([[int(x) for x in r] for r in p], dtype=object).T
    return np.clip(whole, _MIN, _MAX).astype(np.int64)


class Found:
    """The k best of each query so far, and with them the bound that prunes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, bound: np.ndarray):
        self.ids, self.v, self.k, self.bound = ids, vectors, k, bound.copy()
        self.norm = np.sqrt((vectors * vectors).sum(1))
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(ids)

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = (scores >= self.bound[i]) & (ids != self.ids[i])
        if not keep.any():
            return
        s, p = np.concatenate([self.best[i][0], scores[keep]]), np.concatenate([self.best[i][1], ids[keep]])
        order = np.lexsort((p, np.negative(s, dtype=object) if (s == _MIN).any() else -s))[: self.k]
        self.best[i] = s[order], p[order]
        if len(order) == self.k:
            self.bound[i] = max(self.bound[i], int(s[order[-1]]))


def search_bucket(found: Found, ids: np.ndarray, vectors: np.ndarray) -> None:
    """One bucket, its rows by falling length: per query the local cosine threshold decides how it is pruned.

    With the query's bound t, a row p can only matter if |q| |p| cos >= t. With the bucket's greatest length l the
    cosine must reach t / (|q| l): above 1 the bucket is skipped, below COORDINATE_FROM only rows of length
    t / |q| or more are verified (a prefix), else rows whose unit coordinates lie in the ranges that such a
    cosine leaves for the query's largest coordinates.
    """
    norm = np.sqrt((vectors * vectors).sum(1))
    order = np.argsort(-norm, kind="stable")
    ids, vectors, norm = ids[order], vectors[order], norm[order]
    unit = vectors / np.maximum(norm, 1e-300)[:, None]
    dense: list[int] = []
    for i in range(len(found.ids)):
        t, qn = float(found.bound[i]), found.norm[i]
        if t <= 0 or qn == 0:
            if t <= 0:
                dense.append(i)
            continue
        local = t / (qn * max(norm[0], 1e-300)) * (1 - _SLACK)
        if local > 1:
            continue
        rows = int(np.searchsorted(-norm, -(t / qn) * (1 - _SLACK), side="right"))
        if local < COORDINATE_FROM:
            found.add(i, products(found.v[i : i + 1], vectors[:rows])[0], ids[:rows])
            continue
        q = found.v[i] / qn
        alive = np.arange(rows)
        for f in np.argsort(-np.abs(q))[:FOCUS]:
            x = unit[alive, f]
            reach = q[f] * x + np.sqrt(max(0.0, 1 - q[f] ** 2)) * np.sqrt(np.maximum(0.0, 1 - x * x))
            alive = alive[reach >= local - _SLACK]
        if len(alive):
            found.add(i, products(found.v[i : i + 1], vectors[alive])[0], ids[alive])
    if dense:  # no positive bound yet: nothing can be pruned
        scores = products(found.v[dense], vectors)
        for i, row in zip(dense, scores, strict=True):
            found.add(i, row, ids)


def first_bounds(ids: np.ndarray, v: np.ndarray, seed_ids: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """Of each query the k-th greatest product with the ``seeds`` other than itself, the least number if there are fewer."""
    if len(seed_ids) < k:
        return np.full(len(ids), _MIN, dtype=np.int64)
    scores = products(v, seeds)
    scores[ids[:, None] == seed_ids[None]] = _MIN
    return np.partition(scores, -k, axis=1)[:, -k]


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest inner products of each query with all rows but its own.

    ``rows`` and ``queries`` come from ``scaled``. Ties go to the smaller id; fewer than k rows give all. Vectors of
    different dimension don't meet. A repeated id is a row of its own (and never a match of its own id); a repeated
    query is answered once. Rows are grouped by length (powers of 1.01), long groups are cut by hash, so equal
    lengths don't meet in one task. Queries come in blocks of QUERY_BLOCK, each broadcast with the SEEDS longest rows,
    from whose products every task takes its first bounds: the bytes of a block are bounded by the dimension, and the
    number of passes grows with the queries, not the memory. Empty inputs give no rows.
    """
    spark = rows.sparkSession
    ship(spark)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = written(rows.withColumn("norm", norm).withColumn("dim", F.size("v")), "vectors")
    queries = written(queries.dropDuplicates(["id"]).withColumn("dim", F.size("v")), "queries")
    level = F.when(F.col("norm") > 0, F.floor(F.log("norm") / F.log(F.lit(1.01)))).otherwise(-1)
    cells = rows.groupBy("dim", level.alias("level")).count()
    cells = cells.withColumn("parts", F.ceil(F.col("count") / BUCKET_ROWS)).select("dim", "level", "parts")
    bucketed = rows.withColumn("level", level).join(F.broadcast(cells), ["dim", "level"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    schema = "query_id long, vec_id long, score long"
    answers = None
    for dim, n in sorted((r["dim"], r["count"]) for r in queries.groupBy("dim").count().collect()):
        longest = rows.where(F.col("dim") == dim).orderBy(F.desc("norm"), "id").limit(SEEDS).collect()
        seeds = np.array([r["id"] for r in longest], np.int64), np.array([r["v"] for r in longest], float).reshape(len(longest), dim)
        blocks = -(-n // QUERY_BLOCK)
        for b in range(blocks):
            of = queries.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)) == b))
            block = of.orderBy("id").collect()  # about QUERY_BLOCK rows
            ids, v = np.array([r["id"] for r in block], np.int64), np.array([r["v"] for r in block], float).reshape(len(block), dim)
            shared = spark.sparkContext.broadcast((ids, v, *seeds))

            def search(batches: Iterator, shared=shared) -> Iterator:
                import pyarrow as pa

                state = Found(shared.value[0], shared.value[1], k, first_bounds(*shared.value, k))
                for batch in batches:
                    if batch.num_rows:
                        level, part = batch.column("level").to_numpy(), batch.column("part").to_numpy()
                        got, m = batch.column("id").to_numpy(), _matrix(batch.column("v"))
                        starts = np.flatnonzero(np.r_[True, (level[1:] != level[:-1]) | (part[1:] != part[:-1])])
                        for lo, hi in zip(starts, [*starts[1:], len(level)], strict=True):
                            search_bucket(state, got[lo:hi], m[lo:hi])
                n = [len(s) for s, _ in state.best]
                out = [np.repeat(state.ids, n), *(np.concatenate([x[j] for x in state.best] or [np.empty(0, np.int64)]) for j in (1, 0))]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

            near = bucketed.where(F.col("dim") == dim).repartition("level", "part").sortWithinPartitions(F.desc("level"), "part").select("id", "v", "level", "part")
            part = near.mapInArrow(search, schema)
            if blocks > 1:  # one block after the other, so that only one is held
                part = written(part, "block")
                shared.destroy()
            answers = part if answers is None else answers.unionByName(part)
    if answers is None:
        answers = spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark, sf_dir: str) -> DataFrame:
    """The 10 best of every vector whose id is divisible by 100; odd inputs as in ``scaled`` and ``top_k``."""
    rows = scaled(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(rows, rows.where(F.col("id") % 100 == 0))


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, p.vec_id, list_sum(list_transform(list_zip(q.x, p.x), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v p ON q.vec_id <> p.vec_id AND len(q.x) = len(p.x) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
