"""Exact top-k by inner product: tiled matrix products, partial selection per tile, tree merge.

Every row gets a row number; candidate rows are dealt into shards and query rows into blocks of
bounded size. A tile is one block against one shard, formed by a join on the pair of numbers. It is
worked through in pieces whose score matrix has a fixed size. Each tile keeps k rows per query, and
the lists of `FAN_IN` shards are merged at a time until one is left. No task holds more than a block
and a shard, or FAN_IN * k rows of a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 20
EVERY = 20
SCALE = 64
BLOCK_QUERIES = 4096
SHARD_ROWS = 8192
FAN_IN = 8
_PIECE = 256


def quantised(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id, vec: floor(scale * x) of every row that takes part.

    Rows without a vec_id, and vectors that are NULL or hold a NULL, NaN or infinite component, take
    no part. Row numbers follow the scan, so both sides of a later join see the same ones.
    """
    usable = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return (
        df.select("vec_id", "embedding")
        .withColumn("row", F.monotonically_increasing_id())
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable)
        .select(
            "row",
            F.col("vec_id").cast("long").alias("vec_id"),
            F.transform("embedding", lambda x: _floored(x.cast("double") * scale)).alias("vec"),
        )
    )


def _floored(x):
    beyond = F.raise_error(F.concat(F.lit("beyond 64 bits: "), x.cast("string"))).cast("long")
    return F.when(F.abs(x) < 2.0**63, F.floor(x)).otherwise(beyond)


def _matrix(vectors: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = vectors.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(vectors), dim)


def _products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating-point units where these are exact."""
    low = lambda m: int(np.abs(m).max(initial=0)) + 1
    if low(queries) * low(candidates) * max(1, queries.shape[1]) < 1 << 53:
        return (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    if low(queries) * low(candidates) * queries.shape[1] < 1 << 63:
        return queries @ candidates.T
    exact = queries.astype(object) @ candidates.astype(object).T
    if max(exact.max(), -exact.min()) >= 1 << 63:
        raise OverflowError("an inner product is beyond 64 bits")
    return exact.astype(np.int64)


def select(scores: np.ndarray, k: int) -> np.ndarray:
    """Per row the columns of the k highest scores; among equal scores the first columns."""
    n = scores.shape[1]
    if n <= k:
        return np.tile(np.arange(n), (len(scores), 1))
    if int(np.abs(scores).max(initial=0)) < (1 << 62) // n:
        unequal = scores * n - np.arange(n)
        return np.argpartition(unequal, n - k, axis=1)[:, n - k :]
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


_TILE = pa.schema(
    [
        ("query_row", pa.int64()),
        ("query_id", pa.int64()),
        ("shard", pa.int64()),
        ("vec_id", pa.int64()),
        ("score", pa.int64()),
    ]
)


def _tile(k: int):
    def search(key: tuple, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        shard, dim = key[1].as_py(), key[2].as_py()
        if not queries.num_rows or not candidates.num_rows:
            return _TILE.empty_table()
        candidates = candidates.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        ids, rows = candidates["vec_id"].to_numpy(), candidates["row"].to_numpy()
        matrix = _matrix(candidates["vec"], dim)
        asked, asking = queries["q_vec_id"].to_numpy(), queries["q_row"].to_numpy()
        lines = _matrix(queries["q_vec"], dim)
        out = []
        for at in range(0, len(lines), _PIECE):
            scores = _products(lines[at : at + _PIECE], matrix)
            # one more than k, since the query's own row may be among them
            best = select(scores, k + 1)
            line = np.repeat(np.arange(len(best)), best.shape[1])
            best = best.ravel()
            other = rows[best] != asking[at + line]
            line, best = line[other], best[other]
            out.append((asking[at + line], asked[at + line], ids[best], scores[line, best]))
        query_row, query_id, vec_id, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table(
            [query_row, query_id, np.full(len(query_row), shard), vec_id, score], schema=_TILE
        )

    return search


def exact_topk(
    df: DataFrame,
    k: int = K,
    every: int = EVERY,
    scale: int = SCALE,
    block_queries: int = BLOCK_QUERIES,
    shard_rows: int = SHARD_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each query row.

    Queries are rows whose vec_id is divisible by `every`. Ties go to the smaller vec_id. Only
    vectors of equal length are compared. Rows that share a vec_id are separate rows: each is a
    query of its own, and each is a candidate of the others. Fewer than k candidates give shorter
    lists, an empty table gives an empty result. Other columns are ignored.

    Vectors without components score 0 with each other. A component or a score beyond 64 bits raises.
    """
    vectors = quantised(df, scale).withColumn("dim", F.size("vec"))
    n = df.count()
    shards = max(1, math.ceil(n / shard_rows))
    blocks = max(1, math.ceil(n / every / block_queries))
    dealt = F.xxhash64("row")
    candidates = vectors.withColumn("shard", F.pmod(dealt, F.lit(shards))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    queries = (
        vectors.where(F.col("vec_id") % every == 0)
        .withColumn("block", F.pmod(dealt, F.lit(blocks)).cast("int"))
        .withColumn("shard", F.explode(F.expr(f"sequence(0L, {shards - 1}L)")))
    )
    queries = queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns))
    keys = ["block", "shard", "dim"]
    lists = (
        queries.groupBy(*(f"q_{c}" for c in keys))
        .cogroup(candidates.groupBy(*keys))
        .applyInArrow(
            _tile(k), "query_row long, query_id long, shard long, vec_id long, score long"
        )
    )
    order = [F.desc("score"), F.asc("vec_id")]
    while True:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / fan_in))
        shards = math.ceil(shards / fan_in)
        of_query = Window.partitionBy("query_row", "shard").orderBy(*order)
        lists = lists.withColumn("rank", F.row_number().over(of_query)).where(F.col("rank") <= k)
        if shards == 1:
            return lists.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
