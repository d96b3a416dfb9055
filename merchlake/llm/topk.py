"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors lie in blocks; each block has its vectors sorted by every dimension. A query walks down all the
sorted lists at once, from the end its sign prefers, and computes the full product of whatever it meets
first. What it has not met cannot score more than the values at which the lists stand: when that bound
falls below the k-th best score, the block is done.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
QUERY_ROWS = 2048
FIRST_DEPTH = 8


def search_block(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of one block for each query: (query_id, vec_id, score), ties to smaller ids."""
    by_id = np.argsort(ids, kind="stable")
    vectors, ids = vectors[by_id], ids[by_id]
    rows, width = vectors.shape
    order = np.argsort(vectors, axis=0, kind="stable")  # ascending lists of row numbers, one per dimension
    found = []
    for query, own in zip(queries, query_ids.tolist()):
        used = np.flatnonzero(query)
        weights, down = query[used], query[used] > 0
        met = np.zeros(rows, bool)
        best_rows, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, FIRST_DEPTH
        while depth < rows:
            end = min(rows, depth + step)
            if len(used):
                high, low = order[rows - end:rows - depth][:, used[down]], order[depth:end][:, used[~down]]
                seen = np.zeros(rows, bool)
                seen[high.ravel()] = True
                seen[low.ravel()] = True
                fresh = np.flatnonzero(seen & ~met)
                met |= seen
                edge = np.where(down, order[rows - end, used], order[end - 1, used])
                bound = int(vectors[edge, used] @ weights)
            else:
                fresh, bound, end = np.arange(rows), 0, rows
            fresh = fresh[ids[fresh] != own]
            best_rows = np.concatenate((best_rows, fresh))
            best = np.concatenate((best, vectors[fresh] @ query))
            keep = np.lexsort((best_rows, -best))[:k]
            best_rows, best = best_rows[keep], best[keep]
            depth, step = end, step * 2
            # An unmet row may tie at the bound with a smaller id, so only a lower bound ends the walk.
            if len(best) == k and best[-1] > bound:
                break
        found.append(pd.DataFrame({"query_id": own, "vec_id": ids[best_rows], "score": best}))
    return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)


def search_exactly(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """As ``search_block``, by full products of whole numbers of any length, for the few vectors that need them."""
    found = []
    whole = vectors.astype(object)
    for query, own in zip(queries.astype(object), query_ids.tolist()):
        scores = whole @ query
        best = sorted((-score, other) for score, other in zip(scores.tolist(), ids.tolist()) if other != own)[:k]
        found.extend((own, other, -score) for score, other in best)
    return found


def search_any(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of one block for each query, with ``fits``: whether the score fits a long.

    Vectors whose products with each other stay within 64 bits are searched by lists; products with a
    longer one are whole numbers of any length. A score below a long's least stands as that.
    """
    limit = math.isqrt((2**63 - 1) // vectors.shape[1])
    wide, asks_wide = ((peaks.max(axis=1) > limit) | (peaks.min(axis=1) < -limit) for peaks in (vectors, queries))
    near = search_block(vectors[~wide], ids[~wide], queries[~asks_wide], query_ids[~asks_wide], k).assign(fits=True)
    far = search_exactly(vectors[wide], ids[wide], queries[~asks_wide], query_ids[~asks_wide], k) if wide.any() else []
    far += search_exactly(vectors, ids, queries[asks_wide], query_ids[asks_wide], k)
    for own, other, score in far:
        if score >= 2**63:
            # It is among the k best, or k others above it do not fit either.
            raise OverflowError(f"the inner product of vectors {own} and {other} does not fit a long: {score}")
    rest = pd.DataFrame([(own, other, max(score, -2**63), score >= -2**63) for own, other, score in far], columns=["query_id", "vec_id", "score", "fits"])
    return pd.concat((near, rest.astype({"query_id": "int64", "vec_id": "int64", "score": "int64", "fits": "bool"})), ignore_index=True) if far else near


def _matrix(values: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(values), width), np.int64)
    for at, value in enumerate(values):
        out[at, :len(value)] = value
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k highest integer inner products of every query with all other vectors.

    Components become floor(scale * x). ``is_query`` picks the queries among the rows. Vectors that are
    null, hold a null or a non-finite component, have no key, or a component that does not fit a long after
    scaling take no part. All others do; a score that does not fit a long is refused by name. A shorter vector counts as filled up with zeros. A query is
    not compared with rows of its own key; rows with equal keys are candidates each. Returns ``query_id``,
    ``rank`` (from 1), ``vec_id``, ``score``; fewer than k rows where there are fewer candidates.

    Blocks of vectors meet blocks of queries; both have a bounded number of rows.
    """
    number = F.transform(F.col(vector), lambda x: F.col("_scale") * x.cast("double"))
    bounded = F.forall(number, lambda x: F.coalesce((x >= -2.0**63) & (x < 2.0**63) & ~F.isnan(x), F.lit(False)))
    whole = F.transform(number, lambda x: F.floor(x).cast("bigint"))
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector), is_query.alias("asked")).withColumn("_scale", F.lit(scale))
    rows = rows.filter(F.col("id").isNotNull() & F.col(vector).isNotNull() & bounded).select("id", whole.alias("v"), F.coalesce("asked", F.lit(False)).alias("asked"))
    count, asked, width = rows.agg(F.count("*"), F.count_if("asked"), F.max(F.size("v"))).first()
    blocks, chunks, width = max(1, -(-count // BLOCK_ROWS)), max(1, -(-(asked or 0) // QUERY_ROWS)), max(width or 0, 1)
    held = rows.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("bigint").alias("block"),
                       F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    queries = rows.filter("asked").select("id", "v", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"),
                                          F.pmod(F.xxhash64("id", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk"))

    def search(own: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        if own.empty or questions.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "fits": []}, dtype=np.int64).astype({"fits": "bool"})
        return search_any(_matrix(own["v"], width), own["id"].to_numpy(np.int64), _matrix(questions["v"], width),
                            questions["id"].to_numpy(np.int64), k)

    found = held.groupBy("block", "chunk").cogroup(queries.groupBy("block", "chunk")).applyInPandas(
        search, "query_id bigint, vec_id bigint, score bigint, fits boolean")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("fits"), "vec_id")))
    refused = F.raise_error(F.concat(F.lit("the inner product does not fit a long, of vectors "), F.col("query_id"), F.lit(" and "), F.col("vec_id")))
    score = F.when(F.col("fits"), F.col("score")).otherwise(refused.cast("bigint")).alias("score")
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score)
