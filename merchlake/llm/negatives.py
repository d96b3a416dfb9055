"""Hard negatives by BOND: blocks of vectors are read dimension by dimension, in each anchor's own order.

A block holds its vectors as columns, one per dimension, with the smallest and largest value of each. An
anchor adds up its products over the dimensions of its largest components first. What the others can still
add lies between two sums of products with those extremes, so every candidate has a lower and an upper
bound on its score, and the set of candidates shrinks with each few dimensions. One scan finds an anchor's
positives, a second its negatives: there a candidate stays while its bounds meet the window of a positive
that is not yet full of better ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from merchlake.llm.common import interim, staged

BLOCK_NUMBERS = 2**19  # components held of a block of vectors, and of a chunk of anchors
STEP = 8  # dimensions read between two looks at the bounds
LONG = 2**63


def whole_numbers(values: list, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) of every component, rows filled up with zeros; whole numbers of any length if need be."""
    plain = np.zeros((len(values), width))
    for at, value in enumerate(values):
        plain[at, :len(value)] = value
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * plain)
    if not scaled.size or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    # From 2^53 on a double is whole, so the product is taken in whole numbers.
    far = np.vectorize(lambda x: math.floor(scale * x) if abs(x) < 2.0**53 else math.floor(scale) * int(x), otypes=[object])
    return far(plain)


def fitting(one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices in the fastest numbers that keep sums of their products exact."""
    peaks = [int(max(abs(part.max()), abs(part.min()))) if part.size else 0 for part in (one, other)]
    bound = peaks[0] * peaks[1] * one.shape[1]
    kind = np.float64 if bound < 2**53 and max(peaks) < 2**53 else np.int64 if bound < LONG else object
    return one.astype(kind), other.astype(kind)


class Block:
    """Vectors by dimension, sorted by id, with the extremes of each dimension."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        self.columns = np.ascontiguousarray(vectors[order].T)
        self.least, self.most = self.columns.min(axis=1), self.columns.max(axis=1)

    def scan(self, anchor: np.ndarray, alive: np.ndarray, stays: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``alive`` that ``stays(lower, upper)`` leaves when all dimensions are read, and their products."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        order = order[anchor[order] != 0]
        weights = anchor[order]
        ends = weights * self.least[order], weights * self.most[order]
        low, high = (np.append(np.cumsum(part[::-1])[::-1], 0) for part in (np.minimum(*ends), np.maximum(*ends)))
        sums = np.zeros(len(alive), self.columns.dtype)
        for start in range(0, max(1, len(order)), STEP):
            end = min(start + STEP, len(order))
            part = self.columns[order[start:end]]
            sums = sums + weights[start:end] @ (part if len(alive) == part.shape[1] else part[:, alive])
            stay = stays(sums + low[end], sums + high[end])
            alive, sums = alive[stay], sums[stay]
            if not len(alive):
                break
        return alive, sums


def among_best(k: int) -> Callable:
    """Candidates that may be among the ``k`` highest."""

    def stays(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        if len(lower) <= k:
            return np.ones(len(lower), bool)
        return upper >= np.partition(lower, len(lower) - k)[len(lower) - k]

    return stays


def in_windows(windows: list[tuple[int, int]], k: int) -> Callable:
    """Candidates that may be among the ``k`` highest of one of the windows (from, to)."""

    def stays(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        wanted = np.zeros(len(lower), bool)
        for low, high in windows:
            may = (upper >= low) & (lower <= high)
            sure = lower[(lower >= low) & (upper <= high)]
            if len(sure) > k:
                may &= upper >= np.partition(sure, len(sure) - k)[len(sure) - k]
            wanted |= may
        return wanted

    return stays


def highest(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest, ties by place."""
    return np.argsort(-scores, kind="stable")[:k]


def _columns(own: pd.DataFrame, anchors: pd.DataFrame, width: int, scale: float) -> tuple[Block, np.ndarray]:
    vectors, asked = fitting(whole_numbers(list(own["v"]), width, scale), whole_numbers(list(anchors["vector"]), width, scale))
    return Block(vectors, own["id"].to_numpy(np.int64), own["label"].to_numpy()), asked


def _as_long(score, one: int, other: int) -> tuple[int, bool]:
    """A score and whether it fits a long. Beyond a long's most it is refused: it is among the highest, or others above it are."""
    score = int(score)
    if score >= LONG:
        raise OverflowError(f"the inner product of vectors {one} and {other} does not fit a long: {score}")
    return max(score, -LONG), score >= -LONG


def _positives(width: int, scale: float, k: int):
    def search(own: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(anchors):
            block, asked = _columns(own, anchors, width, scale)
            for anchor, key, label, vector in zip(anchors["anchor"].tolist(), anchors["key"].tolist(), anchors["own"], asked):
                alive, scores = block.scan(vector, np.flatnonzero((block.labels == label) & (block.ids != key)), among_best(k))
                for at in highest(scores, k):
                    other = int(block.ids[alive[at]])
                    found.append((anchor, other, *_as_long(scores[at], key, other)))
        return pd.DataFrame(found, columns=["anchor", "positive_id", "positive_score", "fits"])

    return search


def window_of(score: int, least: int, most: int) -> tuple[int, int]:
    """Whole scores s with least * score <= 100 * s <= most * score."""
    return -(-least * score // 100), most * score // 100


def _negatives(width: int, scale: float, k: int, least: int, most: int):
    def search(own: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(anchors):
            block, asked = _columns(own, anchors, width, scale)
            columns = zip(anchors["anchor"].tolist(), anchors["own"], anchors["positives"], asked)
            for anchor, label, positives, vector in columns:
                windows = [window_of(int(score), least, most) for score in positives]
                windows = [window for window in dict.fromkeys(windows) if window[0] <= window[1]]
                alive, scores = block.scan(vector, np.flatnonzero(block.labels != label), in_windows(windows, k))
                best: set[int] = set()
                for low, high in windows:
                    inside = np.flatnonzero((scores >= low) & (scores <= high))
                    best.update(inside[highest(scores[inside], k)].tolist())
                # A score within a window lies between zero and a positive's, so it fits a long.
                found.extend((anchor, int(block.ids[alive[at]]), int(scores[at])) for at in sorted(best))
        return pd.DataFrame(found, columns=["anchor", "negative_id", "negative_score"])

    return search


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10,
         least: int = 30, most: int = 90, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Negatives of every anchor that score nearly as high as its positives.

    Components become floor(scale * x) and a score is the integer inner product with the anchor. An anchor's
    positives are its ``positives`` highest rows of the same label. For each positive of score p the first
    ``negatives`` rows of other labels with least * p <= 100 * score <= most * p are returned, higher scores
    first, equal scores by smaller key. ``is_anchor`` picks the anchors among the rows, ``label`` may be any
    expression of their columns.

    Rows without key or label, and vectors that are null or hold a null or non-finite component, take no
    part. A shorter vector counts as filled up with zeros, an empty one as all zeros. An anchor is not
    compared with rows of its own key; rows that repeat are candidates each, and a repeated anchor has its
    rows again. A positive below zero has an empty window. Scores are exact whole numbers; a positive's
    score that does not fit a long is refused by name. An empty table gives no row. Other columns are not
    read. Returns ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``,
    ``negative_score``.

    Blocks of vectors meet chunks of anchors; both hold a bounded number of components. Rows are dealt to
    blocks by numbers of their own, so neither a label nor a repeated vector makes a block large.
    """
    spark = vectors.sparkSession
    finite = F.forall(F.col(vector), lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    usable = vectors.select(F.col(key).cast("bigint").alias("id"), label.cast("bigint").alias("label"),
                            F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asked"), finite.alias("finite"))
    usable = usable.filter("id is not null and label is not null and v is not null and finite").drop("finite")
    with interim(spark):
        # The rows' numbers hold because the table is written before they are used.
        rows = staged(usable.withColumn("row", F.monotonically_increasing_id()), "vectors")
        count, asked, width = rows.agg(F.count("*"), F.count_if("asked"), F.max(F.size("v"))).first()
        width = max(width or 0, 1)
        each = max(1, BLOCK_NUMBERS // width)
        blocks, chunks = max(1, -(-count // each)), max(1, -(-(asked or 0) // each))

        def dealt(column: str, parts: int) -> Column:
            return F.pmod(F.xxhash64(F.lit(column), "row"), F.lit(parts)).cast("int").alias(column)

        def all_of(column: str, parts: int) -> Column:
            return F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(column)

        held = rows.select("id", "label", "v", dealt("block", blocks), all_of("chunk", chunks)).groupBy("block", "chunk")
        anchors = rows.filter("asked").select(F.col("row").alias("anchor"), F.col("id").alias("key"), F.col("label").alias("own"), F.col("v").alias("vector"),
                                              dealt("own_chunk", chunks))

        near = held.cogroup(anchors.select("*", all_of("part", blocks)).groupBy("part", "own_chunk")).applyInPandas(
            _positives(width, scale, positives), "anchor bigint, positive_id bigint, positive_score bigint, fits boolean")
        order = W.partitionBy("anchor").orderBy(F.desc("positive_score"), F.desc("fits"), "positive_id")
        near = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
        refused = F.raise_error(F.concat(F.lit("the inner product does not fit a long, of a vector and "), F.col("positive_id"))).cast("bigint")
        score = F.when(F.col("fits"), F.col("positive_score")).otherwise(refused).alias("positive_score")
        near = staged(near.select("anchor", "place", "positive_id", score), "positives")

        listed = near.groupBy("anchor").agg(F.collect_list("positive_score").alias("positives"))
        far = held.cogroup(anchors.join(listed, "anchor").select("*", all_of("part", blocks)).groupBy("part", "own_chunk")).applyInPandas(
            _negatives(width, scale, negatives, least, most), "anchor bigint, negative_id bigint, negative_score bigint")
        p, n = F.col("positive_score").cast("decimal(38,0)"), F.col("negative_score").cast("decimal(38,0)")
        pairs = near.join(far, "anchor").filter((least * p <= 100 * n) & (100 * n <= most * p))
        rank = F.row_number().over(W.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id"))
        ranked = pairs.withColumn("rank", rank).filter(F.col("rank") <= negatives)
        names = rows.filter("asked").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
        result = ranked.join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        return staged(result, "negatives", keep=True)
