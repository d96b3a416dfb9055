"""Toxic passages as maximal-scoring segments of token log-odds.

Every word has a log-odds ratio between toxic and clean documents under an informative Dirichlet prior
(the whole corpus's word frequencies). Ruzzo and Tompa's linear scan finds all maximal segments of the
summed scores. Karlin and Altschul's extreme-value law turns a segment's score and the text's length
into the number of such segments that clean text would hold by chance; an isotonic curve over training
documents turns that into a probability.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.llm.common import labelled_sample, sampled_rows, staged, summed_vector, vector_rows

BUCKETS = 2**17  # words by hash, so that the model's size does not follow the vocabulary
PRIOR_SHARE = 2.0  # weight of the corpus frequencies, in times the words of the toxic documents
TRUST = 1.0  # standard deviations that a log-odds ratio is drawn towards zero
MARGIN = 0.5  # what every word costs, so that segments end
SAMPLE = 40_000  # labelled documents learned from, at most
CACHED_WORDS = 300_000
SIGNIFICANT = 0.01
PUNCTUATION = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum())


class Buckets(dict):
    """Bucket by word, without the punctuation around it."""

    def __missing__(self, word: str) -> int:
        value = zlib.crc32(word.strip(PUNCTUATION).encode("utf-8", "surrogatepass")) % BUCKETS
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value
        return value

    def of_text(self, text: str | None) -> np.ndarray:
        words = text.lower().split() if text else []
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order; no segment is empty or negative."""
    positive = scores > 0
    if not positive.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([False], positive, [False])).astype(np.int8)))
    total = np.concatenate(([0.0], np.cumsum(scores)))
    kept: list[tuple[int, int, float, float]] = []
    links: list[int] = []  # for each kept segment, the nearest earlier one whose left sum is smaller, or -1
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        left, right = total[start], total[end]
        while True:
            at = len(kept) - 1
            while at >= 0 and kept[at][2] >= left:
                at = links[at]
            if at < 0 or kept[at][3] >= right:
                kept.append((start, end, left, right))
                links.append(at)
                break
            start, left = kept[at][0], kept[at][2]
            del kept[at:], links[at:]
    return [(start, end, float(right - left)) for start, end, left, right in kept]


@dataclasses.dataclass
class Model:
    """Word scores by bucket, the extreme-value law's two parameters, and the curve from evidence to probability."""

    scores: np.ndarray
    decay: float
    factor: float
    evidence: np.ndarray
    probability: np.ndarray

    def logs(self, score, length):
        """ln of the number of segments of that score expected by chance in a clean text of that length."""
        return np.log(self.factor * np.maximum(length, 1)) - self.decay * np.asarray(score)

    def evidence_of(self, segments: list[float], length: int) -> float:
        """-ln of the chance that clean text of that length holds segments as good as the best r of these.

        Karlin and Altschul's sum statistic, for the r that makes it largest.
        """
        best = np.sort(np.asarray(segments + [0.0]))[::-1]
        total = np.cumsum(-self.logs(best, length))
        count = np.arange(1, len(best) + 1)
        factorials = np.concatenate(([0.0], np.cumsum(np.log(count))))
        tail = total - (count - 1) * np.log(np.maximum(total, 1.0)) + factorials[1:] + factorials[:-1]
        # The law of a sum holds in its tail only.
        return float(np.max(np.where((count == 1) | (total > count), tail, -np.inf)))

    def probability_of(self, evidence):
        return np.interp(evidence, self.evidence, self.probability)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents by bucket: those without a label, which are the whole corpus, toxic and clean ones."""
    words, totals = Buckets(), np.zeros((3, BUCKETS), np.int64)
    for batch in batches:
        for text, label in zip(batch["_text"], batch["_label"].tolist()):
            # A word counts once per document, so a passage repeated within one adds no evidence.
            counted = np.unique(words.of_text(text))
            totals[0 if label != label else 1 if label else 2, counted] += 1
    yield vector_rows(totals)


def log_odds(everything: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Shrunken log-odds ratio by bucket, less the margin."""
    one, other = toxic.sum(), clean.sum()
    size = PRIOR_SHARE * one
    prior = size * (everything + 0.01) / (everything + 0.01).sum()
    ratio = np.log((toxic + prior) / (one + size - toxic - prior)) - np.log((clean + prior) / (other + size - clean - prior))
    doubt = TRUST * np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    return (np.sign(ratio) * np.maximum(np.abs(ratio) - doubt, 0) - MARGIN).astype(np.float32)


def decay_of(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root x of sum(weight * exp(x * score)) = 1, for weights that sum to 1."""
    low, high = 1e-3, 1e-3
    while high < 50 and weights @ np.exp(np.minimum(high * scores, 700)) < 1:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if weights @ np.exp(np.minimum(middle * scores, 700)) < 1 else (low, middle)
    return high


def isotonic(evidence: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing share of label 1 over the evidence, by pooling neighbours that go down."""
    order = np.argsort(evidence, kind="stable")
    pools: list[list[float]] = []
    for x, y in zip(evidence[order].tolist(), labels[order].tolist()):
        pools.append([y, 1.0, x, x])
        while len(pools) > 1 and (pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1] or pools[-2][3] == pools[-1][2]):
            y2, n2, _, last = pools.pop()
            pools[-1][0] += y2
            pools[-1][1] += n2
            pools[-1][3] = last
    knots = np.array([edge for pool in pools for edge in pool[2:]])
    # One of each label is added to a pool, so that a few documents never make a probability of 0 or 1.
    values = np.array([(pool[0] + 0.5) / (pool[1] + 1.0) for pool in pools]).repeat(2)
    return knots, np.maximum.accumulate(values)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Model:
    """Learn from labelled documents where ``learn`` (over ``labels``) holds.

    Word frequencies cover every text of ``docs``; the classes are counted over at most ``SAMPLE``
    labelled documents, one text a key. What comes to the driver is the table of buckets and one short
    row per sampled document. Without documents of both labels every text gets the score 0.
    """
    spark = docs.sparkSession
    chosen = labelled_sample(labels, label, learn, SAMPLE)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    sample = sampled_rows(rows, chosen)
    every = rows.select("_text", F.lit(None).cast("double").alias("_label"))
    counts = every.union(sample.select("_text", F.col("_label").cast("double"))).mapInPandas(_count, "slice int, values binary")
    table = summed_vector(counts, 3 * BUCKETS).reshape(3, BUCKETS).astype(float)
    if not table[1].sum() or not table[2].sum():
        return Model(np.full(BUCKETS, -MARGIN, np.float32), 1.0, 1.0, np.array([0.0]), np.array([0.0]))
    scores = log_odds(*table)
    shared = spark.sparkContext.broadcast(scores)

    @F.pandas_udf("segments array<double>, words bigint")
    def measure(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = Buckets()
        for column in columns:
            own = [shared.value[words.of_text(text)] for text in column]
            yield pd.DataFrame({"segments": [[segment[2] for segment in maximal_segments(one)] for one in own],
                                "words": [len(one) for one in own]})

    # The labelled documents are known, so only their texts go to Python. Their segments stay in a table:
    # the best of each give the law, and with the law all of each give the evidence.
    measured = staged(sample.select("_label", measure("_text").alias("_m")).select("_label", "_m.segments", "_m.words"), "segments")
    seen = measured.select("_label", "words", F.coalesce(F.array_max("segments"), F.lit(0.0)).alias("best")).toPandas()
    label_of, words, best = (seen[name].to_numpy(float) for name in ("_label", "words", "best"))
    # The law is that of clean text: all words' frequencies without those of toxic documents.
    background = np.maximum(table[0] - table[1], 0) + 1e-9
    decay = decay_of(scores.astype(float), background / background.sum())
    clean = (label_of == 0) & (words > 0)
    factor = float(np.exp(np.mean(decay * best[clean] - np.log(words[clean])) - np.euler_gamma)) if clean.any() else 1.0
    model = Model(scores, decay, factor, np.array([0.0]), np.array([0.0]))
    law = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def evidence_of(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for segments, lengths in columns:
            yield pd.Series([law.value.evidence_of(list(found), n) for found, n in zip(segments, lengths)], dtype=float)

    judged = measured.select("_label", evidence_of("segments", "words").alias("evidence")).toPandas()
    model.evidence, model.probability = isotonic(judged["evidence"].to_numpy(float), judged["_label"].to_numpy(float))
    return model


def scorer(model: Model, spark):
    """Column function: text to ``struct(score, passages)``.

    A passage is a maximal segment whose chance of arising in clean text of that length is below
    ``SIGNIFICANT``: first word, word after the last, summed log-odds, and that chance. A text without
    words, or null, is scored as one without any segment.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, passages array<struct<first:bigint,after:bigint,log_odds:double,chance:double>>")
    def score(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, own = Buckets(), shared.value
        for column in columns:
            scores, passages = [], []
            for text in column:
                found = own.scores[words.of_text(text)]
                segments = maximal_segments(found)
                scores.append(float(own.probability_of(own.evidence_of([segment[2] for segment in segments], len(found)))))
                chances = [float(-np.expm1(-np.exp(own.logs(segment[2], len(found))))) for segment in segments]
                passages.append([{"first": a, "after": b, "log_odds": s, "chance": p}
                                 for (a, b, s), p in zip(segments, chances) if p < SIGNIFICANT])
            yield pd.DataFrame({"score": scores, "passages": passages})

    return score
