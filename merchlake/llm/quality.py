"""Text quality by nearest-neighbour voting on latent-semantic vectors.

Terms are hashed character trigrams of the raw text, the shapes of its words, and how much it repeats
itself. A sample of labelled documents, weighted by inverse document frequencies of the whole corpus,
gives the latent directions; the sample's vectors are broadcast, every document is multiplied with all
of them in blocks, and the nearest ones vote, weighted by their cosine.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.llm.common import labelled_sample, sampled_rows, summed_vector, text_batches, vector_rows

GRAMS, SHAPES, STEPS = 1536, 384, 16
TERMS = GRAMS + SHAPES + 2 * STEPS
DIRECTIONS = 64
SAMPLE = 6_000  # labelled documents learned from, and so the vectors broadcast, at most
NEIGHBOURS = 24
BATCH_CHARS, BATCH_TEXTS = 400_000, 64
STEP_WEIGHT = 4.0


def _classes() -> np.ndarray:
    """Kind of character by code point up to 255: space, lower, upper, digit, then each sign for itself."""
    table = np.zeros(256, np.int64)
    for code in range(256):
        sign = chr(code)
        table[code] = 0 if sign.isspace() else 1 if sign.islower() else 2 if sign.isupper() else 3 if sign.isdigit() else 4 + code % 61
    return table


CLASSES = _classes()


def terms(texts: list[str]) -> np.ndarray:
    """Term counts (texts x TERMS, float32). Texts without a character have none."""
    lengths = np.array([len(text) for text in texts])
    out = np.zeros((len(texts), TERMS), np.float32)
    if lengths.sum():
        # A space on either side of each text keeps trigrams inside their text.
        codes = np.frombuffer(("  " + "  ".join(texts) + "  ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), lengths + 2)
        middle, before, after = codes[1:-1], codes[:-2], codes[2:]
        inside = np.zeros(len(codes), bool)
        starts = np.cumsum(lengths + 2) - lengths
        for start, length in zip(starts.tolist(), lengths.tolist()):
            inside[start:start + length] = True
        inside = inside[1:-1]
        owner = np.concatenate((owner, [len(texts) - 1] * 2))[1:-1][inside]
        mixed = (before * 1_000_003 + middle * 10_007 + after)[inside] * 2654435761 >> 7
        width = len(texts)
        out[:, :GRAMS] = np.bincount(owner * GRAMS + mixed % GRAMS, minlength=width * GRAMS).reshape(width, GRAMS)
        kinds = CLASSES[np.minimum(codes, 255)]
        shape = (kinds[:-2] * 65 + kinds[1:-1]) * 65 + kinds[2:]
        shape = shape[inside] * 2654435761 >> 9
        out[:, GRAMS:GRAMS + SHAPES] = np.bincount(owner * SHAPES + shape % SHAPES, minlength=width * SHAPES).reshape(width, SHAPES)
    return out


def repetition(text: str) -> tuple[int, int]:
    """Steps (0 to STEPS - 1) of the share of distinct words, and of words that repeat the one before."""
    words = text.split()
    if not words:
        return STEPS - 1, 0
    share = len(set(words)) / len(words) ** 0.9
    same = sum(map(str.__eq__, words, words[1:])) / len(words)
    return min(STEPS - 1, int(share * STEPS)), min(STEPS - 1, int(same * STEPS))


def raw_vectors(texts: list[str]) -> np.ndarray:
    """Logarithms of the term counts, with the steps of repetition."""
    out = np.log1p(terms(texts))
    for at, text in enumerate(texts):
        distinct, same = repetition(text)
        out[at, GRAMS + SHAPES + distinct] = STEP_WEIGHT
        out[at, GRAMS + SHAPES + STEPS + same] = STEP_WEIGHT
    return out


@dataclasses.dataclass
class Model:
    """``weights`` by term, ``directions`` (terms x directions), and the sample's unit vectors with their labels."""

    weights: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, raw: np.ndarray) -> np.ndarray:
        found = (raw * self.weights) @ self.directions
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)

    def vote(self, raw: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest sample documents, by squared cosine; half without any neighbour."""
        if not len(self.labels):
            return np.full(len(raw), 0.5)
        cosines = self.project(raw) @ self.vectors.T
        count = min(NEIGHBOURS, cosines.shape[1])
        near = np.argpartition(cosines, cosines.shape[1] - count, axis=1)[:, -count:]
        weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0.0).astype(np.float64) ** 2
        total = weight.sum(axis=1)
        share = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.where(total > 0, np.clip(share, 0.0, 1.0), 0.5)


def _survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents per term of this partition (and of all, in the last place)."""
    totals = np.zeros(TERMS + 1, np.int64)
    for batch in batches:
        texts = [text or "" for text in batch["_text"]]
        for start, end in text_batches(texts, BATCH_CHARS, BATCH_TEXTS):
            totals[:-1] += (raw_vectors(texts[start:end]) > 0).sum(axis=0)
            totals[-1] += end - start
    yield vector_rows(totals)


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, labels = [text or "" for text in batch["_text"]], batch["_label"].to_numpy(float)
        for start, end in text_batches(texts, BATCH_CHARS, BATCH_TEXTS):
            raw = raw_vectors(texts[start:end]).astype(np.float16)
            yield pd.DataFrame({"values": [one.tobytes() for one in raw], "label": labels[start:end]})


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", key: str = "doc_id", text: str = "text") -> Model:
    """Learn from at most ``SAMPLE`` labelled documents where ``learn`` (over ``labels``) holds.

    Inverse document frequencies count every document. To the driver come one vector of counts
    and the sample's vectors, one a key, from which it computes the latent directions.
    """
    chosen = labelled_sample(labels, label, learn, SAMPLE)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    totals = summed_vector(rows.select("_text").mapInPandas(_survey, "slice int, values binary"), TERMS + 1)
    frequency, documents = totals[:-1], int(totals[-1])
    vectors = sampled_rows(rows, chosen).select("_text", "_label").mapInPandas(_vectors, "values binary, label double")
    sample = vectors.orderBy(F.crc32("values"), "values", "label").toPandas()
    weights = (np.log((documents + 1.0) / (frequency + 1.0)) + 0.2).astype(np.float32)
    labels_of = sample["label"].to_numpy(np.float64)
    if not len(labels_of):
        return Model(weights, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels_of)
    raw = np.frombuffer(b"".join(sample["values"]), np.float16).reshape(-1, TERMS)
    square = np.zeros((TERMS, TERMS), np.float32)
    for start in range(0, len(raw), 512):
        block = raw[start:start + 512].astype(np.float32) * weights
        block /= np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-9)
        square += block.T @ block
    _, vectors = np.linalg.eigh(square)
    directions = np.ascontiguousarray(vectors[:, ::-1][:, :DIRECTIONS], np.float32)
    model = Model(weights, directions, np.zeros((0, DIRECTIONS), np.float32), labels_of)
    model.vectors = np.concatenate([model.project(raw[at:at + 512].astype(np.float32)) for at in range(0, len(raw), 512)])
    return model


def scorer(model: Model, spark):
    """Column function: text to a score between 0 and 1 (higher: label 1 likelier).

    Null and empty texts are scored as a text without any term. Without labelled documents every score is 0.5.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            texts = [text or "" for text in column]
            parts = [shared.value.vote(raw_vectors(texts[start:end])) for start, end in text_batches(texts, BATCH_CHARS, BATCH_TEXTS)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score
