"""Language identification by hyperdimensional profiles.

Every letter slot has a random vector of +1 and -1. A letter trigram is the product (binding) of its
letters' vectors, each permuted by its place; a text or a language is the sum (bundle) of its trigrams'
vectors. A text gets the language whose bundle has the largest cosine with its own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.llm.common import text_batches

DIMENSIONS = 512
SLOTS = 64  # 0: no letter, 1 to 26: a to z, the rest: all other letters by their code
BATCH_CHARS, BATCH_TEXTS = 300_000, 32
UNKNOWN = "und"
SHARPNESS = 20.0


@functools.lru_cache(maxsize=1)
def _slot_table() -> np.ndarray:
    """Letter slot by code point, for the first 65,536."""
    table = np.zeros(0x10000, np.int32)
    for code in range(0x10000):
        if chr(code).isalpha():
            table[code] = _slot(code)
    return table


def _slot(code: int) -> int:
    if 97 <= code <= 122:
        return code - 96
    return 27 + (code * 2654435761 % 2**32 >> 8) % (SLOTS - 27)


@functools.lru_cache(maxsize=4)
def _letters(dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of the slots at the first, second and third place of a trigram (permuted by rotation)."""
    base = np.random.default_rng(20240607).choice(np.array([-1, 1], np.int8), (SLOTS, dimensions))
    return np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base


def slots_of(text: str) -> np.ndarray:
    """Letter slots of a text; every run of other characters is one 0, as are both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    high = codes >= 0x10000
    slots = _slot_table()[np.where(high, 0, codes)]
    if high.any():
        kinds, where = np.unique(codes[high], return_inverse=True)
        slots[high] = np.array([_slot(int(c)) if chr(c).isalpha() else 0 for c in kinds], np.int32)[where]
    padded = np.zeros(len(slots) + 2, np.int32)
    padded[1:-1] = slots
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)
    return padded[keep]


def trigrams(slots: np.ndarray) -> np.ndarray:
    """Codes of the trigrams around every letter."""
    codes = slots[:-2] << 12 | slots[1:-1] << 6 | slots[2:]
    return codes[slots[1:-1] != 0]


def vectors_of(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Bound vectors of trigram codes."""
    first, second, third = _letters(dimensions)
    return (first[codes >> 12] * second[codes >> 6 & 63] * third[codes & 63]).astype(np.float32)


def bundles(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """One bundle per text; zero where a text has no letter."""
    parts = [trigrams(slots_of(text)) for text in texts]
    sizes = [len(part) for part in parts]
    if not sum(sizes):
        return np.zeros((len(texts), dimensions), np.float32)
    keys, counts = np.unique(np.repeat(np.arange(len(texts), dtype=np.int64), sizes) << 18 | np.concatenate(parts), return_counts=True)
    used, column = np.unique(keys & 0x3FFFF, return_inverse=True)
    table = np.zeros((len(texts), len(used)), np.float32)
    table[keys >> 18, column] = counts
    return table @ vectors_of(used, dimensions)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, texts in batch.groupby("_lang")["_text"]:
            texts = texts.tolist()
            for start, end in text_batches(texts, 2_000_000, 1000):
                found = [trigrams(slots_of(text)) for text in texts[start:end]]
                codes, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"_lang": lang, "_code": codes, "_count": counts})


def _prototype(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(DIMENSIONS)
    codes, counts = rows["_code"].to_numpy(), rows["_count"].to_numpy()
    for start in range(0, len(codes), 8192):
        total += counts[start:start + 8192] @ vectors_of(codes[start:start + 8192])
    size = np.linalg.norm(total)
    return pd.DataFrame({"lang": [key[0]], "vector": [(total / size if size else total).tolist()]})


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang") -> DataFrame:
    """Prototypes (lang, vector) from all rows where ``learn`` holds and language and text are given.

    Trigrams are counted per language over the whole texts before they are bound and bundled: at most
    64^3 counts per language meet in one group.
    """
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text"))
    counts = rows.mapInPandas(_counts, "_lang string, _code int, _count bigint")
    counts = counts.groupBy("_lang", "_code").agg(F.sum("_count").alias("_count"))
    return counts.groupBy("_lang").applyInPandas(_prototype, "lang string, vector array<double>")


def predictor(prototypes: DataFrame):
    """Column function: text to ``struct(lang, score)``.

    The prototypes, one short vector per language, come to the driver. A null text, or one without a
    letter, is ``und`` with score 0, as is every text if no language was learned. Equal cosines go to
    the smaller language name. The score is the share of the best language among the exponentials of
    all cosines, between 0 and 1.
    """
    rows = sorted((row["lang"], row["vector"]) for row in prototypes.collect())
    langs = [row[0] for row in rows]
    profile = np.array([row[1] for row in rows], np.float32).reshape(len(rows), DIMENSIONS).T

    @F.pandas_udf("lang string, score double")
    def predict(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in columns:
            texts = column.tolist()
            found, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            for start, end in text_batches(texts, BATCH_CHARS, BATCH_TEXTS) if langs else ():
                own = bundles([text or "" for text in texts[start:end]])
                size = np.linalg.norm(own, axis=1)
                # The bundle of a text with letters may cancel out; it then has no cosine, and all are 0.
                spelt = np.array([any(map(str.isalpha, text)) if text else False for text in texts[start:end]])
                cosines = (own @ profile) / np.maximum(size, 1e-9)[:, None]
                best = cosines.argmax(axis=1)
                weights = np.exp(SHARPNESS * (cosines - cosines.max(axis=1, keepdims=True)))
                share = weights.max(axis=1) / weights.sum(axis=1)
                found[start:end] = np.where(spelt, np.array(langs, object)[best], UNKNOWN)
                scores[start:end] = np.where(spelt, share, 0.0)
            yield pd.DataFrame({"lang": found, "score": scores})

    return predict
