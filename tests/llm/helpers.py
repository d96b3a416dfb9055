"""Small tables with the odd cases every operator must take, and plain counterparts of the operators."""

from __future__ import annotations

import random


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, score double, `_key` string, `node.n` int"
LABELS = "doc_id bigint, quality int, toxic int"


def words(seed: int, count: int) -> list[str]:
    dice = random.Random(seed)
    return ["".join(dice.choice(["ta", "ri", "mo", "len", "sku", "ba"]) for _ in range(dice.randint(1, 4))) for _ in range(count)]


def odd_rows() -> list[tuple]:
    """Nulls, empty and very long texts, equal rows, equal and null keys, odd characters."""
    text = " ".join(words(1, 60))
    longest = " ".join(words(2, 30_000))
    texts = [(1, text), (2, text), (2, text), (3, None), (4, ""), (5, "  \n\t "), (6, longest), (None, text), (None, None),
             (7, "one"), (7, "quite another text under the same key"), (8, "漢字 \U0001f600 \x00 naïve\u2028line"), (9, text + " more"), (10, "12 34 ?!")]
    return [(key, value, "en" if key != 3 else None, "s", None, "x", 0.5, "k", 1) for key, value in texts]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def plain_docs(spark, texts: dict):
    return spark.createDataFrame([(key, text, "en", "s", len(text)) for key, text in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def labels_of(spark, rows):
    return spark.createDataFrame(rows, LABELS)


