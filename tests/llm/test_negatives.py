import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from merchlake.llm import negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, v string, block int, `row` string"


def frame(spark, rows):
    return spark.createDataFrame([(key, vector, label, "x", 1, "y") for key, vector, label in rows], SCHEMA)


def by_force(rows, is_anchor, k=5, most_negatives=10, scale=256):
    usable = [(key, [int(np.floor(scale * x)) for x in vector], label) for key, vector, label in rows
              if key is not None and label is not None and vector is not None and all(x is not None and np.isfinite(x) for x in vector)]
    found = []
    for key, vector, label in usable:
        if not is_anchor(key):
            continue
        scored = [(-sum(a * b for a, b in zip(vector, other)), other_key, other_label) for other_key, other, other_label in usable if other_key != key]
        scored.sort()
        for score, positive, _ in [row for row in scored if row[2] == label][:k]:
            hard = [row for row in scored if row[2] != label and 30 * -score <= 100 * -row[0] <= 90 * -score][:most_negatives]
            found += [(key, positive, rank, negative, -score, -other) for rank, (other, negative, _) in enumerate(hard, 1)]
    return sorted(found)


def mined(df, **more):
    return sorted(tuple(row) for row in negatives.mine(df, F.col("vec_id") % 10 == 0, F.col("label"), **more).collect())


@pytest.mark.parametrize("width", [1, 7, 40])
def test_equal_to_all_products(spark, monkeypatch, width):
    monkeypatch.setattr(negatives, "BLOCK_NUMBERS", 60 * width)  # several blocks and chunks
    dice = random.Random(width)
    rows = [(key, [dice.gauss(0.2, 0.5) for _ in range(width)], dice.randrange(4)) for key in range(400)]
    rows += [(400 + key, rows[20][1], key % 3) for key in range(150)]  # ties and a vector that many rows have
    got = mined(frame(spark, rows).repartition(5))
    assert got and got == by_force(rows, lambda key: key % 10 == 0)


def test_odd_rows(spark):
    dice = random.Random(3)
    rows = [(key, [dice.gauss(0.3, 0.4) for _ in range(dice.choice([0, 3, 6]))], dice.choice([1, 2])) for key in range(120)]
    rows += [(1000, None, 1), (1010, [0.5, None], 1), (1020, [float("nan")], 1), (1030, [float("inf")], 2), (1040, [0.5] * 6, None),
             (None, [0.5] * 6, 1), (1050, [0.0] * 6, 1), (1060, [], 2), (1070, [0.9] * 6, 7)]
    assert mined(frame(spark, rows)) == by_force(rows, lambda key: key % 10 == 0)
    assert mined(frame(spark, [])) == []


def test_repeated_rows_count_each(spark):
    rows = [(10, [1.0, 1.0], 1), (10, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.5], 2), (2, [0.5, 0.5], 2)]
    got = mined(frame(spark, rows))
    # Two anchors, each with two positives, each with two negatives.
    assert got == sorted(2 * by_force(rows[1:], lambda key: key == 10)) and len(got) == 8


def test_long_numbers_are_exact(spark):
    big = 2.0**30
    rows = [(10, [big, 1.0, 3.0], 1), (1, [2.0, 1.0, 0.0], 1), (2, [1.0, 2.0, 1.0], 2), (3, [1.0, 2.5, 1.0], 2), (20, [-1e300, 2.0, 5.0], 3)]
    assert mined(frame(spark, rows)) == by_force(rows, lambda key: key % 10 == 0)
    with pytest.raises(Exception, match="does not fit a long"):
        mined(frame(spark, [(10, [1e200], 1), (1, [1e200], 1)]))


def test_scan_drops_most_candidates():
    dice = np.random.default_rng(1)
    centres = dice.normal(0, 1, (40, 32))
    vectors = np.floor(64 * (centres[dice.integers(0, 40, 4000)] + dice.normal(0, 0.1, (4000, 32))))
    block = negatives.Block(vectors, np.arange(4000), np.zeros(4000, int))
    left = []

    def stays(lower, upper):
        keep = negatives.among_best(5)(lower, upper)
        left.append(int(keep.sum()))
        return keep

    rows, scores = block.scan(np.floor(64 * centres[0]), np.arange(4000), stays)
    exact = vectors[np.argsort(np.arange(4000))] @ np.floor(64 * centres[0])
    assert sorted(exact[rows]) == sorted(scores) and max(exact) == max(scores)
    assert left[-2] < 400 and left == sorted(left, reverse=True)


def test_windows_are_exact():
    for score in (-7, -1, 0, 1, 3, 10, 333):
        low, high = negatives.window_of(score, 30, 90)
        inside = [s for s in range(-400, 400) if 30 * score <= 100 * s <= 90 * score]
        assert inside == list(range(low, high + 1))
