import numpy as np
import pytest
from helpers import DOCS, labels_of, no_docs, odd_docs, odd_rows, plain_docs, words
from pyspark.sql import functions as F

from merchlake.llm import common, language, quality, toxicity
from merchlake.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def held_out(spark, name, label):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = QUERIES[name](spark, FOLDER).join(labels, "doc_id").filter("held_out").toPandas()
    return rows["score"].to_numpy(), rows["predicted"].to_numpy(), rows[label].to_numpy()


def test_quality_on_held_out(spark):
    score, predicted, label = held_out(spark, "op1_quality", "quality")
    assert ((score >= 0) & (score <= 1)).all() and (predicted == label).mean() > 0.93


def test_toxicity_on_held_out(spark):
    score, predicted, label = held_out(spark, "op8_toxicity", "toxic")
    assert ((score >= 0) & (score <= 1)).all() and (predicted == label).mean() > 0.9


def test_language_on_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op6_language"](spark, FOLDER).join(docs, "doc_id").filter("held_out and lang is not null").toPandas()
    assert (rows["lang"] == rows["lang_pred"]).mean() > 0.97


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, 1, 1), (1, 0, 0), (7, 0, 0), (9, 1, 1), (6, 0, 0), (3, None, None), (None, 1, 1), (4, 1, 0)]])
def test_odd_rows_are_scored(spark, labels):
    known, docs = labels_of(spark, labels), odd_docs(spark)
    good = quality.scorer(quality.fit(docs, known, F.lit(True)), spark)
    bad = toxicity.scorer(toxicity.fit(docs, known, F.lit(True)), spark)
    rows = docs.select("doc_id", good("text").alias("q"), bad("text").getField("score").alias("t")).collect()
    assert len(rows) == len(odd_rows())
    assert all(0 <= row.q <= 1 and 0 <= row.t <= 1 for row in rows)


def test_empty_tables(spark):
    docs, known = no_docs(spark), labels_of(spark, [])
    assert docs.select(quality.scorer(quality.fit(docs, known, F.lit(True)), spark)("text")).count() == 0
    assert docs.select(toxicity.scorer(toxicity.fit(docs, known, F.lit(True)), spark)("text")).count() == 0
    assert docs.select(language.predictor(language.fit(docs, F.lit(True)))("text")).count() == 0


def test_languages_of_odd_rows(spark):
    docs = odd_docs(spark)
    predict = language.predictor(language.fit(docs, F.lit(True)))
    got = docs.select("text", predict("text").alias("p")).collect()
    for row in got:
        letters = any(map(str.isalpha, row.text or ""))
        assert (row.p.lang == "en") == letters and (row.p.lang == "und") == (not letters) and 0 <= row.p.score <= 1
    # Nothing to learn from.
    nobody = language.predictor(language.fit(docs, F.lit(False)))
    assert {row.p.lang for row in docs.select(nobody("text").alias("p")).collect()} == {"und"}


def test_bundle_is_the_sum_of_bound_vectors():
    text = "Ab, ça"
    first, second, third = language._letters(language.DIMENSIONS)
    slots = [0, 1, 2, 0, language._slot(ord("ç")), 1, 0]
    want = sum(first[slots[i - 1]].astype(int) * second[slots[i]] * third[slots[i + 1]] for i in range(1, 6) if slots[i])
    assert np.array_equal(language.bundles([text, "", "12"])[0], want)
    assert not language.bundles([text, "", "12"])[1:].any()


def segments_by_definition(scores):
    """Ruzzo and Tompa's recursion: the best segment, then what lies left and right of it."""
    best = None
    for start in range(len(scores)):
        for end in range(start + 1, len(scores) + 1):
            value = sum(scores[start:end])
            if value > 0 and (best is None or value > best[2] or value == best[2] and end - start < best[1] - best[0]):
                best = (start, end, value)
    if best is None:
        return []
    start, end, _ = best
    left = segments_by_definition(scores[:start])
    right = [(a + end, b + end, v) for a, b, v in segments_by_definition(scores[end:])]
    return [*left, best, *right]


def test_maximal_segments():
    dice = np.random.default_rng(3)
    for _ in range(200):
        scores = dice.normal(size=dice.integers(0, 14))
        got = toxicity.maximal_segments(scores)
        want = segments_by_definition(scores.tolist())
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def test_passages_are_found(spark):
    clean = {i: " ".join(f"w{(i * 7 + j) % 50}" for j in range(80)) for i in range(60)}
    foul = {100 + i: clean[i] + " vile vile rotten " + clean[i + 1] for i in range(30)}
    docs = plain_docs(spark, clean | foul)
    labels = labels_of(spark, [(i, 1, int(i >= 100)) for i in clean | foul])
    score = toxicity.scorer(toxicity.fit(docs, labels, F.col("doc_id") % 3 != 0), spark)
    rows = docs.select("doc_id", score("text").alias("s")).collect()
    assert all((row.s.score >= 0.7) == (row.doc_id >= 100) for row in rows)
    assert {(p.first, p.after) for row in rows for p in row.s.passages} == {(80, 83)}


def test_nearest_neighbours_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fit(docs, labels, F.lit(True))
    texts = [row.text for row in docs.collect()]
    got = model.vote(quality.raw_vectors(texts))
    vectors = model.project(quality.raw_vectors(texts))
    for vector, value in zip(vectors, got):
        near = sorted(zip((model.vectors @ vector).tolist(), model.labels.tolist()), reverse=True)[:quality.NEIGHBOURS]
        weights = [max(cosine, 0) ** 2 for cosine, _ in near]
        assert abs(sum(w * y for w, (_, y) in zip(weights, near)) / sum(weights) - value) < 0.05


def test_clashing_schema_stays(spark):
    assert odd_docs(spark).schema.simpleString() == spark.createDataFrame([], DOCS).schema.simpleString()


def test_a_sampled_key_brings_one_row(spark):
    """A key that repeats brings neither its rows' vectors nor their segments to the driver more than once."""
    texts = [f"clean words number {at} of many here" for at in range(20)] + [f"nasty vile words number {at}" for at in range(20)]
    rows = [(at, text) for at, text in enumerate(texts)] + [(3, f"repeated text {at % 7}") for at in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = labels_of(spark, [(at, int(at < 20), int(at >= 20)) for at in range(40)])
    model = quality.fit(docs, labels, F.lit(True))
    assert len(model.labels) == len(model.vectors) == 40 and sum(model.labels) == 20
    again = quality.fit(docs.orderBy(F.desc("text")), labels, F.lit(True))
    assert (again.vectors == model.vectors).all()
    sample = common.sampled_rows(docs.toDF("_key", "_text"), common.labelled_sample(labels, "toxic", F.lit(True), 40))
    assert sample.count() == 40 and sample.filter("_label = 1").count() == 20


def test_every_segment_counts_in_fitting(spark):
    """A text with more than 64 toxic stretches is weighed by all of them."""
    clean = words(5, 40)
    long = " ".join(" ".join(["vile", "nasty", *(clean[(at + step) % 40] for step in range(12))]) for at in range(200))
    texts = {at: " ".join(words(at, 80) + clean) for at in range(30)} | {at: long if at == 30 else f"vile nasty {' '.join(words(at, 60))}" for at in range(30, 60)}
    docs = plain_docs(spark, texts)
    model = toxicity.fit(docs, labels_of(spark, [(at, 0, int(at >= 30)) for at in range(60)]), F.lit(True))
    found = model.scores[toxicity.Buckets().of_text(long)]
    segments = [segment[2] for segment in toxicity.maximal_segments(found)]
    assert len(segments) > 64
    assert np.isclose(model.evidence.max(), model.evidence_of(segments, len(found)), rtol=1e-6)
    assert model.evidence.max() > model.evidence_of(sorted(segments)[-64:], len(found)) + 1
