import collections
import random
import time

import pytest
from helpers import no_docs, odd_docs, odd_rows, plain_docs, words
from pyspark.sql import functions as F

from merchlake.llm import decontamination, lines


def by_brute_force(rows, min_words):
    """Every stretch of lines in order of (key, place): what occurred before goes from ``min_words`` words on."""
    seen, out = set(), {}
    for key, text in sorted(rows):
        own = text.split("\n")
        gone = set()
        for start in range(len(own)):
            total = 0
            for end in range(start, len(own)):
                total += len(own[end].split())
                if total >= min_words:
                    stretch = "\n".join(own[start:end + 1])
                    if stretch in seen:
                        gone.update(range(start, end + 1))
                    seen.add(stretch)
        out[key] = "\n".join(line for at, line in enumerate(own) if at not in gone)
    return out


@pytest.mark.parametrize("min_words", [1, 6, 15])
def test_repeated_runs(spark, min_words):
    dice = random.Random(min_words)
    pool = [" ".join(words(at, dice.randint(1, 6))) for at in range(12)] + [""]
    texts = {}
    for key in range(60):
        own = [dice.choice(pool) if dice.random() < 0.8 else f"only here {key} {at}" for at in range(dice.randint(1, 25))]
        if key % 3 == 2:
            earlier = texts[dice.randrange(key)].split("\n")
            start = dice.randrange(len(earlier))
            own[dice.randrange(len(own)):] = earlier[start:start + dice.randint(1, 15)]
        texts[key] = "\n".join(own)
    got = {row.doc_id: row.text for row in lines.dedupe(plain_docs(spark, texts), min_words).collect()}
    assert got == by_brute_force(texts.items(), min_words)


def test_one_line_many_times(spark):
    texts = {1: "\n".join(["a b c"] * 500), 2: "a b c\nd", 3: "\n".join(["x"] * 3)}
    got = {row.doc_id: (row.text, row.lines_removed) for row in lines.dedupe(plain_docs(spark, texts), 3).collect()}
    assert got == {1: ("a b c", 499), 2: ("d", 1), 3: ("x\nx\nx", 0)}


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = lines.dedupe(docs, 50).collect()
    assert lines.dedupe(docs).columns == [*docs.columns, "lines_removed"]
    got = collections.Counter((row.doc_id, row.text) for row in rows)
    want = collections.Counter()
    for key, text, *_ in odd_rows():
        # The text of keys 1, 2 and null stays in the row with the null key, which comes first.
        want[key, "" if key in (1, 2) else text] += 1
    assert got == want and all(row["node.n"] == 1 and row["_key"] == "k" for row in rows)
    assert lines.dedupe(no_docs(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = lines.dedupe(odd_docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


ITEM = "seven quick foxes jumped over the lazy brown dogs while nobody was looking at them today"


def found(spark, texts, items, **options):
    docs, benchmark = plain_docs(spark, texts), spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    return {(row.doc_id, row.item_id): row for row in decontamination.contained_items(docs, benchmark, **options).collect()}


def test_passages_and_reordered_passages(spark):
    own = ITEM.split()
    filler = " ".join(words(3, 40))
    texts = {1: f"{filler} {ITEM.upper()}! {filler}", 2: " ".join([*own[8:], filler, *own[:8]]), 3: filler, 4: " ".join(own[:5]), 5: " ".join(own[::-1])}
    rows = found(spark, texts, {10: ITEM, 11: "too short", 12: "", 13: " ".join(words(99, 30))})
    assert set(rows) == {(1, 10), (2, 10)}
    assert rows[1, 10].covered == len(own) and len(rows[1, 10].tiles) == 1
    assert rows[2, 10].covered == len(own) and len(rows[2, 10].tiles) == 2


def test_signs_that_stand_alone(spark):
    item = "What is 12 + 30 - 5 ? Answer : x = 37 ."
    texts = {1: f"before | it {item} after", 2: item.replace(" +", "").replace(" :", " |"), 3: "What + is + 12 + now"}
    rows = found(spark, texts, {10: item, 11: "+ - = | : { }"})
    assert set(rows) == {(1, 10), (2, 10)}
    assert all((row.covered, row.words) == (8, 8) for row in rows.values())
    assert [tuple(tile) for tile in rows[1, 10].tiles] == [(0, 3, 8)]
    cut = found(spark, {1: "= seven | quick foxes : jumped - over x"}, {10: "; zero seven quick foxes jumped over"})
    assert [tuple(tile) for tile in cut[1, 10].tiles] == [(2, 1, 5)]
    kept = decontamination.without_contaminated(plain_docs(spark, texts), spark.createDataFrame([(10, item)], "item_id bigint, text string"))
    assert [row.doc_id for row in kept.collect()] == [3]


def tiles_by_definition(item, text, shortest):
    """Wise's greedy tiling as written: all longest matches of unmarked words, round by round."""
    in_item, in_text, kept = [False] * len(item), [False] * len(text), []
    while True:
        best = []
        for i in range(len(item)):
            for d in range(len(text)):
                n = 0
                while i + n < len(item) and d + n < len(text) and item[i + n] == text[d + n] and not in_item[i + n] and not in_text[d + n]:
                    n += 1
                if n >= shortest:
                    best.append((-n, i, d))
        if not best:
            return sorted(kept)
        n, i, d = min(best)
        kept.append((i, d, -n))
        in_item[i:i - n] = [True] * -n
        in_text[d:d - n] = [True] * -n


def test_tiles_by_definition():
    import numpy as np

    dice = random.Random(11)
    for _ in range(150):
        item = [dice.randint(1, 3) for _ in range(dice.randint(3, 14))]
        text = [dice.randint(1, 4) for _ in range(dice.randint(3, 22))]
        own = {i: [d for d in range(len(text) - 1) if item[i:i + 2] == text[d:d + 2]] for i in range(len(item) - 1)}
        places = np.array([i for i, where in own.items() if where], np.int64)
        whole = decontamination.matches(np.array(item), np.array(text), places, [np.array(own[i]) for i in places.tolist()], 2)
        assert decontamination.tiles(np.array(item), np.array(text), whole, 2) == tiles_by_definition(item, text, 2)


def test_benchmark_in_blocks(spark, monkeypatch):
    items = {at: " ".join(words(50 + at, 20)) for at in range(12)}
    texts = {at: " ".join([*words(200 + at, 30), items[at], *words(300 + at, 30)]) for at in range(12)}
    whole = {key: row.covered for key, row in found(spark, texts, items).items()}
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 500)
    assert {key: row.covered for key, row in found(spark, texts, items).items()} == whole
    assert set(whole) >= {(at, at) for at in range(12)}
    kept = decontamination.without_contaminated(plain_docs(spark, texts | {99: "clean words only here"}),
                                                spark.createDataFrame(list(items.items()), "item_id bigint, text string"))
    assert [row.doc_id for row in kept.collect()] == [99]


def test_odd_rows_and_tables(spark):
    benchmark = spark.createDataFrame([(1, " ".join(words(1, 60))), (1, None), (None, " ".join(words(1, 60))), (2, "")], "item_id bigint, text string")
    rows = decontamination.contained_items(odd_docs(spark), benchmark).collect()
    assert collections.Counter(row.doc_id for row in rows) == {1: 2, 2: 4, None: 2, 9: 2}
    nothing = benchmark.filter(F.lit(False))
    assert decontamination.contained_items(odd_docs(spark), nothing).count() == 0
    assert decontamination.contained_items(no_docs(spark), benchmark).count() == 0
    kept = decontamination.without_contaminated(odd_docs(spark), benchmark)
    assert kept.schema == odd_docs(spark).schema and kept.count() == len(odd_rows()) - 5
    assert decontamination.without_contaminated(odd_docs(spark), nothing).count() == len(odd_rows())


def plainly_cleaned(text, spans):
    gone = {at for a, b in spans for at in range(a, b + 1)}
    return "\n".join(line for at, line in enumerate(text.split("\n")) if at not in gone)


@pytest.mark.parametrize("spans", [[], [(0, 0)], [(0, 4)], [(4, 4)], [(1, 2), (4, 4)], [(0, 0), (1, 1), (3, 3)]])
def test_spans_go_from_texts(spark, spans):
    texts = ["a\nb\nc\nd\ne", "\n\n\n\n", "x\n\ny\n\n"]
    df = spark.createDataFrame([(text, spans) for text in texts], "text string, spans array<struct<a: int, b: int>>")
    got = [row[0] for row in df.select(lines.without_spans(F.col("text"), F.col("spans"))).collect()]
    assert got == [plainly_cleaned(text, spans) for text in texts]


@pytest.mark.parametrize("each", [2, 25_000])
def test_texts_of_very_many_lines(spark, each):
    """Cleaning takes linear time, with one long span as with very many short ones."""
    text = "\n".join(f"line {at}" for at in range(50_000))
    spans = [(at, at + each // 2 - 1) for at in range(0, 50_000, each)]
    df = spark.createDataFrame([(text, spans)], "text string, spans array<struct<a: int, b: int>>")
    began = time.time()
    got = df.select(lines.without_spans(F.col("text"), F.col("spans"))).first()[0]
    assert got == plainly_cleaned(text, spans) and time.time() - began < 10


def plain_words(text):
    forms = (word.strip(decontamination.PUNCTUATION) for word in (text or "").lower().split())
    return [word for word in forms if word]


def test_contained_items_by_definition(spark):
    dice = random.Random(4)
    few = [f"w{at}" for at in range(9)]
    items = {at: " ".join(dice.choice(few) for _ in range(dice.randint(3, 14))) for at in range(25)}
    texts = {at: " ".join(dice.choice([*few, "-", "else,"]) for _ in range(dice.randint(0, 60))) for at in range(40)}
    for at in range(25):
        own = items[at].split()
        cut = dice.randrange(len(own))
        texts[100 + at] = " ".join([*texts[at].split(), *own[cut:], "between", *own[:cut], "| end"])
    want = {}
    for key, text in texts.items():
        for item, item_text in items.items():
            own = plain_words(item_text)
            covered = sum(tile[2] for tile in tiles_by_definition(own, plain_words(text), 5))
            if covered and covered >= 0.5 * len(own):
                want[key, item] = covered
    got = found(spark, texts, items)
    assert {pair: row.covered for pair, row in got.items()} == want and len(want) > 10


def test_texts_of_few_words_over_and_over(spark):
    texts = {1: "ha " * 30_000, 2: "ha ho " * 15_000, 3: "ha " * 30_000 + "other words"}
    began = time.time()
    got = found(spark, texts, {10: "ha " * 500, 11: "ha ho " * 200, 12: "ho " * 40})
    assert set(got) == {(1, 10), (3, 10), (2, 11)} and got[1, 10].covered == 500 and got[2, 11].covered == 400
    assert time.time() - began < 60


def test_matches_hold_no_list_of_all_pairs():
    """Peak memory for one document and one item of a single word."""
    import tracemalloc

    items = decontamination.Items([("x", "ha " * 500)], 5)
    words_of = decontamination.Vocabulary(items.numbers).of_text("ha " * 20_000)[0]
    tracemalloc.start()
    seeds = items.seeds(words_of)
    places = [seeds.windows[seeds.starts[at]:seeds.starts[at + 1]] for at in seeds.numbers.tolist()]
    tiled = decontamination.tiles(items.texts[0], words_of, decontamination.matches(items.texts[0], words_of, seeds.places, places, 5), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tiled == [(0, 0, 500)] and peak < 60_000_000


def test_repeated_items_are_searched_once(spark, monkeypatch):
    items = [(at, ITEM) for at in range(30)] + [(100 + at, " ".join(words(400 + at, 20))) for at in range(30)]
    sizes, whole = [], decontamination.Items.__init__

    def counted(self, rows, shortest):
        sizes.append(len(rows))
        whole(self, rows, shortest)

    monkeypatch.setattr(decontamination.Items, "__init__", counted)
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 2500)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontamination.contained_items(plain_docs(spark, {1: f"so {ITEM} there"}), benchmark).collect()
    assert sorted(row.item_id for row in rows) == list(range(30))
    assert sum(sizes) == 31 and max(sizes) < 25
