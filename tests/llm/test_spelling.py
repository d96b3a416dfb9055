import random
import re
import zlib
from collections import Counter

import pandas as pd
import pytest
from helpers import no_docs, odd_docs, odd_rows, plain_docs

from merchlake.llm import spelling


def deletions(word):
    return {word[:at] + word[at + 1:] for at in range(len(word))}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and short in deletions(long)


def words_of(rows, shortest=7, least=2):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            crc = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if crc % 31 == 0:
                run = run[:crc % len(run)] + run[crc % len(run) + 1:]
            if len(run) >= shortest:
                counts[run] += 1
    return {word: n for word, n in counts.items() if n >= least}


def by_force(counts, times=10):
    near = {word: [other for other in counts if is_near(word, other)] for word in counts}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda other: (-counts[other], other), default=None)
        form[word] = best if best and counts[best] >= times * counts[word] else None
    found = []
    for word in counts:
        root = word
        while form[root]:
            root = form[root]
        found.append((word, form[word], root, counts[word], len(near[word]), counts[form[word]] if form[word] else None))
    return sorted(found)


def found_in(df, **more):
    return sorted(tuple(row) for row in spelling.variants(df, **more).select("word", "form", "root", "n", "n_near", "form_n").collect())


def variant(dice, word):
    at, letter = dice.randrange(len(word)), dice.choice("abé")
    return dice.choice([word[:at] + word[at + 1:], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1:]])


@pytest.mark.parametrize("seed", range(4))
def test_near_words_equal_all_pairs(spark, seed):
    dice = random.Random(seed)
    words = {"".join(dice.choice("abé"[:2 + seed % 2]) for _ in range(dice.randint(1, 8))) for _ in range(200)}
    words |= {variant(dice, word) for word in list(words)} - {""}
    rows = [(word, 1 + at) for at, word in enumerate(sorted(words))]
    df = spark.createDataFrame(rows, "word string, n bigint")
    got = sorted(tuple(row) for row in spelling.near_words(df).collect())
    assert got == sorted((a, b) for a in words for b in words if is_near(a, b))


def test_forms_and_chains(spark):
    dice = random.Random(7)
    base = ["".join(dice.choice("abcdeéß") for _ in range(dice.randint(7, 11))) for _ in range(12)]
    text = {}
    for key in range(60):
        own = []
        for word in base:
            own += [word.upper() if dice.random() < 0.2 else word] * dice.choice([1, 3, 12])
            once = variant(dice, word)
            own += [once] * dice.choice([0, 0, 1, 2]) + [variant(dice, once)] * dice.choice([0, 0, 0, 1])
        text[key] = " ".join(own) + "; ..12 short"
    # A chain of three: 400, 30 and 2 occurrences, one letter apart each.
    text |= {100 + key: "chainéword " * 400 + "chainéwor " * 30 + "chainéwo " * 2 for key in range(1)}
    counts = words_of(text.items())
    got = found_in(plain_docs(spark, text).repartition(5))
    assert got == by_force(counts)
    assert sum(row[1] is not None for row in got) > 10 and any(row[1] and row[2] != row[1] for row in got)


def test_odd_rows(spark):
    counts = words_of([(row[0], row[1]) for row in odd_rows()])
    assert found_in(odd_docs(spark)) == by_force(counts)
    assert found_in(no_docs(spark)) == []
    rows = [(None, "wordwordword wordwordword", "k", 1), (1, None, "k", 2), (2, "", "k", 3), (3, "WordWordWord wordwordwor wordwordwor", "k", 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, word string, n int")
    assert found_in(df, times=1) == by_force(words_of([row[:2] for row in rows]), times=1)


def test_very_long_words(spark):
    dice = random.Random(2)
    word = "".join(dice.choice("abcdefgh") for _ in range(60_000))
    texts = {1: f"{word} {word} {word[:-1]} {word[:-1]}", 2: f"{word[:30_000]}Y{word[30_000:]} " * 2}
    counts = words_of(texts.items())
    got = {row[0]: row[4] for row in found_in(plain_docs(spark, texts))}
    # All pairs by the edit test would take too long; the words are compared by their ends.
    long = sorted(counts, key=len)
    want = {a: sum(1 for b in long if a != b and near_by_ends(a, b)) for a in long}
    assert got == want and sum(want.values()) >= 2


def near_by_ends(a, b):
    head = spelling.common(a, b)
    tail = spelling.common(a[head:][::-1], b[head:][::-1])
    rest = max(len(a), len(b)) - head - tail
    return abs(len(a) - len(b)) <= 1 and rest == 1


def test_nodes_are_shared_across_partitions(spark):
    words = ["prefix" + format(at, "06b") for at in range(60)]
    halves = [words[:20], words[20:40], words[40:]]
    numbers, tables = [], []
    def rows_of(part, own):
        spelling.TaskContext, kept = type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: part)}))}), spelling.TaskContext
        try:
            return pd.concat(list(spelling._opened(iter([pd.DataFrame({"word": own[:7]}), pd.DataFrame({"word": own[7:]})]))))
        finally:
            spelling.TaskContext = kept

    for part, own in enumerate(halves):
        table = rows_of(part, own)
        tables.append(table)
        last = table.iloc[-1]
        numbers.append((part, own[0], own[-1], last.path, int(table.opened.max())))
    whole = spelling.Numbers(numbers)
    nodes = {}
    for part, table in enumerate(tables):
        for word, path in zip(table.word, table.path):
            for depth, node in enumerate(whole.of(part, spelling.np.frombuffer(path, "<i8")).tolist(), 1):
                assert nodes.setdefault(word[:depth], node) == node
    assert len(set(nodes.values())) == len(nodes)
