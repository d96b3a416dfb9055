"""Spelling variants: near words by a dictionary of trie-node pairs, and the form each word is a variant of.

The words sorted make a trie whose nodes are numbered as they open; the words read backwards make another.
A word with a place left out is then a pair of integers: the node of what stands before the place and the
backward node of what stands behind it. Two words with the same pair differ by one replaced letter. A word
split between two letters is such a pair as well, and where it meets a word with a place left out, that
word has one letter more. Only nodes that two words share can meet, so a word lists no more pairs than its
common beginnings and endings with its neighbours in either order allow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.llm.common import crc32_text, interim, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[A-Za-zÀ-ÿ]+"
ROOT = -1  # the node of the empty beginning, and of the empty ending
SPLIT, INNER, FIRST = 0, 1, 2  # a split word; a left-out letter within a stretch of the same letter; the first of one


# --- words ------------------------------------------------------------------------------------------------


def vocabulary(docs: DataFrame, shortest: int = 7, least: int = 2, drop: int = 31, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words (word, n) of all texts that have ``shortest`` letters and occur ``least`` times.

    Words are maximal runs of letters in lower case (A-Z only). A run for which ``drop`` divides the CRC-32
    of ``<key>:<run>`` loses the letter at that CRC-32 modulo its length; a null key is written as nothing.
    """
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"),
                       F.explode(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    # A run that is too short cannot become long enough.
    runs = runs.filter(F.length("run") >= shortest).withColumn("crc", crc32_text(F.concat_ws(":", "key", "run")))
    at = (F.col("crc") % F.length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("crc") % drop == 0, without).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


# --- tries ------------------------------------------------------------------------------------------------


def common(one: str, other: str) -> int:
    """Length of the common beginning."""
    most = min(len(one), len(other))
    for at in range(most):
        if one[at] != other[at]:
            return at
    return most


def _opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted words of one partition with numbers of their nodes, counted as the nodes open in this partition.

    ``path`` has the numbers of the beginnings that the word may share (all of them for the first and the
    last word of the partition), ``node`` is that of the word itself, ``opened`` the number of nodes so far.
    """
    part, columns = TaskContext.get().partitionId(), ["word", "part", "path", "node", "opened"]
    before, nodes, opened, held = None, np.zeros(0, np.int64), 0, None  # held: the last word, whose next is not known yet

    def row(word: str, own: np.ndarray, shared: int, count: int) -> tuple:
        return word, part, own[:shared].astype("<i8").tobytes(), int(own[-1]), count

    for batch in batches:
        rows = []
        for word in batch["word"]:
            same = common(before, word) if before is not None else 0
            nodes = np.concatenate((nodes[:same], np.arange(opened, opened + len(word) - same)))
            opened += len(word) - same
            if held is not None:
                rows.append(row(held[0], held[1], max(held[2], same), held[3]))
            held = (word, nodes, same if before is not None else len(word), opened)
            before = word
        yield pd.DataFrame(rows, columns=columns)
    if held is not None:
        yield pd.DataFrame([row(held[0], held[1], len(held[0]), held[3])], columns=columns)


class Numbers:
    """From a partition's own node numbers to those of the whole trie.

    A partition's first word opens all its nodes, though the last word of the partition before may have
    opened some of them already; those are numbered as there. One entry per partition.
    """

    def __init__(self, borders: list[tuple[int, str, str, bytes, int]]):
        """Per partition in order: its number, first and last word, the last word's path, and its count of nodes."""
        self.base: dict[int, int] = {}
        self.known: dict[int, np.ndarray] = {}
        total, before, path = 0, "", np.zeros(0, np.int64)
        for part, first, last, own, opened in borders:
            self.base[part], self.known[part] = total, path[:common(before, first)]
            before, path = last, self.of(part, np.frombuffer(own, "<i8"))
            total += opened

    def of(self, part: int, nodes: np.ndarray) -> np.ndarray:
        known = self.known[part]
        numbers = nodes + self.base[part]
        early = nodes < len(known)
        numbers[early] = known[nodes[early]]
        return numbers


def _trie(words: DataFrame, purpose: str) -> tuple[DataFrame, Numbers]:
    """The distinct words as a trie: (word, part, path, node, opened), and how its nodes are numbered."""
    ordered = words.select("word").repartitionByRange("word").sortWithinPartitions("word")
    table = staged(ordered.mapInPandas(_opened, "word string, part int, path binary, node bigint, opened bigint"), purpose)
    borders = table.groupBy("part").agg(F.min("word"), F.max(F.struct("word", "path")).alias("_last"), F.max("opened").alias("_opened"))
    rows = borders.select("part", "min(word)", "_last.word", "_last.path", "_opened").orderBy("part").collect()
    return table, Numbers([tuple(row) for row in rows])


def _pairs(forward: Numbers, backward: Numbers):
    """Node pairs of every word: (before, behind, node, n, kind)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            columns = (batch[name] for name in ("word", "n", "part", "path", "node", "back_part", "back_path"))
            for word, n, part, path, node, back_part, back_path in zip(*columns):
                own = forward.of(part, np.frombuffer(path, "<i8"))
                back = backward.of(back_part, np.frombuffer(back_path, "<i8"))
                number = node + forward.base[part]
                size = len(word)
                before, behind = np.append(ROOT, own), np.append(ROOT, back)  # by length of the beginning, of the ending
                for gap in (0, 1):
                    # The beginning takes the places before `at`, the ending those from at + gap on.
                    at = np.arange(max(0, size - gap - len(back)), min(size - gap, len(own)) + 1)
                    if not len(at):
                        continue
                    kind = np.full(len(at), SPLIT)
                    if gap:
                        kind = np.array([FIRST if not place or word[place] != word[place - 1] else INNER for place in at.tolist()])
                    found.append((before[at], behind[size - gap - at], np.full(len(at), number), np.full(len(at), n), kind))
            joined = [np.concatenate(part) for part in zip(*found)] if found else [np.zeros(0, np.int64)] * 5
            yield pd.DataFrame(dict(zip(("before", "behind", "node", "n", "kind"), joined)))

    return run


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Near words (node, near, near_n), in both directions, from rows that arrive sorted by pair.

    The words of one pair differ in one letter, so there are at most as many as letters, and one split word.
    """
    names = ["before", "behind", "node", "n", "kind"]

    def near(rows: np.ndarray) -> pd.DataFrame:
        before, behind, node, n, kind = rows
        new = np.append(True, (before[1:] != before[:-1]) | (behind[1:] != behind[:-1]))
        last = np.append(np.flatnonzero(new)[1:], len(node))[np.cumsum(new) - 1]
        one, other = [], []
        alive, step = np.arange(len(node)), 1
        while len(alive := alive[alive + step < last[alive]]):
            a, b = alive, alive + step
            replaced = (kind[a] != SPLIT) & (kind[b] != SPLIT)
            # Of equal letters in a row only the first counts as the one too many.
            added = ((kind[a] == SPLIT) & (kind[b] == FIRST)) | ((kind[b] == SPLIT) & (kind[a] == FIRST))
            good = replaced | added
            one.append(a[good])
            other.append(b[good])
            step += 1
        a, b = (np.concatenate(part) if part else np.zeros(0, np.int64) for part in (one, other))
        mine, theirs = np.concatenate((a, b)), np.concatenate((b, a))
        return pd.DataFrame({"node": node[mine], "near": node[theirs], "near_n": n[theirs]})

    held = np.zeros((5, 0), np.int64)
    for batch in batches:
        rows = np.concatenate((held, batch[names].to_numpy(np.int64).T), axis=1)
        if not rows.shape[1]:
            continue
        # The last pair may go on in the next batch.
        cut = int(np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1])).max(initial=-1)) + 1
        if cut:
            yield near(rows[:, :cut])
        held = rows[:, cut:]
    if held.shape[1]:
        yield near(held)


def _neighbours(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words with their nodes (node, word, n), and near words (node, near, near_n) in both directions."""
    spark = words.sparkSession
    table, numbers = _trie(words, "trie")
    back, back_numbers = _trie(words.select(F.reverse("word").alias("word")), "back-trie")
    back = back.select(F.reverse("word").alias("word"), F.col("part").alias("back_part"), F.col("path").alias("back_path"))
    both = words.join(table.select("word", "part", "path", "node"), "word").join(back, "word")
    bases = spark.createDataFrame([(part, base) for part, base in numbers.base.items()], "part int, base bigint")
    named = table.select("word", "part", "node").join(F.broadcast(bases), "part").join(words, "word")
    named = staged(named.select((F.col("base") + F.col("node")).alias("node"), "word", "n"), "named")
    pairs = both.mapInPandas(_pairs(numbers, back_numbers), "before bigint, behind bigint, node bigint, n bigint, kind bigint")
    pairs = pairs.repartition("before", "behind").sortWithinPartitions("before", "behind")
    return named, staged(pairs.mapInPandas(_met, "node bigint, near bigint, near_n bigint"), "near")


def near_words(words: DataFrame) -> DataFrame:
    """All pairs (word, near) of distinct words that differ by one inserted, deleted or replaced code point, both ways.

    ``words`` has distinct words, none null or empty, with their counts (word, n). Words of any length are taken.
    """
    with interim(words.sparkSession):
        named, near = _neighbours(words)
        names = named.select(F.col("node").alias("near"), F.col("word").alias("_near"))
        pairs = near.join(named.select("node", "word"), "node").join(names, "near").select("word", F.col("_near").alias("near"))
        return staged(pairs, "near-words", keep=True)


def _roots(forms: DataFrame) -> DataFrame:
    """The last node of every chain of forms: (node, root). Each round doubles the steps taken."""
    roots = forms.select("node", F.col("form").alias("root"))
    while True:
        onward = roots.select(F.col("node").alias("_of"), F.col("root").alias("_next"))
        moved = staged(roots.join(onward, F.col("root") == F.col("_of"), "left").select(
            "node", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        roots = moved.select("node", "root")
        if moved.filter("_moved").isEmpty():
            return roots


def variants(docs: DataFrame, times: int = 10, key: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """Every word of the vocabulary with the word that it is a spelling variant of.

    Returns ``word``, ``form``: its near word of largest count (of equal counts the first in code-point
    order) where that is at least ``times`` the word's own, else null; ``root``: where the chain of forms
    ends, the word itself without a form; ``n``, ``n_near`` (number of near words, 0 if none), ``form_n``.
    See :func:`vocabulary` for the words and ``rules``.

    Null and empty texts have no words, and neither has an empty table. Repeated rows count each. A word of
    very many letters is a row like any other, with as many pairs as it shares beginnings and endings with
    other words. Other columns are not read.
    """
    with interim(docs.sparkSession):
        words = staged(vocabulary(docs, key=key, text=text, **rules), "vocabulary")
        named, near = _neighbours(words)
        # Nodes are numbered in the order of the words, so the smaller number is the first word.
        best = near.groupBy("node").agg(F.count("*").alias("n_near"), F.max(F.struct("near_n", (-F.col("near")).alias("less"))).alias("_best"))
        best = best.select(F.col("node").alias("_node"), "n_near", (-F.col("_best.less")).alias("_form"), F.col("_best.near_n").alias("_form_n"))
        has_form: Column = F.col("_form_n") >= times * F.col("n")
        joined = named.join(best, F.col("node") == F.col("_node"), "left").select(
            "node", "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(has_form, F.col("_form")).alias("form"), F.when(has_form, F.col("_form_n")).alias("form_n"))
        joined = staged(joined, "forms")
        roots = _roots(joined.filter("form is not null").select("node", "form"))
        names = named.select(F.col("node").alias("_node"), F.col("word").alias("_word"))
        led = joined.filter("form is not null").join(roots, "node")
        led = led.join(names.withColumnsRenamed({"_node": "form", "_word": "_form"}), "form").drop("form")
        led = led.join(names.withColumnsRenamed({"_node": "root", "_word": "_root"}), "root").drop("root")
        led = led.select("word", F.col("_form").alias("form"), F.col("_root").alias("root"), "n", "n_near", "form_n")
        alone = joined.filter("form is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
        return staged(led.unionByName(alone), "variants", keep=True)
