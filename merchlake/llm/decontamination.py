"""Benchmark decontamination by greedy string tiling.

Running Karp-Rabin hashes of every document's words are looked up among those of the benchmark items. Each
shared seed is extended to its whole match; the longest match is marked first, marked words are not used
again, and the rest of a match that overlaps a marked one is tried again with what is left of it. An item
whose words are covered by such tiles to the threshold is contained in the document, in whatever order.
Signs that stand alone ('+', '=', '|') are no words: items and documents are compared without them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.llm.common import staged

SHORTEST = 5  # words of the shortest tile
COVERAGE = 0.5  # share of an item's words that must be tiled
BLOCK_CHARS = 16_000_000  # benchmark text that is broadcast at once
CACHED_WORDS = 300_000
BASE = np.uint64(0x9E3779B97F4A7C15)
PUNCTUATION = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum())


class Vocabulary(dict):
    """Number of a word as it stands in a text, by its form without case and outer punctuation.

    0: in no item; -1: punctuation alone.
    """

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: str) -> int:
        form = word.strip(PUNCTUATION)
        value = self.numbers.get(form, 0) if form else -1
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value
        return value

    def of_text(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a text's words without punctuation alone, and each one's place with it."""
        words = text.lower().split()
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        places = np.flatnonzero(numbers >= 0)
        return numbers[places], places


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``size`` words, modulo 2^64."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for at in range(size):
        total = total * BASE + words[at:at + count].astype(np.uint64)
    return total


class Items:
    """Benchmark items of one block with the sorted hashes of their seeds."""

    def __init__(self, rows: list[tuple], shortest: int):
        self.shortest, self.keys, self.texts, self.origins = shortest, [row[0] for row in rows], [], []
        numbers: dict[str, int] = {}
        for _, text in rows:
            words = [word.strip(PUNCTUATION) for word in (text or "").lower().split()]
            self.texts.append(np.array([numbers.setdefault(word, len(numbers) + 1) for word in words if word], np.int64))
            self.origins.append(np.array([at for at, word in enumerate(words) if word], np.int64))
        self.numbers = numbers
        hashes, owners, places = [], [], []
        for number, words in enumerate(self.texts):
            own = rolling(words, shortest)
            hashes.append(own)
            owners.append(np.full(len(own), number))
            places.append(np.arange(len(own)))
        empty = np.zeros(0, np.int64)
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.owners = (np.concatenate(owners) if owners else empty)[order]
        self.places = (np.concatenate(places) if places else empty)[order]

    def seeds(self, words: np.ndarray) -> Seeds:
        """Seeds that a document shares with the items. Places of one seed are listed once, however often it occurs."""
        none = np.zeros(0, np.int64)
        # Only windows of words that items hold need a hash.
        known = np.cumsum(np.concatenate(([0], words != 0)))
        windows = np.flatnonzero(known[self.shortest:] - known[:-self.shortest] == self.shortest)
        if not len(self.hashes) or not len(windows):
            return Seeds(none, none, none, none, none)
        hashes = np.zeros(len(windows), np.uint64)
        for at in range(self.shortest):
            hashes = hashes * BASE + words[windows + at].astype(np.uint64)
        order = np.argsort(hashes, kind="stable")
        own, starts = np.unique(hashes[order], return_index=True)
        low, high = np.searchsorted(self.hashes, own), np.searchsorted(self.hashes, own, "right")
        times = high - low
        entries = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        numbers = np.repeat(np.arange(len(own)), times)
        by_item = np.lexsort((self.places[entries], self.owners[entries]))
        return Seeds(self.owners[entries][by_item], self.places[entries][by_item], numbers[by_item],
                     windows[order], np.append(starts, len(order)))


class Seeds(NamedTuple):
    """Shared seeds by (item, place in the item) with their number; seed s lies at ``windows[starts[s]:starts[s + 1]]``."""

    owners: np.ndarray
    places: np.ndarray
    numbers: np.ndarray
    windows: np.ndarray
    starts: np.ndarray


def matches(item: np.ndarray, words: np.ndarray, places: np.ndarray, found: list[np.ndarray], shortest: int) -> np.ndarray:
    """Longest possible matches (place in the item, place in the document, length) of at least ``shortest`` words.

    ``found`` has for each place of the item, ascending, the document's places of its seed, ascending. One
    place after the other prolongs the matches that reach it, so what is held follows the document's length
    and the number of matches, not that of all pairs of places.
    """
    done, before = [np.zeros((0, 3), np.int64)], -1
    diagonals, since = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def end(over: np.ndarray) -> None:
        done.append(np.stack((since[over], diagonals[over] + since[over], before - since[over] + shortest), axis=1))

    for place, own in zip(places.tolist(), found):
        # A hash may meet by chance, so the words themselves decide.
        own = own[np.all(words[own[:, None] + np.arange(shortest)] == item[place:place + shortest], axis=1)]
        reached = own - place
        starts = np.full(len(reached), place)
        if place == before + 1 and len(diagonals):
            at = np.minimum(np.searchsorted(diagonals, reached), len(diagonals) - 1)
            goes_on = diagonals[at] == reached
            starts[goes_on] = since[at[goes_on]]
            over = np.ones(len(diagonals), bool)
            over[at[goes_on]] = False
            end(over)
        else:
            end(np.ones(len(diagonals), bool))
        diagonals, since, before = reached, starts, place
    end(np.ones(len(diagonals), bool))
    return np.concatenate(done)


def tiles(item: np.ndarray, words: np.ndarray, found: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the item, place in the document, length) from matches, the longest first.

    Equal lengths go by place in the item, then in the document.
    """
    heap = [(-n, i, d) for i, d, n in found.tolist()]
    heapq.heapify(heap)
    in_item, in_words, kept = np.zeros(len(item), bool), np.zeros(len(words), bool), []
    left = len(item)
    while heap and left >= shortest:
        length, i, d = heapq.heappop(heap)
        length = -length
        marked = in_item[i:i + length] | in_words[d:d + length]
        if not marked.any():
            kept.append((i, d, length))
            in_item[i:i + length] = True
            in_words[d:d + length] = True
            left -= length
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([True], marked, [True])).astype(np.int8)))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start >= shortest:
                heapq.heappush(heap, (-(end - start), i + start, d + start))
    return sorted(kept)


def _search(shared, coverage: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = shared.value
        vocabulary = Vocabulary(items.numbers)
        columns = ["key", "item", "covered", "words", "tiles"]
        for batch in batches:
            rows = []
            for key, text in zip(batch["key"], batch["text"]):
                if not text:
                    continue
                words, origins = vocabulary.of_text(text)
                seeds = items.seeds(words)
                places = seeds.places
                for number, start, count in zip(*np.unique(seeds.owners, return_index=True, return_counts=True)):
                    item, span = items.texts[number], slice(start, start + count)
                    # What all seeds cover together is the most that tiles can cover.
                    most = np.zeros(len(item), bool)
                    for at in range(items.shortest):
                        most[places[span] + at] = True
                    if most.sum() < coverage * len(item):
                        continue
                    found = [seeds.windows[seeds.starts[at]:seeds.starts[at + 1]] for at in seeds.numbers[span].tolist()]
                    own = tiles(item, words, matches(item, words, places[span], found, items.shortest), items.shortest)
                    covered = sum(tile[2] for tile in own)
                    if covered >= coverage * len(item):
                        own_origins = items.origins[number]
                        rows.append((key, items.keys[number], covered, len(item),
                                     [{"item_start": own_origins[i], "doc_start": origins[d], "length": n} for i, d, n in own]))
            yield pd.DataFrame(rows, columns=columns)

    return run


def _blocks(texts: DataFrame, shortest: int) -> Iterator:
    """Distinct texts (_text) of the benchmark in blocks of bounded size, each broadcast; an item's key is its digest."""
    chars = texts.agg(F.sum(F.length("_text"))).first()[0] or 0
    blocks = max(1, -(-2 * chars // BLOCK_CHARS))
    for block in range(blocks):
        own = texts.filter(F.pmod(F.xxhash64("_text"), F.lit(blocks)) == block).select(_digest("_text"), "_text").orderBy("_text")
        yield texts.sparkSession.sparkContext.broadcast(Items([tuple(row) for row in own.collect()], shortest)), block == blocks - 1


def _digest(text: str) -> Column:
    return F.md5(F.col(text).cast("binary"))


def contained_items(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, shortest: int = SHORTEST,
                    key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of document and benchmark item: ``key``, ``item``, ``covered`` and ``words`` (of the item), ``tiles``.

    Words are compared without case and outer punctuation. Punctuation that stands alone is no word: it
    neither parts a tile nor counts in ``covered``, ``words`` and a tile's length, but a tile's starts are
    places among all that white space parts. An item of fewer than ``shortest`` words cannot be told from
    chance and is contained nowhere; null and empty texts contain nothing and are contained
    nowhere. Repeated rows and equal or null keys give a row each. The benchmark is searched for in blocks
    of bounded size, one after the other broadcast to one pass over the documents; an empty one gives no row.
    Items of equal texts are searched for once. What a task holds follows the length of a text, also of one
    that says the same few words over and over.
    """
    schema = (f"key {docs.schema[key].dataType.simpleString()}, item string, covered bigint, words bigint, "
              "tiles array<struct<item_start:bigint,doc_start:bigint,length:bigint>>")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item).alias("_item"), F.col(item_text).alias("_text")).filter(F.col("_text").isNotNull())
    found = []
    for shared, last in _blocks(items.select("_text").distinct(), shortest):
        own = rows.mapInPandas(_search(shared, coverage), schema)
        if not last:
            own = staged(own, "hits")
            shared.destroy()
        found.append(own)
    result = reduce(DataFrame.union, found).join(items.select("_item", _digest("_text").alias("_of")), F.col("item") == F.col("_of"))
    return result.select(F.col("key").alias(key), F.col("_item").alias(item), "covered", "words", "tiles")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, shortest: int = SHORTEST,
                         text: str = "text", item_text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose texts contain no benchmark item (see ``contained_items``)."""
    texts = benchmark.select(F.col(item_text).alias("_text")).filter(F.col("_text").isNotNull()).distinct()
    for shared, last in _blocks(texts, shortest):
        docs = docs.filter(~_contaminated(shared, coverage)(F.col(text)))
        if not last:
            docs = staged(docs, "uncontaminated")
            shared.destroy()
    return docs


def _contaminated(shared, coverage: float):
    search = _search(shared, coverage)

    @F.pandas_udf("boolean")
    def contaminated(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            numbered = pd.DataFrame({"key": np.arange(len(column)), "text": column.to_numpy()})
            flags = np.zeros(len(column), bool)
            for hits in search(iter([numbered])):
                flags[hits["key"].to_numpy(np.int64)] = True
            yield pd.Series(flags)

    return contaminated
