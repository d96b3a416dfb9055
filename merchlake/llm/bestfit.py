"""Best-fit packing with exact complements.

Every document becomes token ids; only what is longer than a sequence is cut. Full pieces are sequences by
themselves, so what is left to pack is a count for each length below a sequence's. The plan is made on these
counts alone, which are as many as a sequence has tokens, whatever the size of the corpus: sums of one, two
and three lengths are indexed, combinations that fill the gap beside a longer piece exactly are consumed
as often as their counts allow, and best fit places the rest. A plan says which numbers of a length go to
which sequences; the pieces are numbered by length with sums over partitions.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from merchlake.llm.common import arrow_rows, staged
from merchlake.llm.packing import TEXTS, text_ids

BATCH_BYTES = 2_000_000
BROADCAST_PARTITIONS = 2000  # partitions up to which the numbers before each (8 bytes a length) are broadcast


# --- the plan: from counts of lengths to shapes of sequences ------------------------------------------


class Shape(NamedTuple):
    """``times`` sequences that hold these lengths, in this order."""

    lengths: tuple[int, ...]
    times: int


class Supply:
    """Counts of lengths still to be placed, with an index of the sums of one, two and three lengths."""

    def __init__(self, counts: np.ndarray, length: int):
        self.left = [int(count) for count in counts]
        self.length = length
        present = [size for size in range(1, length) if self.left[size]]
        # pairs[s]: the larger parts of all sums a + b = s, the largest first.
        self.pairs: dict[int, list[int]] = defaultdict(list)
        for a in reversed(present):
            for b in present[:bisect.bisect_right(present, min(a, length - a))]:
                self.pairs[a + b].append(a)

    def times(self, lengths: tuple[int, ...]) -> int:
        """How often this combination is still there."""
        return min(self.left[size] // lengths.count(size) for size in lengths)

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for size in lengths:
            self.left[size] -= times

    def pair(self, total: int, beside: tuple[int, ...]) -> tuple[int, ...] | None:
        """Two lengths of this sum that are there together with those beside them. Used-up ones leave the index."""
        index = self.pairs.get(total)
        if not index:
            return None
        still = [a for a in index if self.left[a] and self.left[total - a]]
        if len(still) < len(index):
            self.pairs[total] = still
        return next(((a, total - a) for a in still if self.times((*beside, a, total - a))), None)

    def complement(self, gap: int, beside: tuple[int, ...], parts: int) -> tuple[int, ...] | None:
        """One, two or three lengths (``parts`` at most) that fill the gap exactly, the fewest and largest first."""
        if self.left[gap] and self.times((*beside, gap)):
            return (gap,)
        two = self.pair(gap, beside) if parts > 1 else None
        if two or parts < 3:
            return two
        # A sum of three is a single and a pair: the largest part leads, so the pair's sum runs upwards.
        for rest in range(2, gap - (gap + 2) // 3 + 1):
            if self.left[gap - rest] and self.times((*beside, gap - rest)):
                two = self.pair(rest, (*beside, gap - rest))
                if two:
                    return (gap - rest, *two)
        return None


def exact_shapes(supply: Supply, parts: int = 3) -> list[Shape]:
    """Full sequences: each length, the largest first, with complements that fill its gap exactly."""
    found = []
    for size in range(supply.length - 1, 0, -1):
        while supply.left[size]:
            rest = supply.complement(supply.length - size, (size,), parts)
            if rest is None:
                break
            lengths = (size, *rest)
            times = supply.times(lengths)
            supply.take(lengths, times)
            found.append(Shape(lengths, times))
    return found


def best_fit_shapes(left: list[int], length: int) -> list[Shape]:
    """What is left, the largest first, each into the open sequence that it fills best."""
    open_: dict[int, list[list]] = defaultdict(list)  # gap: [lengths, times]
    gaps: list[int] = []  # sorted gaps with open sequences
    done: list[Shape] = []

    def leave(gap: int, lengths: tuple[int, ...], times: int) -> None:
        if not gap:
            done.append(Shape(lengths, times))
            return
        if not open_[gap]:
            bisect.insort(gaps, gap)
        open_[gap].append([lengths, times])

    for size in range(length - 1, 0, -1):
        count = left[size]
        while count:
            at = bisect.bisect_left(gaps, size)
            if at == len(gaps):
                # No open sequence takes it: new ones, each filled with as many of the length as it holds.
                each = min(length // size, count)
                times = count // each
                leave(length - each * size, (size,) * each, times)
                count -= times * each
                continue
            gap = gaps[at]
            lengths, times = open_[gap].pop()
            if not open_[gap]:
                gaps.pop(at)
            each = min(gap // size, count)
            used = min(times, count // each)
            if used < times:
                leave(gap, lengths, times - used)
            leave(gap - each * size, lengths + (size,) * each, used)
            count -= used * each
    done += [Shape(lengths, times) for gap in gaps for lengths, times in open_[gap]]
    return done


def shapes_of(counts: np.ndarray, length: int) -> list[Shape]:
    """Shapes of all sequences for these counts by length (index 0 is not used).

    Complements of three parts may use up short pieces that best fit needs later, so the plan is made with
    one, two and three parts at most, and the one of fewest sequences counts.
    """
    plans = []
    for parts in (3, 2, 1):
        supply = Supply(counts, length)
        plans.append(exact_shapes(supply, parts) + best_fit_shapes(supply.left, length))
    return min(plans, key=lambda shapes: sum(shape.times for shape in shapes))


class Plan:
    """Where the number of a piece among those of its length leads."""

    def __init__(self, counts: np.ndarray, length: int):
        self.length = length
        numbers, firsts = defaultdict(list), [0] * length
        base = 0
        for lengths, times in shapes_of(counts, length):
            offset = 0
            for size in dict.fromkeys(lengths):
                each = lengths.count(size)
                numbers[size].append((firsts[size], base, offset, each))
                firsts[size] += times * each
                offset += size * each
            base += times
        self.sequences = base
        rows = [(size, *row) for size in sorted(numbers) for row in numbers[size]]
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.starts = np.searchsorted(table[:, 0], np.arange(length + 1))
        # Lengths and first numbers ascend together, so one search finds a piece's row.
        self.sizes, self.first, self.base, self.offset, self.each = table.T

    def place(self, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces shorter than a sequence."""
        at = np.zeros(len(sizes), np.int64)
        for size in np.unique(sizes):
            own = sizes == size
            low, high = self.starts[size], self.starts[size + 1]
            at[own] = low + np.searchsorted(self.first[low:high], numbers[own], "right") - 1
        within = numbers - self.first[at]
        return self.base[at] + within // self.each[at], self.offset[at] + within % self.each[at] * sizes


# --- the pieces -----------------------------------------------------------------------------------------


def _tokenise(files: tuple[str, str], end_id: int, length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their ids, the size of the first piece, and how many such (or full) ones came before in the partition."""
    part, end, known = TaskContext.get().partitionId(), int(end_id).to_bytes(4, "little"), text_ids(*files)
    before, full = np.zeros(length, np.int64), 0
    names = ["_key", "_part", "_n", "_first", "_number", "_full", "_ids"]

    def batch(rows: list, keys: pa.Array) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays([keys, pa.array([part] * len(rows), pa.int32()), *columns], names=names)

    for incoming in batches:
        keys, rows, start, size = incoming.column(0), [], 0, 0
        for at, text in enumerate(incoming.column(1)):
            text = text.as_py()
            ids = (known.of_text(text) if text else b"") + end
            n = len(ids) // 4
            first = n % length
            rows.append((n, first, int(before[first]) if first else None, full, ids))
            before[first] += 1
            full += n // length
            size += len(ids)
            if size > BATCH_BYTES:
                yield batch(rows, keys.slice(start, len(rows)))
                rows, start, size = [], at + 1, 0
        if rows:
            yield batch(rows, keys.slice(start, len(rows)))


def _numbers_before(tokens: DataFrame, length: int) -> tuple[DataFrame, np.ndarray]:
    """For each partition an array by length (0: full pieces) of the pieces in earlier partitions; and all counts."""
    short = tokens.filter("_first > 0").groupBy("_part", "_first").agg(F.count("*").alias("_count"))
    full = tokens.groupBy("_part").agg(F.sum(F.floor(F.col("_n") / length)).alias("_count")).select("_part", F.lit(0).alias("_first"), "_count")
    totals = staged(short.unionByName(full), "totals")
    counts = np.zeros(length, np.int64)
    for size, count in totals.groupBy("_first").agg(F.sum("_count")).collect():  # one row a length
        counts[size] = count
    # A length's window has one row a partition.
    earlier = W.partitionBy("_first").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = totals.withColumn("_base", F.coalesce(F.sum("_count").over(earlier), F.lit(0)))
    listed = sums.groupBy(F.col("_part").alias("_of")).agg(F.map_from_entries(F.collect_list(F.struct("_first", "_base"))).alias("_bases"))
    return listed, counts


def pack(docs: DataFrame, tokenizer_json: str, ranks_file: str, length: int = 1024, end_id: int = 2,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents in few sequences of at most ``length`` ids: one row per piece.

    A document is its ids and then ``end_id``; null and empty texts are ``end_id`` alone. A document of at
    most ``length`` ids is one piece; a longer one is cut into pieces of ``length``, of which the first may
    be shorter. Returns the key, ``piece`` (from 0), ``start`` (ids of the document before it), ``length``,
    ``ids`` (little-endian 32-bit), ``sequence_id`` and ``offset``: places in a sequence are taken from 0
    without a gap. Repeated rows, equal keys and null keys are packed like any other row; other columns
    are not read; an empty table gives no piece.

    The numbers before each partition are broadcast up to ``BROADCAST_PARTITIONS`` partitions; beyond, the
    documents are joined to them by shuffling. The plan is one of lengths, so it never grows with the corpus.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"_key {kind}, _part int, _n bigint, _first int, _number bigint, _full bigint, _ids binary"
    files = (tokenizer_json, ranks_file)
    tokens = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(
        lambda batches: _tokenise(files, end_id, length, batches), schema)
    with arrow_rows(docs.sparkSession, TEXTS):
        tokens = staged(tokens, "tokens")
    before, counts = _numbers_before(tokens, length)
    plan = Plan(counts, length)
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    parts = tokens.agg(F.max("_part")).first()[0] or 0

    @F.pandas_udf("sequence bigint, offset bigint")
    def place(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for sizes, numbers in columns:
            sequence, offset = np.zeros((2, len(sizes)), np.int64)
            short = sizes.to_numpy() > 0
            sequence[short], offset[short] = shared.value.place(sizes[short].to_numpy(np.int64), numbers[short].to_numpy(np.int64))
            yield pd.DataFrame({"sequence": sequence, "offset": offset})

    based = tokens.join(F.broadcast(before) if parts < BROADCAST_PARTITIONS else before, F.col("_part") == F.col("_of"))
    base = lambda of: F.element_at("_bases", of)
    placed = based.select("_key", "_n", "_first", "_ids", (base(F.lit(0)) + F.col("_full") + plan.sequences).alias("_whole"),
                          place("_first", F.col("_number") + base(F.col("_first"))).alias("_place"))
    cut = (F.col("_first") > 0).cast("int")

    def piece(number):
        short = (number == 0) & (cut == 1)
        start = F.when(short, 0).otherwise(F.col("_first") + (number - cut) * length).cast("bigint")
        size = F.when(short, F.col("_first")).otherwise(length).cast("bigint")
        return F.struct(number.cast("int").alias("piece"), start.alias("start"), size.alias("length"),
                        F.substring(F.col("_ids"), (start * 4 + 1).cast("int"), (size * 4).cast("int")).alias("ids"),
                        F.when(short, F.col("_place.sequence")).otherwise(F.col("_whole") + number - cut).alias("sequence_id"),
                        F.when(short, F.col("_place.offset")).otherwise(0).cast("bigint").alias("offset"))

    last = F.floor((F.col("_n") - 1) / length)
    pieces = placed.select(F.col("_key").alias(key), F.transform(F.sequence(F.lit(0).cast("bigint"), last), piece).alias("_pieces"))
    return pieces.select(key, F.inline("_pieces"))
