"""Exact set-similarity join on word shingles with skipping by set relations, and the classes it makes.

Equal sets are one node. Every node is listed under the shingles of its prefix (rarest first). A first round
compares a list's members with a few elected leaders and with the nearest of their neighbours, so a group of
near copies becomes one class in time linear in its lists. A second round reads lists in blocks of neighbours
and skips pairs of blocks whose best sizes, positions and profiles cannot reach a link, or that are of one
class. The pairs left lie between classes: the overlaps of each leader are computed once and kept as a table,
and a follower's overlaps are derived from them by the few shingles in which the two differ.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from merchlake.llm.common import arrow_rows, as_row, interim, removed, staged

CACHED_WORDS = 30_000
TEXTS = 250  # texts and sets that a task holds at once
SKETCH_BITS = 22  # shingle frequencies are kept in 2^22 counters, whatever the number of shingles
SKETCH_SLICE = 2**16
LIST_BLOCK = 8192  # longer lists are dealt out in blocks
NEIGHBOURS = 64  # entries of a list, in order of size, among which the first round looks for a partner
LEADERS = 8  # leaders that a long list elects in the first round
SKIP_BLOCK = 64  # entries of a long list that the second round skips at once
BINS, FULL = 32, 255
BROADCAST_ROWS = 1_000_000  # row numbers (8 bytes each) up to which no text is shuffled to be picked
OVERLAPS = "a bigint, b bigint, n_a int, n_b int, common bigint"
# Odd 64-bit constants of the mixing steps (fixed values).
MIX = tuple(np.uint64(value) for value in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, "<u8").tobytes()


def unpacked(own: bytes) -> np.ndarray:
    return np.frombuffer(own, "<u8")


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value
        return value


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * MIX[1]
    return (values ^ (values >> np.uint64(29))) * MIX[2]


def shingle_set(text: str | None, words_each: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles: A-Z lower-cased, words between blanks.

    With fewer words than a shingle has, the whole sequence is one shingle.
    """
    if not text:
        return np.zeros(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(words_each, len(own))
    count = len(own) - size + 1
    mixed = np.full(count, size, np.uint64)
    for at in range(size):
        mixed = _mixed(mixed * MIX[0] + own[at:at + count])
    return np.unique(mixed)


def _own_sets(words_each: int):
    """Rows (row, set) of rows (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [packed(shingle_set(text.as_py(), words_each, hashes)) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sets, pa.binary())], names=["row", "set"])

    return run


def _frequencies(words_each: int):
    """Counters of a partition's shingles as rows (slice, count): all counts of a slice, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        # A task's shingles stay far below what four bytes count; more stand at the most, as in the sum.
        totals = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for text in batch.column(0):
                # A set's hashes are sorted, so equal counters are neighbours.
                own = shingle_set(text.as_py(), words_each, hashes)
                counters, counts = np.unique(own >> np.uint64(64 - SKETCH_BITS), return_counts=True)
                at = counters.astype(np.int64)
                totals[at] += np.minimum(counts, 2**32 - 1 - totals[at].astype(np.int64)).astype(np.uint32)
        hashes.clear()
        yield from _slices(totals)

    return run


def _slices(totals: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Most counts of one task are 0 to 2, which take two or three bits each when packed."""
    for number, own in enumerate(totals.reshape(-1, SKETCH_SLICE)):
        most = own.max()
        if most:
            count = zlib.compress(own.astype("<u1" if most < 2**8 else "<u2" if most < 2**16 else "<u4").tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([count], pa.binary())], names=["slice", "count"])


def _added_frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, count in zip(batch["slice"].tolist(), batch["count"]):
            own = zlib.decompress(count)
            sums.setdefault(number, np.zeros(SKETCH_SLICE, np.int64))[:] += np.frombuffer(own, f"<u{len(own) // SKETCH_SLICE}")
    rows = [(number, np.minimum(own, 2**32 - 1).astype("<u4").tobytes()) for number, own in sums.items()]
    yield pd.DataFrame(rows, columns=["slice", "count"])


def _sketch(texts: DataFrame, words_each: int) -> np.ndarray:
    """How often shingles fall on each counter, over all texts."""
    parts = texts.select("text").mapInArrow(_frequencies(words_each), "slice int, count binary")
    sums = parts.repartition((1 << SKETCH_BITS) // SKETCH_SLICE, "slice").mapInPandas(_added_frequencies, "slice int, count binary").toPandas()
    total = np.zeros((1 << SKETCH_BITS) // SKETCH_SLICE * SKETCH_SLICE, np.uint32).reshape(-1, SKETCH_SLICE)
    for number, count in zip(sums["slice"].tolist(), sums["count"]):
        total[number] = np.frombuffer(count, "<u4")
    return total.ravel()


def least_overlap(one, other, percent: int):
    """Smallest number of common shingles that links sets of these sizes."""
    return -(-(percent * (one + other)) // (100 + percent))


def _prefixes(counters, words_each: int, percent: int):
    """Rows (key, digest) of rows (key, digest, text), with the size and two sums of their set, its prefix and its profile.

    The prefix holds the rarest shingles, as many as a linked set cannot all miss; the profile counts
    shingles by bin. The overlap of two sets is at most the sum over all bins of the smaller count. A large
    set, of which a bin is full, has a profile of full bins, which rules nothing out. No set and no text is
    written: the sets of near pairs are made again from the input.
    """
    names = ["key", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_counts, hashes = counters.value, WordHashes()
        for batch in batches:
            prefixes, profiles, rows = [], [], []
            for text in batch.column(2):
                values = shingle_set(text.as_py(), words_each, hashes)
                profile = np.bincount((values >> np.uint64(8)).astype(np.int64) % BINS, minlength=BINS)
                profiles.append((profile if profile.max() < FULL else np.full(BINS, FULL)).astype(np.uint8).tobytes())
                length = len(values) - -(-percent * len(values) // 100) + 1
                counts = own_counts[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                prefixes.append(values[np.lexsort((values, counts))[:length]].view(np.int64))
                one, two = int(values.sum(dtype=np.uint64)), int(_mixed(values).sum(dtype=np.uint64))
                rows.append((len(values), one - 2**63, two - 2**63))
            starts = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))
            figures = [pa.array([row[at] for row in rows], kind) for at, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(at) for at in range(2)), *figures, lists, pa.array(profiles, pa.binary())],
                                             names=[*names, "n", "s1", "s2", "prefix", "profile"])
        hashes.clear()

    return run


def _possible(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Largest overlap that two profiles allow."""
    most = np.minimum(one, other).sum(axis=1, dtype=np.int64)
    return np.where((one[:, 0] == FULL) | (other[:, 0] == FULL), np.iinfo(np.int64).max // 4, most)


class Lists:
    """Entries of one or more lists, sorted by (token, block pair, size, position), as arrays."""

    heads = ("token", "one", "two")
    names = (*heads, "block", "n", "place", "node", "kind", "profile")

    def __init__(self, rows: dict[str, np.ndarray], percent: int):
        self.rows, self.percent = rows, percent
        self.size, self.kind, self.profile, self.block = (rows[name] for name in ("n", "kind", "profile", "block"))
        self.left = rows["n"] - rows["place"]  # shingles from the shared one on, itself included
        self.crossing = rows["one"] != rows["two"]

    def starts(self) -> np.ndarray:
        changed = np.zeros(len(self.size), bool)
        changed[0] = True
        for name in self.heads:
            changed[1:] |= self.rows[name][1:] != self.rows[name][:-1]
        return np.flatnonzero(changed)

    def possible(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those pairs of entries that sizes, positions, classes and profiles allow, with their largest overlap."""
        small, large = np.minimum(self.size[a], self.size[b]), np.maximum(self.size[a], self.size[b])
        needed = least_overlap(small, large, self.percent)
        good = (100 * small >= self.percent * large) & (np.minimum(self.left[a], self.left[b]) >= needed) & (self.kind[a] != self.kind[b])
        good &= ~self.crossing[a] | (self.block[a] != self.block[b])
        a, b, needed = a[good], b[good], needed[good]
        most = _possible(self.profile[a], self.profile[b])
        good = most >= needed
        return a[good], b[good], most[good]

    def neighbours(self, starts: np.ndarray, window: int, nearest: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """Possible pairs at most ``window`` entries apart; ``nearest``: of each entry the most similar by its bounds."""
        count = len(self.size)
        ends = np.append(starts[1:], count)
        last = np.repeat(ends, ends - starts)
        found, closest, partner = [], np.full(count, -1.0), np.full(count, -1)
        alive = np.arange(count)
        for step in range(1, window + 1):
            alive = alive[alive + step < last[alive]]
            # Sizes rise, so an entry whose partner is too large skips the rest of its list.
            alive = alive[100 * self.size[alive] >= self.percent * self.size[alive + step]]
            if not len(alive):
                break
            a, b, most = self.possible(alive, alive + step)
            if nearest:
                share = np.minimum(most, self.size[a]) / (self.size[a] + self.size[b])
                for mine, other in ((a, b), (b, a)):
                    better = share > closest[mine]
                    closest[mine[better]], partner[mine[better]] = share[better], other[better]
            else:
                found.append((a, b))
        if nearest:
            mine = np.flatnonzero(partner >= 0)
            found.append((mine, partner[mine]))
        return found

    def led(self, start: int, end: int, leaders: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Possible pairs of a long list's leaders and the entries that no earlier leader may be linked with.

        A leader is the entry whose profile is nearest to the mean of those that are left.
        """
        found, rest = [], np.arange(start, end)
        for _ in range(leaders):
            if len(rest) < 2:
                break
            centre = self.profile[rest].mean(axis=0, dtype=np.float32)
            common = np.minimum(self.profile[rest], centre).sum(axis=1)
            leader = rest[np.argmax(common / (self.profile[rest].sum(axis=1, dtype=np.int64) + centre.sum() - common))]
            rest = rest[rest != leader]
            a, _, _ = self.possible(rest, np.full(len(rest), leader))
            found.append((a, np.full(len(a), leader)))
            rest = np.setdiff1d(rest, a, assume_unique=True)
        return found

    def skipping(self, start: int, end: int, each: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """All possible pairs of a long list, whose entries are read in blocks.

        Classes of a block's length and more lie together, all else in order of size and position. A pair of
        blocks is skipped if its best sizes, positions and profiles leave no link, or both are of one class.
        """
        kind = self.kind[start:end]
        _, which, counts = np.unique(kind, return_inverse=True, return_counts=True)
        group = np.where(counts[which] >= each, which + 1, 0)
        order = start + np.lexsort((self.left[start:end], self.size[start:end], group))
        cuts = np.arange(0, len(order), each)
        low, high = (pick.reduceat(self.size[order], cuts) for pick in (np.minimum, np.maximum))
        left = np.maximum.reduceat(self.left[order], cuts)
        most = np.maximum.reduceat(self.profile[order], cuts, axis=0)
        full = np.maximum.reduceat((self.profile[order, 0] == FULL).astype(np.int8), cuts) > 0
        least_kind, largest_kind = (pick.reduceat(self.kind[order], cuts) for pick in (np.minimum, np.maximum))
        one_class = least_kind == largest_kind
        found = []
        for at in range(len(cuts)):
            others = np.arange(at, len(cuts))
            if one_class[at]:
                others = others[~(one_class[others] & (least_kind[others] == least_kind[at]))]
            needed = least_overlap(low[at], low[others], self.percent)
            good = (100 * high[at] >= self.percent * low[others]) & (100 * high[others] >= self.percent * low[at])
            good &= np.minimum(left[at], left[others]) >= needed
            others, needed = others[good], needed[good]
            good = (np.minimum(most[at], most[others]).sum(axis=1, dtype=np.int64) >= needed) | full[at] | full[others]
            own = order[cuts[at]:cuts[at] + each]
            for other in others[good]:
                second = order[cuts[other]:cuts[other] + each]
                a, b = np.repeat(own, len(second)), np.tile(second, len(own))
                if other == at:
                    a, b = a[a < b], b[a < b]
                a, b, _ = self.possible(a, b)
                if len(a):
                    found.append((a, b))
        return found


def _mixed_lists(rows: dict[str, np.ndarray], percent: int) -> dict[str, np.ndarray]:
    """The entries of lists whose members are not all of one class."""
    lists = Lists(rows, percent)
    starts = lists.starts()
    mixed = np.minimum.reduceat(lists.kind, starts) != np.maximum.reduceat(lists.kind, starts)
    kept = np.repeat(mixed, np.diff(np.append(starts, len(lists.kind))))
    return {name: values[kept] for name, values in rows.items()}


def _list_pairs(percent: int, nearest: bool, window: int, leaders: int, each: int):
    """Pairs of nodes of different classes that a list allows.

    ``nearest`` (first round): every entry's nearest neighbour and its list's leaders; else all that are possible.
    """

    def of_lists(rows: dict[str, np.ndarray]) -> pd.DataFrame:
        if not nearest:
            rows = _mixed_lists(rows, percent)
            if not len(rows["n"]):
                return pd.DataFrame(np.zeros((0, 2), np.int64), columns=["a", "b"])
        lists = Lists(rows, percent)
        starts = lists.starts()
        ends = np.append(starts[1:], len(lists.size))
        long = ends - starts > window
        if nearest:
            found = lists.neighbours(starts, window, True)
            for start, end in zip(starts[long].tolist(), ends[long].tolist()):
                found += lists.led(start, end, leaders)
        else:
            found = []
            short = np.repeat(~long, ends - starts)
            if short.any():
                own = Lists({name: values[short] for name, values in rows.items()}, percent)
                place = np.flatnonzero(short)
                found += [(place[a], place[b]) for a, b in own.neighbours(own.starts(), window, False)]
            for start, end in zip(starts[long].tolist(), ends[long].tolist()):
                found += lists.skipping(start, end, each)
        node = rows["node"]
        a, b = (np.concatenate([node[pair[side]] for pair in found]) if found else np.zeros(0, np.int64) for side in (0, 1))
        pairs = np.unique(np.sort(np.stack((a, b), axis=1), axis=1), axis=0)
        return pd.DataFrame(pairs, columns=["a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, held = Lists.names, None
        for batch in batches:
            if not len(batch):
                continue
            own = {name: batch[name].to_numpy() for name in names[:-1]}
            own["n"], own["place"] = own["n"].astype(np.int64), own["place"].astype(np.int64)
            own["profile"] = np.frombuffer(b"".join(batch["profile"]), np.uint8).reshape(-1, BINS)
            if held is not None:
                own = {name: np.concatenate((held[name], own[name])) for name in names}
            # The last list may go on in the next batch; a block pair holds a bounded number of rows.
            same = np.ones(len(own["n"]), bool)
            for name in Lists.heads:
                same &= own[name] == own[name][-1]
            cut = len(same) - int(same[::-1].cumprod().sum())
            if cut:
                yield of_lists({name: values[:cut] for name, values in own.items()})
            held = {name: values[cut:] for name, values in own.items()}
        if held is not None and len(held["n"]):
            yield of_lists(held)

    return run


def _paired(rows: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Distinct pairs of nodes from entries that are dealt to block pairs (one, two)."""
    rows = rows.select("token", "one", "two", "block", "n", "place", "node", "kind", "profile")
    rows = rows.repartition("token", "one", "two").sortWithinPartitions("token", "one", "two", "n", "place", "node")
    return rows.mapInPandas(_list_pairs(percent, nearest, NEIGHBOURS, LEADERS, SKIP_BLOCK), "a bigint, b bigint").distinct()


def _near_members(shared: DataFrame, percent: int) -> DataFrame:
    """First round: pairs in proportion to the lists. A long list's blocks differ from shingle to shingle."""
    block = F.pmod(F.xxhash64("node", "token"), F.ceil(F.col("listed") / LIST_BLOCK)).cast("int")
    rows = shared.withColumn("block", block)
    return _paired(rows.withColumns({"one": F.col("block"), "two": F.col("block"), "kind": F.col("node")}), percent, True)


def _near_classes(placed: DataFrame, percent: int) -> DataFrame:
    """Second round: every possible pair of different classes.

    Lists of more than ``LIST_BLOCK`` entries are dealt out in blocks that meet in pairs. A class that has so many
    entries in a list has blocks of its own there, which do not meet each other: a list of one great class
    and a few other nodes costs no more than its length.
    """
    short = placed.filter(F.col("listed") <= LIST_BLOCK).withColumns({name: F.lit(0) for name in ("block", "one", "two")})
    hot = placed.filter(F.col("listed") > LIST_BLOCK)
    great = hot.groupBy("token", "kind").agg(F.count("*").alias("_count")).filter(F.col("_count") >= LIST_BLOCK)
    great = great.withColumn("_own", F.ceil(F.col("_count") / LIST_BLOCK).cast("int"))
    # At most one row for each LIST_BLOCK entries of a list, so this window is short.
    of_list = W.partitionBy("token")
    great = great.withColumns({"_end": F.sum("_own").over(of_list.orderBy("kind")), "_blocks": F.sum("_own").over(of_list),
                               "_in_great": F.sum("_count").over(of_list)})
    lists = great.select("token", "_blocks", "_in_great").distinct()
    dealt = hot.join(lists, "token", "left").join(great.select("token", "kind", "_own", "_end"), ["token", "kind"], "left")
    rest = F.ceil((F.col("listed") - F.coalesce("_in_great", F.lit(0))) / LIST_BLOCK).cast("int")
    dealt = dealt.withColumns({"_rest": rest, "_first": (F.col("_end") - F.col("_own")).cast("int")})
    dealt = dealt.withColumn("_total", (F.col("_rest") + F.coalesce("_blocks", F.lit(0))).cast("int"))
    spread = F.xxhash64("node")
    block = F.when(F.col("_own").isNull(), F.pmod(spread, F.col("_rest"))).otherwise(F.col("_rest") + F.col("_first") + F.pmod(spread, F.col("_own")))
    dealt = dealt.withColumn("block", block.cast("int"))

    def meets(other):
        own = (other >= F.col("_rest") + F.col("_first")) & (other < F.col("_rest") + F.col("_first") + F.col("_own"))
        return F.col("_own").isNull() | ~own

    dealt = dealt.withColumn("_other", F.explode(F.filter(F.sequence(F.lit(0), F.col("_total") - 1), meets)))
    dealt = dealt.withColumns({"one": F.least("block", "_other"), "two": F.greatest("block", "_other")})
    return _paired(short.unionByName(dealt.select(*short.columns)), percent, False)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["a", "b", "n_a", "n_b"]
    for batch in batches:
        common = [len(np.intersect1d(unpacked(x.as_buffer()), unpacked(y.as_buffer()), assume_unique=True))
                  for x, y in zip(batch.column("set_a"), batch.column("set_b"))]
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(common, pa.int64())], names=[*names, "common"])


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a follower (a) lacks of its leader (b) and what it has beyond it."""
    for batch in batches:
        pairs = [(unpacked(x.as_buffer()), unpacked(y.as_buffer())) for x, y in zip(batch.column("set_a"), batch.column("set_b"))]
        lacks = [packed(np.setdiff1d(leader, own, assume_unique=True)) for own, leader in pairs]
        extra = [packed(np.setdiff1d(own, leader, assume_unique=True)) for own, leader in pairs]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(lacks, pa.binary()), pa.array(extra, pa.binary())],
                                         names=["node", "leader", "lacks", "extra"])


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A follower's overlap with another set: its leader's, less what it lacks, and what it has beyond."""
    names = ["a", "b", "n_a", "n_b"]

    def within(few: np.ndarray, own: np.ndarray) -> int:
        return int((own[np.minimum(np.searchsorted(own, few), len(own) - 1)] == few).sum()) if len(few) else 0

    for batch in batches:
        common = []
        for known, lacks, extra, other in zip(*(batch.column(name) for name in ("common", "lacks", "extra", "set"))):
            own = unpacked(other.as_buffer())
            common.append(known.as_py() - within(unpacked(lacks.as_buffer()), own) + within(unpacked(extra.as_buffer()), own))
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(common, pa.int64())], names=[*names, "common"])


class Join:
    """One join: rows and nodes written to the shared folder, and the steps on pairs of nodes.

    Texts are read again from ``docs``, which must give the same rows each time.
    """

    def __init__(self, docs: DataFrame, words_each: int, percent: int, key: str, text: str):
        self.words_each, self.percent = words_each, percent
        kind = docs.schema[key].dataType.simpleString()
        texts = docs.select(F.col(key).alias("key"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("digest"), F.col(text).alias("text"))
        # A row is found again by its text's digest and its key's hash; of rows equal in both any one will do.
        self.texts = texts.select("digest", F.xxhash64("key").alias("mark"), "text")
        with arrow_rows(docs.sparkSession, TEXTS):
            counters = docs.sparkSession.sparkContext.broadcast(_sketch(texts, words_each))
            rows = texts.mapInArrow(_prefixes(counters, words_each, percent),
                                    f"key {kind}, digest binary, n int, s1 bigint, s2 bigint, prefix array<bigint>, profile binary")
            # The numbers of rows and nodes hold because the tables are written before they are used.
            self.rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        counters.destroy()
        # A node is the first row of its set and has that row's number. Prefixes and profiles stay in the rows.
        filled = self.rows.filter("n > 0")
        nodes = filled.groupBy("s1", "s2", "n").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
        nodes = staged(nodes.withColumn("node", F.col("row")), "nodes")
        self.nodes = nodes.drop("copies")
        # Rows of the sets that occur more than once, but for the first of each.
        firsts = nodes.filter("copies > 1").select("s1", "s2", "n", "node")
        twice = filled.select("s1", "s2", "n", "row").join(firsts, ["s1", "s2", "n"])
        self.copies = staged(twice.filter("row <> node").select("row"), "copies")

    def shared_lists(self) -> DataFrame:
        """Prefix entries of shingles that at least two nodes list, with the length of the list.

        All entries are shuffled once; only the shared ones, which are few, meet their nodes' profiles.
        """
        copies = F.broadcast(self.copies) if self.copies.count() <= BROADCAST_ROWS else self.copies
        firsts = self.rows.filter("n > 0").select("row", "prefix").join(copies, "row", "left_anti")
        entries = firsts.select(F.col("row").alias("node"), F.posexplode("prefix").alias("place", "token"))
        listed = F.count("*").over(W.partitionBy("token")).cast("int")
        kept = staged(entries.withColumn("listed", listed).filter("listed > 1"), "entries")
        rows = kept.join(self.rows.select(F.col("row").alias("node"), "n", "profile"), "node")
        lists = staged(rows.select("token", "node", "n", "place", "listed", "profile"), "lists")
        removed(kept)
        return lists

    def without_prefixes(self) -> None:
        """Rows are written again without what only the lists need, which is most of them."""
        rows = staged(self.rows.drop("prefix", "profile"), "marked")
        removed(self.rows)
        self.rows = rows

    def sized(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with the sizes and row numbers of their sets."""
        for name in ("a", "b"):
            side = self.nodes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("row").alias(f"row_{name}"))
            pairs = pairs.join(side, name)
        return pairs

    def sets(self, pairs: DataFrame) -> DataFrame:
        """(row, set) of the rows that sized pairs name, made from their texts.

        Up to ``BROADCAST_ROWS`` row numbers and digests are broadcast; beyond, rows and texts are joined by shuffling both.
        """
        asked = staged(pairs.select(F.col("row_a").alias("row")).union(pairs.select("row_b")).distinct(), "asked")
        count = asked.count()
        few = F.broadcast if count <= BROADCAST_ROWS else lambda rows: rows
        marked = self.rows.select("row", "digest", F.xxhash64("key").alias("mark")).join(few(asked), "row", "left_semi")
        texts = self.texts.join(few(staged(marked, "marks")), ["digest", "mark"]).select("row", "text")
        with arrow_rows(pairs.sparkSession, TEXTS):
            sets = staged(texts.mapInArrow(_own_sets(self.words_each), "row bigint, set binary"), "sets")
        found = sets.count()
        if found > count:
            # Repeated rows, of one key and text, each gave their set.
            every, sets = sets, staged(sets.dropDuplicates(["row"]), "sets")
            removed(every)
            found = sets.count()
        if found < count:
            raise RuntimeError(f"the documents gave other rows when they were read again: {count - found} texts are missing")
        return sets

    def side(self, near: DataFrame, sets: DataFrame, name: str, small: bool) -> DataFrame:
        """Pairs with one side's set; up to ``BROADCAST_ROWS`` pairs (ids and sizes only) the sets stay where they are."""
        near = F.broadcast(near) if small else near
        return sets.select(F.col("row").alias(f"row_{name}"), F.col("set").alias(f"set_{name}")).join(near, f"row_{name}").drop(f"row_{name}")

    def compared(self, near: DataFrame, sets: DataFrame, run, schema: str, purpose: str) -> DataFrame:
        """A written table of what a comparison of both sets gives, a few pairs at a time: each pair's two sets are shuffled once."""
        near = staged(near, "compared")
        small = near.count() <= BROADCAST_ROWS
        both = self.side(near.select("a", "b", "n_a", "n_b", "row_a"), sets, "a", small).join(
            self.side(near.select("a", "b", "row_b"), sets, "b", small), ["a", "b"])
        with arrow_rows(near.sparkSession, TEXTS):
            return staged(both.mapInArrow(run, schema), purpose)

    def overlaps(self, near: DataFrame, sets: DataFrame) -> DataFrame:
        """Exact overlaps: (a, b, n_a, n_b, common)."""
        return self.compared(near, sets, _overlaps, OVERLAPS, "overlaps")

    def differences(self, led: DataFrame, sets: DataFrame) -> DataFrame:
        """(node, leader, lacks, extra) of pairs (follower a, leader b)."""
        return self.compared(led, sets, _differences, "node bigint, leader bigint, lacks binary, extra binary", "differences")

    def derived(self, near: DataFrame, sets: DataFrame, differences: DataFrame) -> DataFrame:
        """Overlaps of followers ``a`` with ``b`` from their leaders' (``common``): only b's set is read."""
        near = staged(near.select("a", "b", "n_a", "n_b", "row_b", "common"), "open")
        rows = self.side(near, sets, "b", near.count() <= BROADCAST_ROWS).withColumnRenamed("set_b", "set")
        rows = rows.join(differences.select(F.col("node").alias("a"), "lacks", "extra"), "a")
        with arrow_rows(near.sparkSession, TEXTS):
            return staged(rows.mapInArrow(_derived, OVERLAPS), "derived")

    def linked(self, overlaps: DataFrame) -> DataFrame:
        return overlaps.filter(100 * F.col("common") >= self.percent * (F.col("n_a") + F.col("n_b") - F.col("common")))


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable node of every linked node: (node, root), by alternating large and small stars.

    Each step keeps the components and hangs nodes nearer to their smallest one; no step holds a
    neighbourhood in one value. It ends when every link leads to a root.
    """
    edges = links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).filter("high <> low").distinct()
    while True:
        both = edges.union(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
        best = both.groupBy("high").agg(F.min("low").alias("least"))
        best = best.select(F.col("high").alias("_of"), F.least("high", "least").alias("least"))
        # Large star: larger neighbours hang below the smallest of the neighbourhood.
        large = both.filter("low > high").join(best, F.col("high") == F.col("_of")).select(F.col("low").alias("high"), F.col("least").alias("low"))
        large = staged(large.distinct(), "stars")
        # Small star: smaller neighbours hang below the smallest one, and so does the node itself.
        least = large.groupBy("high").agg(F.min("low").alias("least"), F.count("*").alias("links"))
        small = large.join(least.withColumnRenamed("high", "_of"), F.col("high") == F.col("_of"))
        small = small.select(F.when(F.col("low") == F.col("least"), F.col("high")).otherwise(F.col("low")).alias("high"),
                             F.col("least").alias("low")).distinct()
        edges = staged(small, "stars")
        # Done when no node has two parents and no parent has a parent.
        twice = edges.groupBy("high").agg(F.count("*").alias("c")).filter("c > 1").select("high")
        chained = edges.select("high").join(edges.select(F.col("low").alias("_p")), F.col("high") == F.col("_p"), "left_semi")
        if twice.union(chained).isEmpty():
            return edges.select(F.col("high").alias("node"), F.col("low").alias("root"))


def _members(docs: DataFrame, words_each: int, percent: int, key: str, text: str) -> DataFrame:
    """Class of every row: (key, digest of the text, n, class); the class of a row without shingles is null."""
    with interim(docs.sparkSession):
        join = Join(docs, words_each, percent, key, text)
        shared = join.shared_lists()
        join.without_prefixes()
        near = staged(join.sized(_near_members(shared, percent)), "near")
        sets = join.sets(near)
        first = join.linked(join.overlaps(near, sets))
        # Each round's sets are the largest table that it writes.
        removed(sets)
        roots = staged(components(first), "roots")

        # Lists whose members are all of one class give nothing in the second round.
        placed = shared.join(roots, "node", "left").withColumn("kind", F.coalesce("root", "node")).drop("root")
        near = staged(join.sized(_near_classes(placed, percent)), "between")
        removed(shared)
        second = _between_classes(join, near, first)

        found = components(first.select("a", "b").union(second.select("a", "b")))
        # Only linked nodes, roots included, are joined back; any other class is named by the sums of its set.
        found = found.union(found.select(F.col("root").alias("node"), "root").distinct())
        linked = join.nodes.select("node", F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), F.col("n").alias("_n")).join(found, "node")
        same = (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")) & (F.col("n") == F.col("_n"))
        rows = join.rows.select("key", "digest", "n", "s1", "s2")
        placed = rows.filter("n > 0").join(linked, same, "left")
        own = [F.when(F.col("root").isNull(), F.col(name)).otherwise(0).cast("bigint").alias(name) for name in ("n", "s1", "s2")]
        filled = placed.select("key", "digest", "n", F.struct(F.coalesce("root", F.lit(-1).cast("bigint")).alias("root"), *own).alias("_class"))
        empty = rows.filter("n = 0").select("key", "digest", "n", F.lit(None).cast(filled.schema["_class"].dataType).alias("_class"))
        return staged(filled.union(empty), "members", keep=True)


def classes(docs: DataFrame, words_each: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Class of every row: ``key``, ``n_shingles`` and ``component_id``, the smallest key reachable by links.

    Two rows link when 100 * overlap >= percent * union of their shingle sets. Null and empty texts, and
    texts of blanks, have no shingles and link with nothing: their class is their own key. Equal texts,
    repeated rows and rows with equal keys are linked like any others; a null key never names a class
    unless no row of the class has a key. Other columns are not read, and an empty table gives no row.
    """
    members = _members(docs, words_each, percent, key, text)
    filled = members.filter("_class is not null")
    names = filled.groupBy("_class").agg(F.min("key").alias("_name"))
    named = filled.join(names, "_class").select("key", "n", "_name")
    empty = members.filter("_class is null").select("key", "n", F.col("key").alias("_name"))
    return named.union(empty).select(F.col("key").alias(key), F.col("n").cast("bigint").alias("n_shingles"), F.col("_name").alias("component_id"))


def one_of_each(docs: DataFrame, words_each: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with all its columns: the one with the smallest key, then text digest.

    A null key comes last, and of repeated rows one stays. Rows without shingles are in no class and all stay.
    """
    members = _members(docs, words_each, percent, key, text).filter("_class is not null")
    rank = F.struct(F.col("key").isNull(), F.col("key"), F.col("digest"))
    chosen = members.groupBy("_class").agg(F.min_by(F.struct("key", "digest"), rank).alias("_row")).select("_row.*")
    chosen = chosen.select(F.col("key").alias("_key"), F.col("digest").alias("_digest"))
    rows = docs.select(as_row(docs), F.col(key).alias("_id"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("_own"),
                       (F.coalesce(F.trim(F.translate(F.col(text), "\t\n\u000b\f\r", "     ")), F.lit("")) != "").alias("_filled"))
    kept = rows.filter("_filled").join(chosen, F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_digest")), "left_semi")
    # Copies of the chosen row itself, equal in key and text, are numbered where the join has put them.
    once = kept.withColumn("_times", F.row_number().over(W.partitionBy("_id", "_own").orderBy("_id"))).filter("_times = 1")
    return once.select("_row.*").union(rows.filter("not _filled").select("_row.*"))


def _leaders(links: DataFrame) -> DataFrame:
    """(node, leader): the neighbour with the most links, more than the node's own, the smallest of equal ones."""
    both = links.select("a", "b").union(links.select("b", "a"))
    degrees = both.groupBy("a").agg(F.count("*").alias("links"))
    other = degrees.select(F.col("a").alias("b"), F.col("links").alias("other_links"))
    rows = both.join(degrees, "a").join(other, "b")
    more = (F.col("other_links") > F.col("links")) | ((F.col("other_links") == F.col("links")) & (F.col("b") < F.col("a")))
    best = F.min_by("b", F.struct(-F.col("other_links"), F.col("b"))).alias("leader")
    return rows.filter(more).groupBy(F.col("a").alias("node")).agg(best)


def _between_classes(join: Join, near: DataFrame, first: DataFrame) -> DataFrame:
    """Links among near pairs of different classes.

    Pairs of a follower become pairs of its leader, whose overlaps are computed once for all followers. A
    follower's overlap is at most its leader's and all that it has beyond it; where this leaves a link
    possible, the exact one is derived from the difference of the two.
    """
    of_a = _leaders(first)
    led = near.join(of_a.withColumnsRenamed({"node": "a", "leader": "la"}), "a", "left")
    led = led.join(of_a.withColumnsRenamed({"node": "b", "leader": "lb"}), "b", "left")
    # The follower comes first in its pair; of two followers the one with the larger set.
    turn = F.col("la").isNull() | (F.col("lb").isNotNull() & (F.col("n_b") > F.col("n_a")))
    columns = [F.when(turn, F.col(one)).otherwise(F.col(other)).alias(name)
               for name, one, other in (("a", "b", "a"), ("b", "a", "b"), ("n_a", "n_b", "n_a"), ("n_b", "n_a", "n_b"),
                                        ("row_a", "row_b", "row_a"), ("row_b", "row_a", "row_b"), ("leader", "lb", "la"))]
    led = staged(led.select(*columns), "led")
    leaders = staged(join.sized(led.filter("leader is not null").select("a", F.col("leader").alias("b")).distinct()), "leaders")
    sets = join.sets(near.select("row_a", "row_b").union(leaders.select("row_a", "row_b")))
    plain = join.linked(join.overlaps(led.filter("leader is null").drop("leader"), sets))

    led = led.filter("leader is not null")
    differences = join.differences(leaders, sets)
    asked = led.select(F.col("leader").alias("a"), "b").distinct()
    answers = join.overlaps(join.sized(asked), sets).select(F.col("a").alias("leader"), "b", "common")
    beyond = differences.select(F.col("node").alias("a"), (F.length("extra") / 8).cast("int").alias("beyond"))
    bounds = led.join(answers, ["leader", "b"]).join(beyond, "a")
    left_open = bounds.filter(F.col("common") + F.col("beyond") >= least_overlap_of(join.percent))
    derived = join.derived(left_open.select(*near.columns, "common"), sets, differences)
    removed(sets, differences)
    return plain.unionByName(join.linked(derived))


def least_overlap_of(percent: int):
    """:func:`least_overlap` of columns n_a and n_b."""
    return F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))
