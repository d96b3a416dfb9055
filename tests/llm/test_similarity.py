import collections
import os
import random
import re
import urllib.parse

import numpy as np
import pytest
from helpers import no_docs, odd_docs, odd_rows, plain_docs, words

from merchlake.llm import similarity, topk

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(own[at:at + size]) for at in range(max(1, len(own) - size + 1))) if own else frozenset()


def by_brute_force(rows, size, percent):
    sets = [shingles(text, size) for _, text in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    names = collections.defaultdict(list)
    for at, (key, _) in enumerate(rows):
        names[root(at)].append(key)
    smallest = {at: min((key for key in keys if key is not None), default=None) for at, keys in names.items()}
    return sorted(((key, len(sets[at]), smallest[root(at)]) for at, (key, _) in enumerate(rows)), key=repr)


def classes(docs, size, percent):
    return sorted(((row.doc_id, row.n_shingles, row.component_id) for row in similarity.classes(docs, size, percent).collect()), key=repr)


def test_odd_rows(spark):
    rows = [(row[0], row[1]) for row in odd_rows()]
    assert classes(odd_docs(spark), 5, 80) == by_brute_force(rows, 5, 80)
    assert classes(no_docs(spark), 5, 80) == []


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80), (1, 50)])
def test_chains_of_near_copies(spark, size, percent):
    dice, texts = random.Random(size), {}
    for family in range(6):
        own = words(family, 90)
        for copy in range(25):
            # Each copy changes the one before it, so a family is a chain and not a clique.
            if copy:
                own = own[:]
                own[dice.randrange(len(own))] = f"new{family}x{copy}"
                if dice.random() < 0.3:
                    own.append(f"tail{copy}")
            texts[1000 * family + copy] = " ".join(own)
    assert classes(plain_docs(spark, texts), size, percent) == by_brute_force(list(texts.items()), size, percent)


@pytest.mark.parametrize("block, window, leaders, each", [(4, 64, 8, 64), (4, 2, 1, 3), (7, 1, 0, 2), (8192, 3, 2, 4)])
def test_long_lists(spark, monkeypatch, block, window, leaders, each):
    """Blocks, great classes, elected leaders and skipped blocks change no class."""
    for name, value in (("LIST_BLOCK", block), ("NEIGHBOURS", window), ("LEADERS", leaders), ("SKIP_BLOCK", each)):
        monkeypatch.setattr(similarity, name, value)
    dice, texts = random.Random(block), {}
    for at in range(60):
        own = [*words(7, 60)[: 50 + at % 5], f"end{at}"]
        if at % 3 == 0:
            own[dice.randrange(50)] = f"other{at}"
        if at % 4 == 0:
            own[:3] = ["far", "from", f"all{at % 8}"]
        texts[at] = " ".join(own)
    assert classes(plain_docs(spark, texts), 3, 90) == by_brute_force(list(texts.items()), 3, 90)


def test_skipped_blocks_hold_no_pair():
    dice = np.random.default_rng(3)
    count, percent = 500, 80
    size = np.sort(dice.integers(20, 60, count))
    profile = dice.multinomial(40, np.ones(similarity.BINS) / similarity.BINS, count).astype(np.uint8)
    profile[:, :8] += (3 * dice.integers(0, 2, (count, 1))).astype(np.uint8)
    profile[5] = similarity.FULL
    rows = {"n": size, "place": dice.integers(0, 12, count), "kind": dice.integers(0, 9, count), "block": dice.integers(0, 2, count), "profile": profile,
            "one": np.zeros(count, int), "two": np.ones(count, int), "token": np.zeros(count, int), "node": np.arange(count)}
    lists = similarity.Lists(rows, percent)
    a, b = np.triu_indices(count, 1)
    want = {tuple(pair) for pair in np.stack(lists.possible(a, b)[:2], axis=1).tolist()}
    for each in (1, 7, 64):
        got = [tuple(sorted(pair)) for x, y in lists.skipping(0, count, each) for pair in zip(x.tolist(), y.tolist())]
        assert set(got) == want and len(got) == len(want) > 0


def test_derived_overlaps(spark):
    """A follower's overlap, from its leader's and their difference, is the exact one."""
    rows = [(f"d{at}", " ".join([*words(at // 6, 40), f"own{at % 6}"][at % 3:])) for at in range(18)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    join = similarity.Join(docs, 2, 50, "doc_id", "text")
    nodes = [row.node for row in join.nodes.select("node").orderBy("n", "node").collect()]
    leader = {node: nodes[0] for node in nodes[1:]}
    led = spark.createDataFrame(list(leader.items()), "a bigint, b bigint")
    sets = join.sets(join.sized(led))
    differences = join.differences(join.sized(led), sets)
    pairs = spark.createDataFrame([(a, b) for a in leader for b in leader if a != b], "a bigint, b bigint")
    exact = join.overlaps(join.sized(pairs), sets).select("a", "b", "common")
    answers = join.overlaps(join.sized(led), sets).select("a", "common").union(join.sized(led).limit(1).selectExpr("b", "n_b")).collect()
    answers = spark.createDataFrame([(row.a, row.common) for row in answers], "b bigint, common bigint")
    got = join.derived(join.sized(pairs).join(answers, "b"), sets, differences).select("a", "b", "common")
    assert sorted(got.collect()) == sorted(exact.collect())


def test_counters_of_a_task_are_packed():
    """Counts as a task of 16 MB has them take under three bits each, and any counts add up again."""
    dice = np.random.default_rng(3)
    totals = dice.poisson(0.75, 1 << similarity.SKETCH_BITS).astype(np.uint32)
    rows = [batch.to_pandas() for batch in similarity._slices(totals)]
    assert sum(len(value) for row in rows for value in row["count"]) < 3 * len(totals) / 8
    for most in (2**8 - 1, 2**16 - 1, 2**32 - 1):
        one, other = np.zeros(len(totals), np.uint32), totals.copy()
        one[5], one[similarity.SKETCH_SLICE * 7], other[5] = most, 3, 2
        rows = [batch.to_pandas() for own in (one, other) for batch in similarity._slices(own)]
        added = next(similarity._added_frequencies(iter(rows)))
        sums = {number: np.frombuffer(count, "<u4") for number, count in zip(added["slice"], added["count"])}
        assert sums[0][5] == min(most + 2, 2**32 - 1) and sums[0][6] == totals[6]
        assert sums[7][0] == 3 + int(totals[similarity.SKETCH_SLICE * 7])


def test_prefixes_are_written_once(spark):
    """Nodes and copies are numbers of rows; a prefix lies with its row alone, and a copy lists nothing."""
    texts = {0: "a b c d e f", 1: "a b c d e f", 2: "a b c d e g", 3: "A B c d e f", 4: "", 5: "x y z"}
    join = similarity.Join(plain_docs(spark, texts), 2, 50, "doc_id", "text")
    keys = {row.row: row.key for row in join.rows.select("row", "key").collect()}
    assert not {"prefix", "profile"} & set(join.nodes.columns)
    nodes, copies = ({keys[row[0]] for row in table.select("row").collect()} for table in (join.nodes, join.copies))
    assert len(nodes & {0, 1, 3}) == 1 and nodes | copies == {0, 1, 2, 3, 5} and not nodes & copies
    assert {keys[row.node] for row in join.shared_lists().select("node").collect()} <= nodes


def test_lists_of_one_class_are_left_out():
    rows = {name: np.zeros(6, np.int64) for name in similarity.Lists.names}
    rows["token"], rows["kind"] = np.array([1, 1, 2, 2, 3, 3]), np.array([7, 7, 7, 8, 9, 9])
    assert similarity._mixed_lists(rows, 90)["token"].tolist() == [2, 2]


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BROADCAST_ROWS", 0)
    texts = {at: " ".join([*words(at // 4, 60), f"end{at}"]) for at in range(24)}
    assert classes(plain_docs(spark, texts), 3, 90) == by_brute_force(list(texts.items()), 3, 90)


def test_no_text_is_written_and_sets_go_with_their_round(spark, monkeypatch):
    """Of the texts only the sets of one round's near pairs lie in the work folder; prefixes lie there for the lists alone."""
    written, plain = [], similarity.staged

    def watched(df, purpose, keep=False):
        held = {name for name, table in written if os.path.exists(urllib.parse.urlparse(table.inputFiles()[0]).path)}
        table = plain(df, purpose, keep)
        assert "text" not in table.columns
        assert not held & ({"sets", "rows", "entries"} if purpose == "between" else {"rows", "entries"} if purpose == "near" else set()), (purpose, held)
        written.append((purpose, table))
        return table

    monkeypatch.setattr(similarity, "staged", watched)
    texts = {at: " ".join([*words(at // 4, 60), f"end{at}"]) for at in range(24)}
    assert classes(plain_docs(spark, texts), 3, 90) == by_brute_force(list(texts.items()), 3, 90)
    assert {"rows", "entries", "near", "sets", "between"} <= {name for name, _ in written}


@pytest.mark.parametrize("broadcast", [0, similarity.BROADCAST_ROWS])
def test_repeated_rows_have_near_copies(spark, monkeypatch, broadcast):
    """Rows of one key and text, or of no key, are told apart by nothing: a set is still made once for a node."""
    monkeypatch.setattr(similarity, "BROADCAST_ROWS", broadcast)
    rows = [(key, " ".join([*words(5, 60), end])) for key, end in [(4, "a"), (4, "a"), (4, "a"), (None, "b"), (None, "b"), (2, "c"), (9, "a"), (4, "d")]]
    rows += [(None, " ".join([*words(6, 60), end])) for end in "xxy"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    join = similarity.Join(docs, 3, 90, "doc_id", "text")
    pairs = spark.createDataFrame([tuple(sorted(row.node for row in join.nodes.filter("n < 1000").select("node").limit(2).collect()))], "a bigint, b bigint")
    sets = join.sets(join.sized(pairs)).collect()
    assert len(sets) == 2 == len({row.row for row in sets})
    assert classes(docs, 3, 90) == by_brute_force(rows, 3, 90)


def test_one_of_each(spark):
    docs = odd_docs(spark)
    kept = similarity.one_of_each(docs)
    assert kept.schema == docs.schema
    want = collections.Counter([1, 3, 4, 5, 6, None, 7, 7, 8, 10])
    # Of keys 1, 2, 2, null and 9 one stays; (null, null) has no shingles and stays.
    assert collections.Counter(row.doc_id for row in kept.collect()) == want
    assert similarity.one_of_each(no_docs(spark)).count() == 0


def test_components(spark):
    dice = random.Random(5)
    links = [(a, dice.randrange(a)) for a in range(1, 300) if dice.random() < 0.8] + [(at, at + 1) for at in range(1000, 1060)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        one, other = root(a), root(b)
        parent[max(one, other)] = min(one, other)
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    got = {row.node: row.root for row in similarity.components(frame).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, rank int")


def test_top_k_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    dice = np.random.default_rng(2)
    matrix = (dice.integers(-4, 5, size=(400, 6)) / 8).astype(np.float32)
    matrix[7] = 0
    rows = [(at, matrix[at].tolist(), 0, 0) for at in range(400)]
    whole = np.floor(256 * matrix.astype(float)).astype(int)
    frame = vectors_of(spark, rows)
    got = collections.defaultdict(list)
    for row in topk.top_k(frame, frame.vec_id % 50 == 0, k=5).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.vec_id, row.score))
    for query in range(0, 400, 50):
        scores = sorted(((int(whole[at] @ whole[query]), at) for at in range(400) if at != query), key=lambda x: (-x[0], x[1]))[:5]
        assert got[query] == [(at, score) for score, at in scores]


def test_top_k_of_long_components(spark):
    rows = [(0, [1.0, 2.0], 0, 0), (1, [300000.0, 1.0], 0, 0), (2, [2.0**24, -1.0], 0, 0), (3, [1.0, 1.0], 0, 0), (50, [300000.0, 0.0], 0, 0),
            (4, [-2.0**54, 0.0], 0, 0)]
    frame = vectors_of(spark, rows)
    got = [(r.query_id, r.vec_id, r.score) for r in topk.top_k(frame, frame.vec_id % 50 == 0, k=4).orderBy("query_id", "rank").collect()]
    whole = {key: [int(256 * x) for x in vector] for key, vector, *_ in rows}
    for query in (0, 50):
        scores = sorted((-sum(a * b for a, b in zip(whole[query], whole[key])), key) for key in whole if key != query)[:4]
        assert [(v, s) for q, v, s in got if q == query] == [(key, -score) for score, key in scores]
    for vector in ([2.0**54, 0.0], [-2.0**54, 0.0]):
        frame = vectors_of(spark, [(50, [300000.0, 0.0], 0, 0), (1, vector, 0, 0)])
        with pytest.raises(Exception, match="does not fit a long"):
            topk.top_k(frame, frame.vec_id % 50 == 0).collect()


def test_top_k_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0], 0, 0), (50, [0.5, -1.0], 0, 0), (51, [1.0, 1.0], 0, 0), (51, [1.0, 1.0], 0, 0), (52, None, 0, 0), (53, [1.0, None], 0, 0),
            (54, [inf, 1.0], 0, 0), (55, [nan, 1.0], 0, 0), (None, [1.0, 1.0], 0, 0), (56, [], 0, 0), (57, [1e30, 0.0], 0, 0), (100, [0.0, 0.0], 0, 0)]
    frame = vectors_of(spark, rows)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(frame, frame.vec_id % 50 == 0).orderBy("query_id", "rank").collect()]
    first = [(51, 256 * 256 * 3), (51, 256 * 256 * 3), (56, 0), (100, 0), (50, 256 * 128 - 512 * 256)]
    assert [(v, s) for q, _, v, s in got if q == 0] == first
    assert [v for q, _, v, _ in got if q == 100] == [0, 50, 51, 51, 56]
    none = vectors_of(spark, [])
    assert topk.top_k(none, none.vec_id % 50 == 0).count() == 0
