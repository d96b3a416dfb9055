import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import no_docs, odd_docs, odd_rows, plain_docs, words
from tokenizers import Tokenizer

from merchlake.llm import bestfit

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILES[0])


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def checked(pieces, length):
    """Sequences are filled from 0 without a gap; returns how many there are."""
    sequences = defaultdict(list)
    for piece in pieces:
        assert len(piece.ids) == 4 * piece.length
        sequences[piece.sequence_id].append((piece.offset, piece.length))
    for own in sequences.values():
        place = 0
        for offset, size in sorted(own):
            assert offset == place
            place += size
        assert place <= length
    return len(sequences)


def documents_of(pieces):
    """Ids of each document, from its pieces in order; keys must be unique."""
    texts = defaultdict(list)
    for piece in sorted(pieces, key=lambda p: (p.doc_id, p.piece)):
        own = texts[piece.doc_id]
        assert piece.start == len(own)
        own += np.frombuffer(piece.ids, "<u4").tolist()
    return texts


def test_odd_rows_are_packed_whole(spark, tokenizer):
    length = 64
    pieces = bestfit.pack(odd_docs(spark).repartition(3), *FILES, length=length).collect()
    checked(pieces, length)
    want = []
    for key, text, *_ in odd_rows():
        ids = ids_of(tokenizer, text)
        first = len(ids) % length or length
        edges = [0, *range(first, len(ids) + 1, length)]
        want += [(key or -1, at, start, np.array(ids[start:end], "<u4").tobytes()) for at, (start, end) in enumerate(zip(edges, edges[1:]))]
    assert sorted((p.doc_id or -1, p.piece, p.start, p.ids) for p in pieces) == sorted(want)


def test_no_documents(spark):
    assert bestfit.pack(no_docs(spark), *FILES).count() == 0


@pytest.mark.parametrize("broadcast", [0, 2000])
def test_many_documents(spark, tokenizer, monkeypatch, broadcast):
    monkeypatch.setattr(bestfit, "BROADCAST_PARTITIONS", broadcast)
    dice = random.Random(5)
    texts = {key: " ".join(words(key, int(dice.lognormvariate(3, 1)) + 1)) for key in range(500)}
    texts |= {1000 + key: "same words here" for key in range(300)}
    pieces = bestfit.pack(plain_docs(spark, texts).repartition(7), *FILES, length=128).collect()
    found = documents_of(pieces)
    assert found == {key: ids_of(tokenizer, text) for key, text in texts.items()}
    total = sum(map(len, found.values()))
    assert checked(pieces, 128) <= total / 128 * 1.02 + 1


def simple_best_fit(sizes, length):
    open_ = []
    for size in sorted(sizes, reverse=True):
        fits = [at for at, gap in enumerate(open_) if gap >= size]
        if fits:
            best = min(fits, key=lambda at: open_[at])
            open_[best] -= size
        else:
            open_.append(length - size)
    return len(open_)


@pytest.mark.parametrize("seed", range(12))
def test_never_more_than_best_fit(seed):
    dice = random.Random(seed)
    kinds = [lambda: dice.randint(1, 99), lambda: dice.randint(20, 40), lambda: dice.choice([50, 33, 34, 17, 66]),
             lambda: min(99, int(dice.lognormvariate(2.5, 1)) + 1)]
    sizes = [kinds[seed % 4]() for _ in range(dice.choice([1, 7, 300, 2000]))]
    counts = np.bincount(sizes, minlength=100)
    shapes = bestfit.shapes_of(counts, 100)
    placed = np.zeros(100, int)
    for lengths, times in shapes:
        assert sum(lengths) <= 100 and times > 0
        for size in lengths:
            placed[size] += times
    assert placed.tolist() == counts.tolist()
    assert sum(shape.times for shape in shapes) <= simple_best_fit(sizes, 100)


def test_complements_fill_exactly():
    counts = np.zeros(100, int)
    counts[[60, 40, 70, 20, 10, 90, 5, 3, 2]] = [3, 2, 4, 2, 3, 1, 1, 1, 1]
    supply = bestfit.Supply(counts, 100)
    shapes = bestfit.exact_shapes(supply)
    assert all(sum(shape.lengths) == 100 for shape in shapes)
    assert bestfit.Shape((90, 10), 1) in shapes and bestfit.Shape((70, 20, 10), 2) in shapes and bestfit.Shape((60, 40), 2) in shapes
    assert bestfit.Supply(np.bincount([90, 5, 3, 2], minlength=100), 100).complement(10, (90,), 3) == (5, 3, 2)
    assert bestfit.Supply(np.bincount([80, 10, 5, 5], minlength=100), 100).complement(20, (80,), 3) == (10, 5, 5)
    assert bestfit.Supply(np.bincount([80, 10, 5], minlength=100), 100).complement(20, (80,), 3) is None


def test_plan_size_does_not_follow_the_counts():
    dice = random.Random(1)
    counts = np.bincount([dice.randint(1, 99) for _ in range(3000)], minlength=100)
    few, many = bestfit.Plan(counts, 100), bestfit.Plan(counts * 10**9, 100)
    assert len(many.first) <= 3 * len(few.first) + 300
    sizes = np.array([50, 99])
    sequence, offset = many.place(sizes, counts[sizes] * 10**9 - 1)
    assert (sequence < many.sequences).all() and (offset + sizes <= 100).all()
