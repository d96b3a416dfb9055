import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import no_docs, odd_docs, odd_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from merchlake.llm import packing, sharding

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILES[0])


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_are_the_documents(spark, tokenizer):
    pieces = packing.pack(odd_docs(spark).repartition(3), *FILES, length=64).collect()
    want = sorted((row[0] or -1, ids_of(tokenizer, row[1])) for row in odd_rows())
    # Sequences are read in order; documents follow each other in them.
    ordered = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    got, current = [], []
    place = 0
    for piece in ordered:
        assert (piece.sequence_id, piece.offset) == divmod(place, 64)
        place += piece.length
        current += np.frombuffer(piece.ids, "<u4").tolist()
        assert piece.start + piece.length == len(current)
        if len(current) == piece.doc_tokens:
            got.append((piece.doc_id or -1, current))
            current = []
    assert not current and sorted(got) == want


def test_sequences_are_padded(spark):
    pieces = packing.pack(odd_docs(spark), *FILES, length=64)
    rows = packing.sequences(pieces, length=64, pad_id=50256).orderBy("sequence_id").collect()
    assert [len(row.ids) for row in rows] == [256] * len(rows)
    assert all(row.n_ids == 64 for row in rows[:-1])
    last = np.frombuffer(rows[-1].ids, "<u4")
    assert (last[rows[-1].n_ids:] == 50256).all()


@pytest.mark.parametrize("text", ["a  b", " lead", "trail ", "x\n\n y \t z", "it's <|endoftext|> done", "\u00a0 wide\u3000gap", "1 22 333", "don't\r\nstop"])
def test_ids_are_the_tokenizers(tokenizer, text):
    own = packing.TextIds(*FILES)
    assert np.frombuffer(own.of_text(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_no_documents(spark):
    assert packing.pack(no_docs(spark), *FILES).count() == 0
    assert sharding.shard(no_docs(spark), 4).count() == 0


def jump(key: int, shards: int) -> int:
    key, bucket, following = key % 2**64, -1, 0
    while following < shards:
        bucket = following
        key = (key * 2862933555777941757 + 1) % 2**64
        following = int((bucket + 1) * (float(2**31) / float((key >> 33) + 1)))
    return bucket


def test_jumps(spark):
    keys = [0, 1, 2, 17, -1, -(2**63), 2**63 - 1, *range(1000, 1300)]
    frame = spark.createDataFrame([(key,) for key in keys], "doc_id bigint")
    for shards in (1, 2, 24, 1000):
        got = {row.doc_id: row.shard for row in sharding.shard(frame, shards).collect()}
        assert got == {key: jump(key, shards) for key in keys}


def test_slots_and_growth(spark):
    rows = sharding.shard(odd_docs(spark), 5, ties=("text",), bucket_rows=1).collect()
    assert len(rows) == len(odd_rows()) and rows[0]["node.n"] == 1 and rows[0]["_key"] == "k"
    for shard in range(5):
        slots = sorted(row.slot for row in rows if row.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(row.grown_shard in (row.shard, 5) for row in rows)
    assert len({row.shard for row in rows if row.doc_id == 2}) == 1


def test_a_hot_key_is_numbered_in_many_tasks(spark):
    """All rows have one key, or none, and many are equal: the slots' order holds, and no window sees a row's key."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).cast("bigint").alias("doc_id"), (F.col("id") % 5000).alias("size"))
    placed = sharding.shard(rows, 4, ties=("size",))
    got = placed.collect()
    for shard in {row.shard for row in got}:
        own = sorted((row for row in got if row.shard == shard), key=lambda row: row.slot)
        assert [row.slot for row in own] == list(range(len(own)))
    for key in (7, None):
        own = sorted((row for row in got if row.doc_id == key), key=lambda row: row.slot)
        assert len(own) == 20_000 and [row["size"] for row in own] == sorted(row["size"] for row in own)
    text = placed._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in text and "_bucket" not in text


def test_text_keys_move_to_the_new_shard_only(spark):
    frame = spark.range(2000).selectExpr("concat('k', id) as doc_id")
    rows = sharding.shard(frame, 10).collect()
    moved = [row for row in rows if row.grown_shard != row.shard]
    assert {row.grown_shard for row in moved} == {10} and 100 < len(moved) < 280


def test_crc_of_text():
    assert zlib.crc32(b"123456789") == 0xCBF43926
