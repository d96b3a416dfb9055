"""Packing by concatenation and cutting.

Pass one turns every document into token ids and writes them with the number of ids that came before
it in its partition. The partition totals, summed up in order, give each partition its global offset;
pass two cuts documents where the fixed windows end. A document that crosses a border yields one
boundary record per window it touches.
"""

from __future__ import annotations

import base64
import functools
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.llm.common import arrow_rows, staged

BLOCK = 1024
TEXTS = 1000  # texts that a task holds at once
BROADCAST_PARTITIONS = 500_000  # partitions up to which their offsets (some 20 bytes each) are broadcast


class TextIds:
    """Little-endian 32-bit ids of a text, as the JSON tokenizer gives them.

    Texts are encoded by the ranks file of the same vocabulary, which is several times faster; a text that
    holds a special token goes to the tokenizer itself.
    """

    def __init__(self, tokenizer_json: str, ranks_file: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        # Kept only for the texts that need it, since it is large.
        self.tokenizer_json, exact = tokenizer_json, Tokenizer.from_file(tokenizer_json)
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [token.content for token in exact.get_added_tokens_decoder().values()]
        probe = "The 1st word, déjà vu — 漢字\n\n  x" * 3
        if exact.encode(probe, add_special_tokens=False).ids != self.fast.encode_ordinary(probe):
            raise ValueError(f"{ranks_file} does not hold the vocabulary of {tokenizer_json}")

    @functools.cached_property
    def exact(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.tokenizer_json)

    def of_text(self, text: str) -> bytes:
        if any(token in text for token in self.special):
            ids = self.exact.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return array("I", ids).tobytes() if sys.byteorder == "little" else np.asarray(ids, "<u4").tobytes()


@functools.lru_cache(maxsize=1)
def text_ids(tokenizer_json: str, ranks_file: str) -> TextIds:
    return TextIds(tokenizer_json, ranks_file)


def _tokenise(files: tuple[str, str], end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, before = TaskContext.get().partitionId(), 0
    end = int(end_id).to_bytes(4, "little")
    known = text_ids(*files)

    def batch(rows: list, keys: pa.Array) -> pa.RecordBatch:
        ids, starts = [row[0] for row in rows], [row[1] for row in rows]
        return pa.RecordBatch.from_arrays([
            keys, pa.array([part] * len(rows), pa.int32()), pa.array(starts, pa.int64()),
            pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()),
        ], names=["_key", "_part", "_before", "_n", "_ids"])

    for incoming in batches:
        keys, rows, first, size = incoming.column(0), [], 0, 0
        for at, text in enumerate(incoming.column(1)):
            text = text.as_py()
            ids = (known.of_text(text) if text else b"") + end
            rows.append((ids, before))
            before += len(ids) // 4
            size += len(ids)
            if size > 2_000_000:
                yield batch(rows, keys.slice(first, len(rows)))
                rows, first, size = [], at + 1, 0
        if rows:
            yield batch(rows, keys.slice(first, len(rows)))


def partition_offsets(tokens: DataFrame) -> DataFrame:
    """Ids before each partition: sums within blocks of partitions, and sums of whole blocks before them."""
    from pyspark.sql import Window as W

    totals = tokens.groupBy("_part").agg(F.sum("_n").alias("_total")).withColumn("_block", F.floor(F.col("_part") / BLOCK))
    # One row per 1,024 partitions meets in the single window.
    blocks = totals.groupBy("_block").agg(F.sum("_total").alias("_sum"))
    earlier = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_blocks_before"))
    within = W.partitionBy("_block").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    inside = totals.select("_block", F.col("_part").alias("_of"), F.coalesce(F.sum("_total").over(within), F.lit(0)).alias("_parts_before"))
    return inside.join(blocks, "_block").select("_of", (F.col("_blocks_before") + F.col("_parts_before")).alias("_base"))


def pack(docs: DataFrame, tokenizer_json: str, ranks_file: str, length: int = 1024, end_id: int = 0,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids: one row per document and sequence.

    A document is its ids and then ``end_id``; null and empty texts are ``end_id`` alone. Documents
    follow each other in the order of the input's partitions without a gap, so only the last sequence
    is shorter than ``length`` (see ``sequences`` for its padding). Returns the key, ``start`` (ids of
    the document before the piece), ``length``, ``ids`` (little-endian 32-bit), ``doc_tokens``,
    ``sequence_id`` and ``offset``. Repeated rows, equal keys and null keys are packed like any other
    row; other columns are not read; an empty table gives no piece.
    """
    kind = docs.schema[key].dataType
    schema = f"_key {kind.simpleString()}, _part int, _before bigint, _n bigint, _ids binary"
    files = (tokenizer_json, ranks_file)
    tokens = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(
        lambda batches: _tokenise(files, end_id, batches), schema)
    with arrow_rows(docs.sparkSession, TEXTS):
        tokens = staged(tokens, "tokens")
    # One short row for each partition of the input; without the hint all ids would be shuffled to meet them.
    offsets = partition_offsets(tokens)
    few = (tokens.agg(F.max("_part")).first()[0] or 0) < BROADCAST_PARTITIONS
    placed = tokens.join(F.broadcast(offsets) if few else offsets, F.col("_part") == F.col("_of"))
    at = F.col("_base") + F.col("_before")
    first, last = F.floor(at / length), F.floor((at + F.col("_n") - 1) / length)

    def piece(sequence):
        start = F.greatest(F.lit(0), sequence * length - at)
        size = F.least(F.col("_n"), (sequence + 1) * length - at) - start
        ids = F.substring(F.col("_ids"), (start * 4 + 1).cast("int"), (size * 4).cast("int"))
        return F.struct(start.alias("start"), size.alias("length"), ids.alias("ids"), F.col("_n").alias("doc_tokens"),
                        sequence.alias("sequence_id"), (at + start - sequence * length).alias("offset"))

    # The pieces are cut before the array is unfolded, so no row of the unfolded frame carries the whole document.
    cut = placed.select(F.col("_key").alias(key), F.transform(F.sequence(first, last), piece).alias("_pieces"))
    return cut.select(key, F.inline("_pieces"))


def sequences(pieces: DataFrame, length: int = 1024, pad_id: int = 0) -> DataFrame:
    """The sequences themselves: ``sequence_id``, ``n_ids`` and ``ids`` padded to ``length``.

    The pieces of one sequence are at most ``length``, so each group is small.
    """
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("_all"))
    joined = F.aggregate("_all", F.lit(b"").cast("binary"), lambda sofar, piece: F.concat(sofar, piece["ids"]))
    count = F.aggregate("_all", F.lit(0).cast("bigint"), lambda sofar, piece: sofar + piece["length"])
    filler = F.lit(int(pad_id).to_bytes(4, "little") * length)
    return whole.select("sequence_id", count.alias("n_ids"),
                        F.substring(F.concat(joined, filler), F.lit(1), F.lit(4 * length)).alias("ids"))
