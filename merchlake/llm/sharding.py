"""Sharding by jump consistent hashing, in DataFrame functions alone.

A key alone decides its shard: its jumps through the bucket numbers are drawn from a generator seeded
with the key, and the last jump below the number of shards is the shard. With one more shard a key
either stays or goes to the new one, and no table of ring positions exists.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchlake.llm.common import as_row, crc32_text, staged

# Multiplier of the published jump hash (a 64-bit linear congruential generator), and 2^64.
MULTIPLIER = 2862933555777941757
WORD = 2**64


def key_number(column: Column, kind: T.DataType) -> Column:
    """A key as an unsigned 64-bit number: whole numbers as they are, others by hash; null is 0."""
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    number = (column if whole else F.xxhash64(column)).cast("decimal(20,0)")
    number = F.coalesce(number, F.lit(0).cast("decimal(20,0)"))
    return F.when(number < 0, number + F.lit(Decimal(WORD)).cast("decimal(20,0)")).otherwise(number).cast("decimal(20,0)")


def jump_shard(number: Column, shards: int) -> Column:
    """Shard (0 to shards - 1) of an unsigned 64-bit key.

    A jump chain has about ln(shards) steps; a first stretch of fixed length ends nearly all of them,
    and the rest walk on for up to ``shards`` steps, which always suffices.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")

    def step(state: Column, _: Column) -> Column:
        following = ((state["key"] * multiplier + F.lit(1)) % word).cast("decimal(20,0)")
        top = F.floor(following / F.lit(2**33)).cast("double")
        jump = F.floor((state["at"] + 1).cast("double") * (F.lit(float(2**31)) / (top + 1.0))).cast("bigint")
        moved = F.struct(following.alias("key"), state["at"].alias("shard"), jump.alias("at"))
        return F.when(state["at"] < shards, moved).otherwise(state)

    multiplier, word = F.lit(Decimal(MULTIPLIER)).cast("decimal(19,0)"), F.lit(Decimal(WORD)).cast("decimal(20,0)")
    start = F.struct(number.alias("key"), F.lit(-1).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("at"))
    short = min(shards, 8 + 4 * math.ceil(math.log(shards + 1)))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(short)), start, step)
    if short < shards:
        state = F.when(state["at"] >= shards, state).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state, step))
    return state["shard"].cast("int")


def shard(rows: DataFrame, shards: int, key: str = "doc_id", ties: tuple[str, ...] = (), bucket_rows: int = 2000) -> DataFrame:
    """Every row with ``shard``, ``slot`` (gapless from 0 in its shard) and ``grown_shard`` (one shard more).

    Law: the key and the number of shards decide. Rows with equal keys, and all rows with a null key
    (taken as key 0), share a shard. Slots run by a bucket of the key's CRC-32, then by key, then by
    the columns in ``ties``; rows that agree in all of these are interchangeable. The number of buckets
    follows the number of rows. No shard, bucket or key is numbered in one task: the rows are sorted in
    ranges of all these columns and at last of a number of the row's own, which splits equal rows too;
    a row's slot is its place among its shard's rows in its range, after those of the ranges before. An
    empty table gives no row. The names ``shard``, ``slot`` and ``grown_shard`` are replaced if the input
    has them.
    """
    own = F.col(key)
    number = key_number(own, rows.schema[key].dataType)
    buckets = max(1, math.ceil(rows.count() / (shards * bucket_rows)))
    order = [own.alias("_key"), *[F.col(name).alias(f"_tie{at}") for at, name in enumerate(ties)]]
    # Written once: the hash chain is not repeated for the counts and the numbering.
    placed = staged(rows.select(as_row(rows, ("shard", "slot", "grown_shard")), *order, jump_shard(number, shards).alias("shard"),
                                jump_shard(number, shards + 1).alias("grown_shard"),
                                (F.coalesce(crc32_text(own), F.lit(0)) % buckets).alias("_bucket"), F.monotonically_increasing_id().alias("_own")), "shards")
    by = ["shard", "_bucket", "_key", *[f"_tie{at}" for at in range(len(ties))], "_own"]
    ordered = placed.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id())
    # The place's upper bits are the range; written once, so that no other sort can give it anew.
    ranged = staged(ordered.select("_row", "shard", "grown_shard", F.shiftright("_place", 33).alias("_range"), "_place"), "slots")
    counts = ranged.groupBy("shard", "_range").agg(F.count("*").alias("_count"), F.min("_place").alias("_first"))
    earlier = W.partitionBy("shard").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("shard", "_range", (F.coalesce(F.sum("_count").over(earlier), F.lit(0)) - F.col("_first")).alias("_base"))
    found = ranged.join(bases, ["shard", "_range"])
    return found.select("_row.*", "shard", (F.col("_base") + F.col("_place")).cast("bigint").alias("slot"), "grown_shard")
