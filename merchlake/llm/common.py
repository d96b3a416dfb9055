"""Helpers that several operators of this package share."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlake.session import work_folder


ROW_GROUP = 32 * 2**20
_INTERIM: list[list[str]] = []


def staged(df: DataFrame, purpose: str, keep: bool = False) -> DataFrame:
    """Write a frame below ``spark.checkpoint.dir`` and read it back.

    This cuts the lineage: what an executor computed is then on shared storage and outlives it, and
    the frame can be read several times. Within :func:`interim` the table lasts until its end, unless
    it is to be kept.
    """
    spark = df.sparkSession
    path = work_folder(spark, f"llm-{purpose}")
    if _INTERIM and not keep:
        _INTERIM[-1].append(path)
    # Small row groups, since a task holds the one that it writes in memory.
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(*frames: DataFrame) -> None:
    """Remove staged tables before their block ends: large ones that nothing reads any more."""
    for df in frames:
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def interim(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are removed at the end; what leaves the block must be staged with ``keep``."""
    _INTERIM.append([])
    try:
        yield
    finally:
        for path in _INTERIM.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python gets at most so many rows at once from what runs inside: for tables whose rows are whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_row(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """All columns, but for those named, as one struct ``_row``, so that none clashes with an operator's own."""
    return F.struct(*[df[f"`{column}`"] for column in df.columns if column.lower() not in without]).alias("_row")


def crc32_text(column: Column) -> Column:
    """CRC-32 of a value as text, unsigned; null stays null."""
    return F.crc32(column.cast("string").cast("binary"))


def labelled_sample(labels: DataFrame, label: str, keep: Column, bound: int) -> DataFrame:
    """At most ``bound`` rows (key, label) of the labels that may be learned from.

    The smallest hashes of the key are taken, so the choice is the same on every run. A document
    labelled twice gets the larger label. The bound is what allows a broadcast of the result.
    """
    usable = labels.filter(keep & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    one = usable.groupBy(F.col("doc_id").alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    # A share of the hashes that holds the bound and some more, so that no task sends more rows than are needed.
    share = min(1.0, (1.2 * bound + 1000) / max(1, one.count()))
    near = one.filter(F.pmod(F.xxhash64("_key"), F.lit(2**31)) < int(share * 2**31))
    return F.broadcast(near.orderBy(F.pmod(F.xxhash64("_key"), F.lit(2**31)), "_key").limit(bound))


def sampled_rows(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row (_key, _text, _label) for each sampled key: of equal keys the text of the smallest hash.

    So the sample's bound is one of rows, however often a key repeats.
    """
    text = F.min(F.struct(F.xxhash64("_text").alias("hash"), "_text")).alias("_t")
    one = rows.select("_key", "_text").join(chosen, "_key").groupBy("_key").agg(text, F.min("_label").alias("_label"))
    return staged(one.select("_key", "_t._text", "_label"), "sample")


def text_batches(texts: list, chars: int, rows: int) -> Iterator[tuple[int, int]]:
    """Spans (from, to) over a list of texts, each of bounded size unless one text alone exceeds it."""
    start, size = 0, 0
    for at, text in enumerate(texts):
        length = len(text) if text else 0
        if at > start and (size + length > chars or at - start >= rows):
            yield start, at
            start, size = at, 0
        size += length
    if start < len(texts):
        yield start, len(texts)


# --- sums of long vectors over partitions ----------------------------------------------------------

SLICE = 4096  # numbers per row, so that a long vector is summed in many tasks


def vector_rows(totals: np.ndarray) -> pd.DataFrame:
    """One partition's totals as rows (slice, values)."""
    flat = np.ascontiguousarray(totals, "<i8").ravel()
    parts = [(at // SLICE, flat[at:at + SLICE].tobytes()) for at in range(0, len(flat), SLICE)]
    return pd.DataFrame(parts, columns=["slice", "values"])


def _added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for frame in frames:
        for number, values in zip(frame["slice"].tolist(), frame["values"]):
            own = np.frombuffer(values, "<i8")
            sums[number] = sums[number] + own if number in sums else own
    yield pd.DataFrame({"slice": list(sums), "values": [value.tobytes() for value in sums.values()]})


def summed_vector(parts: DataFrame, length: int) -> np.ndarray:
    """Sum of all partitions' vectors of a fixed length; each slice is added up in one task, row by row."""
    slices = -(-length // SLICE)
    sums = parts.repartition(slices, "slice").mapInPandas(_added, "slice int, values binary").toPandas()
    total = np.zeros(slices * SLICE, np.int64)
    for number, values in zip(sums["slice"].tolist(), sums["values"]):
        own = np.frombuffer(values, "<i8")
        total[number * SLICE:number * SLICE + len(own)] += own
    return total[:length]
