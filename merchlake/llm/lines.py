"""Line deduplication by prefix doubling over sequences of line ids, in DataFrame functions alone.

Lines that occur once end the sequences; what is left is runs of repeated lines. Every position gets the
rank of the suffix that begins there, sorted by its first line, then by its first two, four, eight lines
and so on: the rank of twice the length follows from the pair of ranks of both halves. The positions that
share their first d lines are an interval of that order whose common prefix is at least d, and the pair
of ranks of the first and the last 2^k of those d lines (2^k <= d < 2^(k+1)) names it. A run of repeated
lines with enough words is covered by its smallest stretches with enough words, so the intervals of these
stretches tell which lines are later copies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from merchlake.llm.common import as_row, interim, staged

MIN_WORDS = 50
RANK_BUCKETS = 4096
BITMAP_BITS = 25  # a bitmap of 4 MB marks the keys of documents that lose lines
PLACE = ["_key", "_doc", "_pos"]


def _doc_id(text: Column) -> Column:
    """128 bits that name a text."""
    return F.unhex(F.md5(text.cast("binary")))


def line_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per distinct (key, text): array of lines as two 64-bit hashes and a word count."""
    lines = F.transform(F.split(F.col(text), "\n", -1), lambda line: F.struct(
        F.xxhash64(line).alias("l1"), F.xxhash64(F.lit("line"), line).alias("l2"),
        F.regexp_count(line, F.lit(r"\S+")).alias("words")))
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("_key"), _doc_id(F.col(text)).alias("_doc"), lines.alias("_lines"))
    return rows.groupBy("_key", "_doc").agg(F.first("_lines").alias("_lines"))


def _ranked(groups: DataFrame, major: str, order: list[str], bucket: Column) -> DataFrame:
    """Adds ``_before``: members of smaller groups with the same ``major``, by ``order``.

    ``groups`` has one row per group with ``_count``; ``bucket`` must not fall along ``order``. Counts are
    summed within (major, bucket) and over the buckets before it, so no major value is ranked in one task.
    """
    rows = groups.withColumn("_bucket", bucket)
    inside = W.partitionBy(major, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_count").over(inside), F.lit(0)))
    totals = rows.groupBy(major, "_bucket").agg(F.sum("_count").alias("_total"))
    earlier = W.partitionBy(major).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col(major).alias("_m"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_outside"))
    joined = rows.join(totals, (F.col(major) == F.col("_m")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("_before", F.col("_inside") + F.col("_outside")).drop("_bucket", "_inside", "_m", "_b", "_outside")


def repeated_positions(table: DataFrame) -> DataFrame:
    """Positions of lines that occur twice or more, with the rank of the line and the run it stands in."""
    lines = table.select("_key", "_doc", F.posexplode("_lines").alias("_pos", "_line")).select(
        *PLACE, "_line.l1", "_line.l2", "_line.words")
    counts = lines.groupBy("l1", "l2").agg(F.count("*").alias("_count")).filter("_count > 1").withColumn("_all", F.lit(0))
    # The hash is uniform, so its upper bits are even buckets in its order.
    ranks = _ranked(counts, "_all", ["l1", "l2"], F.shiftright("l1", 52)).select(
        F.col("l1").alias("_l1"), F.col("l2").alias("_l2"), F.col("_before").alias("_rank"))
    found = lines.join(ranks, (F.col("l1") == F.col("_l1")) & (F.col("l2") == F.col("_l2"))).select(*PLACE, "words", "_rank")
    in_doc = W.partitionBy("_key", "_doc").orderBy("_pos")
    found = found.withColumn("_run", F.col("_pos") - F.row_number().over(in_doc))
    return found.withColumn("_sofar", F.sum("words").over(W.partitionBy("_key", "_doc", "_run").orderBy("_pos")))


def stretches(positions: DataFrame, min_words: int) -> DataFrame:
    """Smallest stretches (start, lines) with ``min_words``: from each position on, and back from each."""
    run = ["_key", "_doc", "_run"]
    rows = positions.withColumn("_start", F.col("_sofar") - F.col("words"))
    whole = W.partitionBy(*run)
    rows = rows.withColumns({"_first": F.min("_pos").over(whole), "_last": F.max("_pos").over(whole), "_total": F.max("_sofar").over(whole)})
    # Both frames only grow, so a long run takes linear time.
    beyond = W.partitionBy(*run).orderBy(F.desc("_start")).rangeBetween(W.unboundedPreceding, -min_words)
    until = F.coalesce(F.min("_pos").over(beyond) - 1, F.when(F.col("_total") - F.col("_start") >= min_words, F.col("_last")))
    before = W.partitionBy(*run).orderBy("_sofar").rangeBetween(W.unboundedPreceding, -min_words)
    since = F.coalesce(F.max("_pos").over(before) + 1, F.when(F.col("_sofar") >= min_words, F.col("_first")))
    rows = rows.withColumns({"_until": until, "_since": since})
    both = F.array(F.struct(F.col("_pos").alias("start"), (F.col("_until") - F.col("_pos") + 1).alias("lines")),
                   F.struct(F.col("_since").alias("start"), (F.col("_pos") - F.col("_since") + 1).alias("lines")))
    found = rows.select("_key", "_doc", F.inline(both)).filter("start is not null and lines is not null")
    return found.distinct()


def doubled(positions: DataFrame, reach: int, total: int) -> DataFrame:
    """Ranks by the first ``2 * reach`` lines, from ranks by the first ``reach``.

    A rank is the number of positions with smaller prefixes, so it stays as it is where nothing is left
    to tell apart. Only groups of several positions are split; the end of a run sorts first.
    """
    in_run = W.partitionBy("_key", "_doc", "_run").orderBy("_pos")
    pairs = positions.withColumn("_next", F.coalesce(F.lead("_rank", reach).over(in_run), F.lit(-1)))
    groups = pairs.groupBy("_rank", "_next").agg(F.count("*").alias("_count"))
    bucket = F.floor((F.col("_next") + 1) * RANK_BUCKETS / (total + 1)).cast("int")
    ranked = _ranked(groups, "_rank", ["_next"], bucket).filter("_before > 0")
    ranked = ranked.select(F.col("_rank").alias("_r"), F.col("_next").alias("_n"), "_before")
    joined = pairs.join(ranked, (F.col("_rank") == F.col("_r")) & (F.col("_next") == F.col("_n")), "left")
    return joined.select(*PLACE, "_run", (F.col("_rank") + F.coalesce("_before", F.lit(0))).alias("_rank"))


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stretches of lines that occurred before: (_key, _doc, start, lines, first_key, first_start).

    The order of documents is that of their keys (null first), then of their texts' digests; within a
    document that of its lines.
    """
    table = staged(line_table(docs, key, text), "lines")
    positions = staged(repeated_positions(table), "positions")
    wanted = staged(stretches(positions, min_words), "stretches")
    total, longest = positions.count(), wanted.agg(F.max("lines")).first()[0] or 0
    ranks, reach, levels = positions.select(*PLACE, "_run", "_rank"), 1, []
    while reach <= longest:
        # The stretches of this level are named by the ranks of their first and last ``reach`` lines.
        own = wanted.filter((F.col("lines") >= reach) & (F.col("lines") < 2 * reach))
        at = ranks.select(F.col("_key").alias("_k"), F.col("_doc").alias("_d"), F.col("_pos").alias("_p"), "_rank")

        def looked_up(rows: DataFrame, place: Column, name: str) -> DataFrame:
            same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_doc") == F.col("_d")) & (place == F.col("_p"))
            return rows.join(at.withColumnRenamed("_rank", name), same).drop("_k", "_d", "_p")

        named = looked_up(own, F.col("start"), "_first")
        named = looked_up(named, F.col("start") + F.col("lines") - reach, "_last") if reach > 1 else named.withColumn("_last", F.col("_first"))
        # Each level is written by itself, so that no plan holds the joins of all.
        levels.append(staged(named.select("_key", "_doc", "start", "lines", "_first", "_last"), "intervals"))
        reach *= 2
        if reach <= longest:
            ranks = staged(doubled(ranks, reach // 2, total), "ranks")
    none = wanted.select("*", F.lit(0).cast("bigint").alias("_first"), F.lit(0).cast("bigint").alias("_last"))
    found = reduce(DataFrame.union, levels) if levels else none
    place = F.struct("_key", "_doc", "start")
    first = found.groupBy("lines", "_first", "_last").agg(F.min(place).alias("_origin"), F.count("*").alias("_times")).filter("_times > 1")
    first = first.select(F.col("lines").alias("_l"), F.col("_first").alias("_f"), F.col("_last").alias("_e"), "_origin")
    copies = found.join(first, (F.col("lines") == F.col("_l")) & (F.col("_first") == F.col("_f")) & (F.col("_last") == F.col("_e")))
    # No part of a struct compares by itself, as the key may be null.
    return copies.filter(place != F.col("_origin")).select(
        "_key", "_doc", "start", "lines", F.col("_origin._key").alias("first_key"), F.col("_origin.start").alias("first_start"))


def removed_spans(copies: DataFrame) -> DataFrame:
    """Per document: the spans (a, b) of lines to delete, ascending and apart, from stretches that may overlap."""
    order = W.partitionBy("_key", "_doc").orderBy("start", "lines")
    reach = F.max(F.col("start") + F.col("lines")).over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = copies.withColumn("_from", F.greatest(F.col("start"), F.coalesce(reach, F.lit(0))))
    spans = fresh.filter(F.col("_from") < F.col("start") + F.col("lines"))
    spans = spans.select("_key", "_doc", F.struct(F.col("_from").alias("a"), (F.col("start") + F.col("lines") - 1).alias("b")).alias("_span"))
    return spans.groupBy("_key", "_doc").agg(F.array_sort(F.collect_list("_span")).alias("_spans"))


def without_spans(text: Column, spans: Column) -> Column:
    """A text without the lines of these spans, in time that follows the number of lines and spans.

    Lines and spans stand in a list of one, so that they are made once and not again for each part that stays.
    """
    def cleaned(one: Column) -> Column:
        lines, gone = one["lines"], one["gone"]

        def kept(at: Column) -> Column:
            start = F.when(at == 0, 0).otherwise(F.get(gone, at - 1)["b"] + 1)
            return F.struct(start.alias("start"), (F.coalesce(F.get(gone, at)["a"], F.size(lines)) - start).alias("count"))

        parts = F.filter(F.transform(F.sequence(F.lit(0), F.size(gone)), kept), lambda part: part["count"] > 0)
        return F.array_join(F.transform(parts, lambda part: F.array_join(F.slice(lines, part["start"] + 1, part["count"]), "\n")), "\n")

    return F.get(F.transform(F.array(F.struct(F.split(text, "\n", -1).alias("lines"), spans.alias("gone"))), cleaned), F.lit(0))


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(2**BITMAP_BITS))


def dedupe(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text", counter: str = "lines_removed") -> DataFrame:
    """All columns with the text without later copies of repeated line runs, and ``counter``: how many lines went.

    A run is repeated if another document, or another place of the same one, has the same lines, and it
    counts from ``min_words`` words on (words are stretches without blanks). Its first occurrence stays;
    from every later one its lines go, wherever runs overlap. Lines are what stands between line feeds.
    Rows that agree in key and text are one document: they lose the same lines. Rows with equal keys and
    different texts are different documents, and a null key comes before all others. A null text stays
    null with no line removed, an empty one stays empty. A text that loses all its lines becomes empty.
    A column named like the counter is replaced; all others are kept whatever their names.

    Only rows whose key falls on the bit of a document that loses lines are shuffled to be joined with its
    spans; the bitmap has a fixed size, and the join decides.
    """
    with interim(docs.sparkSession):
        removed = staged(removed_spans(later_copies(docs, min_words, key, text)), "removed", keep=True)
    pages = removed.select(_bit(F.col("_key")).alias("_b")).groupBy(F.shiftright("_b", 15).alias("_page")).agg(
        F.bitmap_construct_agg(F.col("_b") % 2**15).alias("_bits"))
    rows = docs.select(as_row(docs, (counter.lower(),)), F.col(key).alias("_id"), F.col(text).alias("_text"), _bit(F.col(key)).alias("_b"))
    marked = rows.join(F.broadcast(pages), F.shiftright("_b", 15) == F.col("_page"), "left")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.col("_b") % 2**15 / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = marked.withColumn("_marked", F.coalesce(F.bit_get(byte, (F.col("_b") % 8).cast("int")) == 1, F.lit(False))).drop("_bits", "_page", "_b")
    same = F.col("_id").eqNullSafe(F.col("_key")) & (_doc_id(F.col("_text")) == F.col("_doc"))
    joined = marked.filter("_marked").join(removed, same, "left")
    cleaned = F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(without_spans(F.col("_text"), F.col("_spans")))
    count = F.aggregate("_spans", F.lit(0), lambda sofar, span: sofar + (span["b"] - span["a"] + 1).cast("int"))
    changed = joined.select(F.col("_row").withField(f"`{text}`", cleaned).alias("_row"), F.coalesce(count, F.lit(0)).alias("_n"))
    others = marked.filter("not _marked").select("_row", F.lit(0).alias("_n"))
    return changed.union(others).select("_row.*", F.col("_n").alias(counter))
