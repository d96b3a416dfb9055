"""URL filters: rules by host and path, and for the rest naive Bayes over segmented names.

Host labels are often words written together. A unigram model (frequencies of all words of the pages' text)
and Viterbi's search split them; a multinomial naive Bayes model over these words and the words of the
path, learned from all addresses that a rule decides, judges the others.
"""

from __future__ import annotations

import dataclasses
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.llm.common import as_row, staged, summed_vector, vector_rows

BUCKETS = 2**16  # tokens of naive Bayes by hash, so that the model's size does not follow the addresses
SALTS = 16
ROWS = 100_000  # substrings that go on at once
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = re.compile(r"[^\W\d_]+|\d+")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest fitting one of (verdict, host, path); null where none fits.

    A rule fits its host and all its subdomains, if the path starts with the rule's. Of equally long
    rules the one with the longer host wins.
    """
    ordered = sorted(rules, key=lambda rule: (-len(rule[1] + rule[2]), -len(rule[1]), rule[1:]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, own_host, own_path in reversed(ordered):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        name, verdict = F.when(fits, F.lit(own_host + own_path)).otherwise(name), F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """Letter words of marked-up text, A-Z and others in lower case, with their counts over all rows."""
    plain = F.lower(F.regexp_replace(F.col(column), r"<[^>]*>", " "))
    words = texts.select(F.explode(F.regexp_extract_all(plain, F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("count"))


class Segmenter:
    """Words of a name written together: the split of highest unigram probability.

    A piece outside the lexicon is ten times less likely with each letter more. Of equal splits the one
    with the longest last word is taken. The lexicon need hold only the words that names contain.
    """

    def __init__(self, logs: dict[str, float], total: float):
        self.logs, self.total = logs, math.log(max(total, 1.0))
        self.lengths = sorted({len(word) for word in logs}, reverse=True)

    def __getitem__(self, name: str) -> tuple[str, ...]:
        letter = math.log(10.0)
        best = [0.0] + [-math.inf] * len(name)
        cut = [0] * (len(name) + 1)
        far = 0  # where the best piece outside the lexicon starts, the same for every end from here on
        for end in range(1, len(name) + 1):
            if best[end - 1] + (end - 1) * letter > best[far] + far * letter:
                far = end - 1
            best[end], cut[end] = best[far] + (letter - self.total - (end - far) * letter), far
            for length in self.lengths:
                start = end - length
                log = self.logs.get(name[start:end]) if start >= 0 else None
                if log is not None:
                    value = best[start] + log
                    if value > best[end] or (value == best[end] and start < cut[end]):
                        best[end], cut[end] = value, start
        words, end = [], len(name)
        while end:
            words.append(name[cut[end]:end])
            end = cut[end]
        return tuple(reversed(words))


def _names(host: str) -> list[str]:
    return TOKEN.findall(host.lower())


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """Distinct hosts (``host``) with their ``words``, joined by spaces.

    Each host meets the counts of its own substrings only, in a join, so the unigram model has every word
    and is neither cut nor sent anywhere as a whole. A number counts by its length.
    """
    known = counts.agg(F.sum("count").alias("total"), F.collect_set(F.length("word")).alias("lengths")).first()
    total, lengths = float(known["total"] or 0), sorted(known["lengths"])
    hosts = staged(hosts.select("host").distinct().select(F.monotonically_increasing_id().alias("id"), "host"), "hosts")

    def substrings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, words = [], []
            for number, host in zip(batch["id"].tolist(), batch["host"]):
                names = {name for name in _names(host) if not name.isdigit()}
                own = {name[at:at + length] for name in names for length in lengths for at in range(len(name) - length + 1)}
                ids.extend([number] * len(own))
                words.extend(own)
                if len(ids) >= ROWS:
                    yield pd.DataFrame({"id": ids, "word": words})
                    ids, words = [], []
            yield pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "word": pd.Series(words, dtype=object)})

    # Which words occur in hosts at all is found first; these few are then repeated for each salt, as most
    # hosts hold the same short words.
    pieces = staged(hosts.mapInPandas(substrings, "id bigint, word string"), "pieces")
    needed = counts.join(pieces.select("word").distinct(), "word").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = pieces.withColumn("salt", F.pmod("id", F.lit(SALTS)).cast("int")).join(needed, ["word", "salt"])
    lexicons = met.groupBy("id").agg(F.collect_list("word").alias("known"), F.collect_list("count").alias("counts"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for host, own, times in zip(batch["host"], batch["known"], batch["counts"]):
                logs = {} if own is None else {word: math.log(count / total) for word, count in zip(own, times)}
                segmenter = Segmenter(logs, total)
                found.append(" ".join(word for name in _names(host) for word in (segmenter[name] if not name.isdigit() else (f"#{len(name)}",))))
            yield pd.DataFrame({"host": batch["host"], "words": found})

    joined = hosts.join(lexicons, "id", "left").select("host", "known", "counts")
    return staged(joined.mapInPandas(split, "host string, words string"), "host-words")


def _host_tokens(words: str) -> list[str]:
    return ["h:" + word for word in words.split()]


def _path_tokens(path: str) -> list[str]:
    """Path words; a number counts by its length."""
    return ["p:" + (word if not word[0].isdigit() else f"#{len(word)}") for word in _names(path)]


def _buckets(tokens: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS for token in tokens), np.int64, len(tokens))


@dataclasses.dataclass
class Model:
    """Log-odds (allow against block) by token bucket, with the prior's."""

    odds: np.ndarray
    prior: float


def fit(decided: DataFrame, words: DataFrame) -> Model:
    """Learn from addresses (host, path, verdict) that rules decided, and the ``words`` of their hosts.

    Every decided address is counted; equal hosts of one verdict are counted together before their words
    are. To the driver come two fixed tables. With one class alone, or none, no token speaks for either side.
    """

    def count_hosts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            for own, verdict, pages in zip(batch["words"], batch["verdict"], batch["pages"].tolist()):
                row = totals[0 if verdict == "allow" else 1]
                np.add.at(row, _buckets(_host_tokens(own)), pages)
                row[BUCKETS] += pages
        yield vector_rows(totals)

    def count_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            for path, verdict in zip(batch["path"], batch["verdict"]):
                np.add.at(totals[0 if verdict == "allow" else 1], _buckets(_path_tokens(path)), 1)
        yield vector_rows(totals)

    schema = "slice int, values binary"
    hosts = decided.groupBy("host", "verdict").agg(F.count("*").alias("pages")).join(words, "host")
    by_host = hosts.select("words", "verdict", "pages").mapInPandas(count_hosts, schema)
    by_path = decided.select("path", "verdict").mapInPandas(count_paths, schema)
    table = summed_vector(by_host.union(by_path), 2 * (BUCKETS + 1)).reshape(2, BUCKETS + 1).astype(float)
    pages = table[:, BUCKETS]
    if not pages.all():
        return Model(np.zeros(BUCKETS), 0.0)
    smooth = (table[:, :BUCKETS] + 1.0) / (table[:, :BUCKETS].sum(axis=1, keepdims=True) + BUCKETS)
    return Model(np.log(smooth[0] / smooth[1]), float(np.log(pages[0] / pages[1])))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", text: str = "html") -> DataFrame:
    """All columns with ``host``, ``path``, ``rule``, ``log_odds`` and ``verdict`` (allow or block).

    Rules decide first; the model judges the rest, and allows at log-odds of zero and above, so an address
    without any token goes by the prior. A null address, or one without ``://``, has an empty host and
    path. The rules are a list in the program and become part of the plan. Columns of the output's names
    are replaced; an empty table gives no row.
    """
    spark = pages.sparkSession
    rows = pages.select(as_row(pages, ("host", "path", "rule", "log_odds", "verdict")), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    words = host_words(rows, staged(word_counts(pages, text), "words"))
    model = fit(rows.filter("verdict is not null"), words)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def log_odds(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = shared.value
        for split, paths in columns:
            yield pd.Series([own.prior + float(own.odds[_buckets(_host_tokens(words) + _path_tokens(path))].sum()) for words, path in zip(split, paths)], dtype=float)

    # Every host has its words; a host that very many pages share is split at run time.
    scored = rows.join(words, "host").withColumn("log_odds", log_odds("words", "path"))
    by_model = F.when(F.col("log_odds") >= 0, F.lit("allow")).otherwise(F.lit("block"))
    return scored.select("_row.*", "host", "path", "rule", "log_odds", F.coalesce("verdict", by_model).alias("verdict"))
