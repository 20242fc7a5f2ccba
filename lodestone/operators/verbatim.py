"""Quotes that stand word for word in sources [X3, X4, R5], by an inverted index over word runs instead of all pairs.

A quote's inner words stand between spaces wherever it occurs, so a source that holds the quote holds its run of inner
words. Runs of sources meet the quotes' runs in an equi-join of hashes; only what meets is compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import is_verbatim, normalize, verbatim_span

#: Words of the longest run that is looked up.
RUN = 5
#: Quotes of one or two words that a source is tested for at a time; they have no inner word to look up.
SHORT_BLOCK = 1000


def words_of(c) -> Column:
    return F.filter(F.split(F.lower(normalize(c)), " "), lambda w: w != "")


def run_length(words: Column) -> Column:
    return F.least(F.size(words) - 2, F.lit(RUN))


def runs_of(words: Column, n: int) -> Column:
    """A hash, n included, of every run of ``n`` words; null where there are fewer."""
    run = lambda i: F.xxhash64(F.lit(n), F.slice(words, i, n))
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), run))


def candidates(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """qid and sid of pairs that may match. ``quotes``: qid, quote; ``sources``: sid, text. Null and empty sides never do."""
    q = quotes.select("qid", "quote", words_of(F.col("quote")).alias("words")).where(F.size("words") > 0).withColumn("n", run_length(F.col("words")))
    keys = q.where("n > 0").select("qid", "n", F.xxhash64("n", F.slice("words", F.lit(2), F.col("n"))).alias("run"))
    lengths = sorted(r.n for r in keys.select("n").distinct().collect())  # at most RUN values
    empty = F.array().cast("array<bigint>")
    # distinct over plain integers goes by hash; over structs Spark compares all with all
    every = F.array_distinct(F.concat(empty, *[F.coalesce(runs_of(F.col("words"), n), empty) for n in lengths]))
    held = sources.select("sid", words_of(F.col("text")).alias("words")).select("sid", F.explode(every).alias("run"))
    met = held.join(keys, "run").select("qid", "sid")
    short = q.where("n <= 0").select("qid", F.lower(normalize("quote")).alias("quote"))
    blocks = -(-short.count() // SHORT_BLOCK)
    if blocks:
        block = F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")
        asked = short.groupBy(block.alias("b")).agg(F.collect_list(F.struct("qid", "quote")).alias("asked"))
        low = sources.select("sid", F.lower(normalize("text")).alias("low"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
        tested = low.join(asked, "b").select("sid", F.explode(F.filter("asked", lambda a: F.col("low").contains(a["quote"]))).alias("q"))
        met = met.union(tested.select("q.qid", "sid"))
    return met.distinct()


def verbatim_pairs(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """qid, sid, quote, text of every quote that stands word for word in a source."""
    both = candidates(quotes, sources).join(quotes.select("qid", "quote"), "qid").join(sources.select("sid", "text"), "sid")
    return both.where(is_verbatim(F.col("quote"), F.col("text")))


def verbatim_spans(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """qid, sid, start and end of each quote's first place in the raw text."""
    found = verbatim_pairs(quotes, sources).withColumn("s", verbatim_span(F.col("quote"), F.col("text")))
    return found.select("qid", "sid", "s.start", "s.end")
