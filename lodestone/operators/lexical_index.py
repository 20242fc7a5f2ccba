"""BM25 over persisted inverted lists with block maxima [R2, W2, M4].

The corpus is tokenised once: each Arrow batch of chunks is a block, whose lists of a word are made inside the task, so no
(chunk, word) row is shuffled. With the whole corpus's counts known, every list gets its entries' impacts (what BM25 makes
of frequency and length) and the largest of them; lists are written sorted by word, so a query reads few row groups.

A query's bound in a block is the sum of its words' weights times their largest impacts there. The blocks of the highest
bounds are scored first; the n-th best score found rules out all blocks whose bound is below it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokenize
from lodestone.plans.ranking import kind, top_per
from lodestone.plans.shared import materialise, shared_dir, text_batches

#: Blocks that a query scores first, and room for rounding where scores are compared with bounds.
FIRST, SLACK = 2, 2e-6
#: Queries that meet a block's lists in one group.
QUERIES = 4096
WORD = re.compile("[a-z0-9]+")


@dataclass
class LexicalIndex:
    """``lists``: word, block, top, cids, impacts; ``terms``: word, df, idf. Both are tables below ``path``."""

    path: str
    lists: DataFrame
    terms: DataFrame

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LexicalIndex:
        """An index that ``build`` wrote."""
        return cls(path, spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/terms"))


def postings(chunks: DataFrame) -> DataFrame:
    """block, word, cids, tfs, dls of every word of a block; a null word lists all chunks that have a text."""
    text_batches(chunks.sparkSession)
    cid = kind(chunks, "cid")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for number, b in enumerate(batches):
            here = [i for i, low in enumerate(b.column(1).to_pylist()) if low is not None]
            found = [WORD.findall(low) for low in b.column(1).take(pa.array(here, pa.int64())).to_pylist()]
            dl = np.array([len(f) for f in found], dtype=np.int64)
            words = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
            code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            n = max(len(here), 1)
            entry, tf = np.unique(code * n + np.repeat(np.arange(len(here)), dl), return_counts=True)
            word, at = entry // n, entry % n
            # the null word's list of all texts goes first, then the words' lists in order of their codes
            ends = np.concatenate([[0, len(here)], len(here) + np.append(np.flatnonzero(word[1:] != word[:-1]) + 1, len(word))[: len(words.dictionary)]])
            at = np.concatenate([np.arange(len(here)), at])
            lists = lambda values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)  # noqa: B023, E731
            named = pa.concat_arrays([pa.array([None], pa.string()), words.dictionary])
            cids = b.column(0).take(pa.array(np.array(here, dtype=np.int64)[at], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(named), part + number)), named, lists(cids), lists(pa.array(np.concatenate([np.zeros(len(here), dtype=np.int64), tf]))), lists(pa.array(dl[at]))], names=["block", "word", "cids", "tfs", "dls"])

    return chunks.select("cid", F.lower("text").alias("low")).mapInArrow(run, f"block bigint, word string, cids array<{cid}>, tfs array<bigint>, dls array<bigint>")


def build(chunks: DataFrame, path: str | None = None, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> LexicalIndex:
    """Index ``chunks`` (cid, a key; text) below ``path``, a folder that executors share and that holds no index yet; without one the
    index is a pair of temporary tables. Null texts hold no word but count as chunks."""
    spark = chunks.sparkSession
    raw = materialise(postings(chunks), "postings")
    length = raw.where("word is null").agg(F.sum(F.aggregate("dls", F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("words"), F.sum(F.size("dls")).alias("texts"))
    # one row each: the corpus's size, and later the mean of the inverse frequencies
    sizes = length.crossJoin(F.broadcast(chunks.agg(F.count("*").alias("n")))).select("n", F.try_divide("words", "texts").alias("avgdl"))
    df = raw.where("word is not null").groupBy("word").agg(F.sum(F.size("cids")).cast("bigint").alias("df"))
    terms = materialise(df.crossJoin(F.broadcast(sizes)).select("word", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "terms")
    mean = terms.agg(F.avg("idf").alias("mean"))
    weighed = terms.crossJoin(F.broadcast(mean)).select("word", "df", F.when(F.col("idf") < 0, epsilon * F.col("mean")).otherwise(F.col("idf")).alias("idf"))
    part = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))
    scored = raw.where("word is not null").crossJoin(F.broadcast(sizes)).select("word", "block", "cids", F.zip_with("tfs", "dls", part).alias("impacts"))
    lists = scored.select("word", "block", F.array_max("impacts").alias("top"), "cids", "impacts").repartitionByRange("word", "block").sortWithinPartitions("word", "block")
    if path is None:
        return LexicalIndex(shared_dir(spark), materialise(lists, "lists"), materialise(weighed, "weights"))
    lists.write.parquet(f"{path}/lists")
    weighed.write.parquet(f"{path}/terms")
    return LexicalIndex.open(spark, path)


def asked_of(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """qid, word, weight: a query's repeated words count each time. ``queries``: qid, text."""
    asked = queries.select("qid", F.explode(tokenize(F.col("text"))).alias("word")).groupBy("qid", "word").agg(F.count("*").alias("times"))
    return asked.join(index.terms.select("word", "idf"), "word").select("qid", "word", (F.col("times") * F.col("idf")).alias("weight"))


def bounds(index: LexicalIndex, asked: DataFrame) -> DataFrame:
    """qid, block, bound: no chunk of the block scores more for the query."""
    tops = asked.join(index.lists.select("word", "block", "top"), "word")
    return tops.groupBy("qid", "block").agg(F.sum(F.greatest(F.col("weight") * F.col("top"), F.lit(0.0))).alias("bound"))


def scores(index: LexicalIndex, asked: DataFrame, visits: DataFrame, n: int, digits: int = 6) -> DataFrame:
    """qid, cid, score above 0 of each query's ``n`` best chunks in every block that it visits (qid, block), ties to the smaller id. A
    block adds its lists up in its task and passes on ``n`` rows for a query, so hits are not shuffled."""
    parts = -(-asked.select("qid").distinct().count() // QUERIES) or 1
    part = F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int")
    unit = 10.0**digits

    def best(a: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(held):
            sizes = held.cids.map(len).to_numpy()
            cids, code = np.unique(np.concatenate(held.cids.to_list()), return_inverse=True)
            ends = np.cumsum(sizes)
            place = {w: (code[e - s : e], impacts) for w, s, e, impacts in zip(held.word, sizes, ends, held.impacts)}
            for qid, words, weights in zip(a.qid.tolist(), a.words, a.weights):
                sums = np.zeros(len(cids))
                for w, weight in zip(words, weights):
                    if w in place:
                        at, impacts = place[w]
                        sums[at] += weight * impacts
                sums = np.floor(sums * unit + 0.5) / unit
                at = np.flatnonzero(sums > 0)
                if len(at) > n:
                    at = at[sums[at] >= np.partition(sums[at], len(at) - n)[len(at) - n]]
                at = at[np.argsort(-sums[at], kind="stable")][:n]  # ids are in order
                out += zip([qid] * len(at), cids[at].tolist(), sums[at].tolist())
        return pd.DataFrame(out, columns=["qid", "cid", "score"])

    terms = asked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("word", "weight"))).alias("terms"))
    asks = terms.join(visits.select("qid", "block"), "qid").select("block", part.alias("part"), "qid", F.col("terms.word").alias("words"), F.col("terms.weight").alias("weights"))
    wanted = index.lists.join(asked.select("word").distinct(), "word", "left_semi").join(visits.select("block").distinct(), "block", "left_semi")
    held = wanted.select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "word", "cids", "impacts")
    keys = ["block", "part"]
    schema = f"qid {kind(asked, 'qid')}, cid {index.lists.schema['cids'].dataType.elementType.simpleString()}, score double"
    return asks.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(best, schema)


def plan(index: LexicalIndex, queries: DataFrame, n: int, first: int = FIRST) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The weights, all bounds, the hits of the first blocks and the blocks that those do not rule out."""
    asked = materialise(asked_of(index, queries), "asked")
    ranked = materialise(bounds(index, asked).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "block")) - 1), "bounds")
    found = materialise(scores(index, asked, ranked.where(F.col("place") < first), n), "first-scores")
    least = top_per(found, ["qid"], [F.desc("score"), "cid"], n, "at").where(F.col("at") == n - 1).select("qid", F.col("score").alias("least"))
    rest = ranked.where(F.col("place") >= first).join(least, "qid", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - SLACK)
    return asked, ranked, found, rest


def search(index: LexicalIndex, queries: DataFrame, n: int, first: int = FIRST) -> DataFrame:
    """[R2] qid, cid, score, lex_rank of each query's n best chunks with a score above 0, ties to the smaller id."""
    asked, _, found, rest = plan(index, queries, n, first)
    return top_per(found.union(scores(index, asked, rest, n)), ["qid"], [F.desc("score"), "cid"], n, "lex_rank")


def skipped(index: LexicalIndex, queries: DataFrame, n: int, first: int = FIRST) -> DataFrame:
    """One row: blocks that hold a word of a query, those visited, and the share that the bounds rule out."""
    _, ranked, _, rest = plan(index, queries, n, first)
    seen = ranked.where(F.col("place") < first).select("qid").union(rest.select("qid")).agg(F.count("*").alias("visits"))
    return seen.crossJoin(ranked.agg(F.count("*").alias("all_visits"))).select("visits", "all_visits", F.round(1 - F.col("visits") / F.col("all_visits"), 4).alias("skipped"))


def bm25(queries: DataFrame, chunks: DataFrame, n: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """[R2] qid, cid, score, lex_rank: Okapi scores above 0, by an index of its own. ``queries``: qid, text; ``chunks``: cid, text.

    Counts are of the whole corpus. Words with a negative inverse frequency get ``epsilon`` times the mean one.
    """
    return search(build(chunks, None, k1, b, epsilon), queries, n)
