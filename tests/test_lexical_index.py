"""BM25 by pruned inverted lists against the formula."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import lexical_index, retrieval
from lodestone.plans.shared import TEXT_BATCH_ROWS, materialise


def okapi(queries, chunks, n):
    words = {c: re.findall("[a-z0-9]+", t.lower()) for c, t in chunks if t is not None}
    avgdl = sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: math.log((len(chunks) - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in idf.items()}
    out = []
    for qid, text in queries:
        scored = []
        for c, ws in words.items():
            tf = Counter(ws)
            s = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / avgdl)) for w in re.findall("[a-z0-9]+", (text or "").lower()) if w in tf)
            if round(s, 6) > 0:
                scored.append((-round(s, 6), c))
        out += [(qid, i, c, -s) for i, (s, c) in enumerate(sorted(scored)[:n])]
    return out


def hits(df):
    return sorted((r.qid, r.lex_rank, r.cid, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"w{i % 7} w{i % 11} common " + "rare " * (i == 300) + f"u{i}") for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "Common COMMON, w3!"), (1003, "..."), (1004, "rare " * 40)]
    asked = [(1, "rare w3"), (2, "common common w1 w2"), (3, "nothing"), (4, None), (5, "u17 u18 u19"), (6, "")]
    return rows, asked


@pytest.mark.parametrize("batch,n", [(7, 5), (7, 2000), (500, 3)])
def test_search_is_okapi(spark, corpus, batch, n):
    rows, asked = corpus
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(batch))
    try:
        got = hits(retrieval.bm25(spark.createDataFrame(asked, "qid int, text string"), spark.createDataFrame(rows, "cid bigint, text string"), n))
    finally:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))
    want = okapi(asked, rows, n)
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert all(abs(g[3] - w[3]) < 1e-5 for g, w in zip(got, sorted(want)))


def test_a_block_passes_on_the_best_only(spark, corpus, monkeypatch):
    rows, asked = corpus
    index = lexical_index.build(spark.createDataFrame(rows, "cid bigint, text string"))
    q = lexical_index.asked_of(index, spark.createDataFrame(asked, "qid int, text string"))
    visits = materialise(lexical_index.bounds(index, q).select("qid", "block"), "visits")
    for parts in (4096, 1):  # all queries in one group, and one in each
        monkeypatch.setattr(lexical_index, "QUERIES", parts)
        got = lexical_index.scores(index, q, visits, 2)
        assert got.count() <= 2 * visits.count()
        best = {x.qid: x.score for x in got.groupBy("qid").agg(F.max("score").alias("score")).collect()}
        want = {}
        for w in okapi(asked, rows, 1):
            want[w[0]] = w[3]
        assert best.keys() == want.keys() and all(abs(best[k] - want[k]) < 1e-5 for k in best)


def test_index_is_persisted_and_skips_blocks(spark, corpus, tmp_path):
    rows, asked = corpus
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10")
    try:
        lexical_index.build(spark.createDataFrame(rows, "cid bigint, text string"), str(tmp_path / "index"))
    finally:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))
    index = lexical_index.LexicalIndex.open(spark, str(tmp_path / "index"))
    q = spark.createDataFrame(asked[:2], "qid int, text string")
    assert [h[:3] for h in hits(lexical_index.search(index, q, 4))] == [w[:3] for w in sorted(okapi(asked[:2], rows, 4))]
    assert lexical_index.skipped(index, q.where("qid = 1"), 1, first=1).first().skipped > 0.5
    assert index.lists.where(F.col("word").isNull()).count() == 0


def test_empty_corpus(spark):
    q = spark.createDataFrame([(1, "a")], "qid int, text string")
    assert retrieval.bm25(q, spark.createDataFrame([], "cid bigint, text string"), 3).count() == 0
    assert retrieval.bm25(q, spark.createDataFrame([(1, None)], "cid bigint, text string"), 3).count() == 0
