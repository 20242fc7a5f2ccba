"""Pruned search against the exhaustive one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import clustering, retrieval, vector_index
from lodestone.plans.session import table


def hits(df):
    return sorted((r.qid, r.dense_rank, r.cid, r.sim) for r in df.collect())


@pytest.mark.parametrize("cell,block", [(40, 4096), (100, 30)])
def test_search_is_dense(spark, cell, block, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", block)
    e = table(spark, "/root/testdata/sf0.01", "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    c = e.select(F.col("vec_id").alias("cid"), F.col("v").alias("cvec"))
    q = e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("qid"), F.col("v").alias("qvec"))
    index = vector_index.build(c, cell=cell)
    assert hits(vector_index.search(index, q, 8)) == hits(retrieval.dense(q, c, 8))


def clustered(spark, n=600, dims=6, groups=12):
    rng = np.random.default_rng(1)
    mid = rng.normal(size=(groups, dims))
    v = [(mid[i % groups] + rng.normal(scale=0.05, size=dims)).tolist() for i in range(n)]
    odd = [None, [], [0.0] * dims, [1.0] * (dims + 1), [float("nan")] * dims, v[0], v[0]]
    return spark.createDataFrame(list(enumerate([*v, *odd])), "id bigint, vec array<double>")


def test_clustered_vectors_are_skipped_and_odd_ones_found(spark):
    df = clustered(spark)
    c, q = df.select(F.col("id").alias("cid"), F.col("vec").alias("cvec")), df.where("id % 20 = 0 or id >= 600").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    index = vector_index.build(c, cell=20)
    assert hits(vector_index.search(index, q, 5)) == hits(retrieval.dense(q, c, 5))
    assert hits(vector_index.search(index, q, 700)) == hits(retrieval.dense(q, c, 700))
    near = q.where("qid < 600")
    assert vector_index.skipped(index, near, 5).first().skipped > 0.5
    none = vector_index.build(c.where("cid < 0"))
    assert vector_index.search(none, q, 3).count() == 0


@pytest.mark.parametrize("least", [0.5, 0.95])
def test_pruned_links_join_the_same(spark, least, monkeypatch):
    df = clustered(spark)
    whole = {r.id: r.component for r in clustering.linked_components(df, least).collect()}
    monkeypatch.setattr(vector_index, "CELL", 20)
    monkeypatch.setattr(vector_index, "BLOCK", 16)
    assert {r.id: r.component for r in clustering.linked_components(df, least, pruned=True).collect()} == whole
    pairs = lambda p: sorted((r.i, r.j) for r in clustering.similar_pairs(df, least, pruned=p).select("i", "j").collect())
    assert pairs(True) == pairs(False)
    index = vector_index.build(df, "vec", "id")
    assert len(vector_index.near_cells(index, 0.95)) < 0.5 * len(vector_index.near_cells(index, 0.01))
