"""Greedy average linkage in rounds against the sequential fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import clustering, retrieval
from lodestone.plans.session import table


def fold(vectors: dict[int, list[float]], least: float) -> dict[int, int]:
    """The sequential form: the first pair of the highest mean similarity is merged while that is ``least`` or more."""
    ids = sorted(vectors)
    v = np.array([np.array(vectors[i], dtype=float) / np.linalg.norm(vectors[i]) for i in ids])
    sums, members = v @ v.T, [[i] for i in ids]
    sizes = np.ones(len(ids))
    while len(members) > 1:
        mean = np.round(sums / np.outer(sizes, sizes), 12)
        mean[np.tril_indices(len(members))] = -np.inf
        i, j = divmod(int(mean.argmax()), len(members))
        if mean[i, j] < least:
            break
        members[i] += members.pop(j)
        sums[i] += sums[j]
        sums[:, i] += sums[:, j]
        sums = np.delete(np.delete(sums, j, 0), j, 1)
        sizes[i] += sizes[j]
        sizes = np.delete(sizes, j)
    return {i: min(m) for m in members for i in m}


def rounds(spark, vectors, least):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in vectors.items()]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>")
    return {r.id: r.cluster for r in clustering.cluster(df, least).collect()}


@pytest.mark.parametrize("block", [4096, 200])
@pytest.mark.parametrize("least", [0.40, 0.35])
def test_clusters_of_the_table_are_the_folds(spark, least, block, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    rows = table(spark, "/root/testdata/sf0.01", "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    want = fold({r.id: r.vec for r in rows.collect()}, least)
    assert {r.id: r.cluster for r in clustering.cluster(rows, least).collect()} == want
    assert max(list(want.values()).count(c) for c in want.values()) > 2


def test_ties_copies_and_chains(spark):
    grid = {i: [1.0, float(i % 4), float(i % 3)] for i in range(40)}  # many equal vectors and equal similarities
    assert rounds(spark, grid, 0.9) == fold(grid, 0.9)
    ring = {i: [float(np.cos(i * np.pi / 6)), float(np.sin(i * np.pi / 6))] for i in range(12)}  # every neighbour is as near as the other
    assert rounds(spark, ring, 0.5) == fold(ring, 0.5)
    two = {1: [1.0, 0, 0], 2: [0.98, 0.2, 0], 3: [0, 0, 1.0]}
    assert rounds(spark, two, 0.75) == {1: 1, 2: 1, 3: 3}
    assert rounds(spark, {1: [1.0, 0.0], 2: [0.5, 0.86]}, 0.9) == {1: 1, 2: 2}


def test_vectors_without_direction_stay_alone(spark):
    odd = {1: None, 2: [], 3: [0.0, 0.0], 4: [float("nan"), 1.0], 5: [1.0, None], 6: [1.0, 1.0], 7: [2.0, 2.0], 8: [-0.0, 1.0], 9: [0.0, 2.0]}
    assert rounds(spark, odd, 0.99) == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 8}
    assert rounds(spark, {}, 0.5) == {}


def test_no_task_gets_a_component(spark, monkeypatch):
    """A component of 400 vectors is worked on in blocks; each gives at most a row for a cluster."""
    monkeypatch.setattr(retrieval, "BLOCK", 50)
    rng = np.random.default_rng(3)
    v = {i: (np.array([1.0, 0, 0, 0]) + rng.normal(0, 0.3, 4)).tolist() for i in range(400)}
    df = spark.createDataFrame([(i, 1, x) for i, x in v.items()], "id bigint, n bigint, vec array<double>")
    sizes = clustering.vector_blocks(df, "n").groupBy("_i", "_j").count().agg(F.max("count")).first()[0]
    assert sizes < 160 and clustering.nearest(df, -1.0).count() == 400
    assert rounds(spark, v, 0.8) == fold(v, 0.8)


def test_the_nearest_search_equals_brute_force(monkeypatch):
    """Even, tied and nearly equal vectors; strips and tiles of few rows; with and without places that need no search."""
    rng = np.random.default_rng(1)
    for case in range(36):
        strip, tile, held = [(256, 2048, 1 << 20), (7, 11, 5), (16, 8, 100)][case // 3 % 3]
        for name, value in (("STRIP", strip), ("TILE", tile), ("HELD", held)):
            monkeypatch.setattr(clustering, name, value)
        shape = int(rng.integers(2, 120)), int(rng.integers(1, 9))
        v = (rng.integers(1, 3, shape).astype(float), rng.normal(size=shape), 1 + 1e-7 * rng.normal(size=shape))[case % 3]
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        n = rng.integers(1, 4, len(v)).astype(float)
        v, ids, known = v * n[:, None], rng.permutation(3 * len(v))[: len(v)], np.sort(rng.random(len(v)) < rng.choice([0, 0.5, 0.9]))
        side = rng.random(len(v)) < 0.5
        left, right = (np.flatnonzero(side), np.flatnonzero(~side)) if case % 2 else [np.arange(len(v))] * 2
        least = (-1.0, 0.4, 0.9)[case // 9 % 3]
        sims, want = np.round(v @ v.T / np.outer(n, n), 12), {}
        for x in np.flatnonzero(~known).tolist():
            others = [y for y in range(len(v)) if y != x and (left is right or side[x] != side[y]) and sims[x, y] >= least]
            if others:
                want[x] = min(others, key=lambda y: (-sims[x, y], ids[y]))
        at, to, found = clustering.near_places(ids, n, v, known, left, right, least)
        assert dict(zip(at.tolist(), to.tolist())) == want
        assert np.allclose(found, [sims[x, y] for x, y in want.items()], atol=1e-11)


def test_only_changed_clusters_are_searched_and_the_last_rounds_are_one_task(spark, monkeypatch):
    """A chain of ever nearer pairs took a written round for each link; 300 vectors were all compared again in each round."""
    angles = np.cumsum([0.30 * 0.97**k for k in range(40)])
    chain = {i: [float(np.cos(a)), float(np.sin(a))] for i, a in enumerate(angles)}
    searched, nearest = [], clustering.nearest
    monkeypatch.setattr(clustering, "nearest", lambda c, least: searched.append(c.groupBy("known").count().collect()) or nearest(c, least))
    assert rounds(spark, chain, 0.5) == fold(chain, 0.5) and not searched
    rng = np.random.default_rng(5)
    v = {i: (np.array([1.0, 0, 0, 0]) + rng.normal(0, 0.4, 4)).tolist() for i in range(300)}
    monkeypatch.setattr(retrieval, "BLOCK", 60)
    assert rounds(spark, v, 0.8) == fold(v, 0.8)
    counts = [{r.known: r["count"] for r in s} for s in searched]
    assert len(counts) > 1 and counts[0] == {False: 300} and all(c.get(True, 0) > 0 for c in counts[1:])
