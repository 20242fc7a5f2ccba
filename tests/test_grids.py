"""Threshold grids and vector aggregates against plain loops, and the plans they must have."""

import contextlib
import io
import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import clustering, coverage

CASES = "expected string, policy double, legal double"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def label(p, q, tp, tq):
    meets = lambda s, t: s is not None and not math.isnan(s) and s >= t
    return {(True, True): "covered", (False, True): "legal_only", (True, False): "policy_only", (False, False): "uncovered"}[meets(p, tp), meets(q, tq)]


def test_grid_by_brute_force(spark):
    rng = random.Random(8)
    taus = [0.1, 0.25, 0.4, 0.55, 0.7]
    score = lambda: rng.choice([None, float("nan"), -1.0, 2.0, *taus, rng.random(), rng.random()])
    rows = [(rng.choice([*coverage.CLASSES, *coverage.CLASSES, "other", None]), score(), score()) for _ in range(400)]
    rows += rows[:50]
    records = spark.createDataFrame(rows, CASES).withColumn("a", F.lit(1)).withColumn("n", F.lit("x"))
    grid = spark.createDataFrame([(t,) for t in [*taus, 0.4, None]], "tau double")
    want = {(tp, tq): sum(e == label(p, q, tp, tq) for e, p, q in rows) for tp, tq in itertools.product(taus, taus)}
    judged = sum(e is not None for e, _, _ in rows)
    got = coverage.grid_counts(records, grid).collect()
    assert {(r.tau_policy, r.tau_legal): r.correct for r in got} == want and len(got) == 25
    assert {(r.judged, r.total) for r in got} == {(judged, len(rows))}
    one = {r.tau: (r.accuracy, r.correct, r.total) for r in coverage.sweep(records, grid).collect()}
    assert one == {t: (round(want[t, t] / judged, 6), want[t, t], len(rows)) for t in taus}
    best = coverage.best_pair(records, grid).collect()
    first = min(want, key=lambda k: (-want[k], k))
    assert [(r.tau_policy, r.tau_legal) for r in best] == [first]


def test_grid_edges(spark):
    grid = spark.createDataFrame([(0.5,)], "tau double")
    assert coverage.grid_counts(spark.createDataFrame([], CASES), grid).collect() == []
    assert coverage.grid_counts(spark.createDataFrame([("covered", 1.0, 1.0)], CASES), grid.limit(0)).collect() == []
    assert [(r.accuracy, r.total) for r in coverage.sweep(spark.createDataFrame([(None, 1.0, None)], CASES), grid).collect()] == [(None, 1)]


def test_grid_reads_records_once(spark):
    records = spark.createDataFrame([("covered", 1.0, 1.0)], CASES)
    text = plan(coverage.best_pair(records, coverage.grid(spark)))
    assert "NestedLoop" not in text and "Cartesian" not in text


VECTORS = "g string, id bigint, vec array<float>"


def test_vector_aggregates_by_loops(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{i % 3}", i, rng.normal(size=5).round(2).tolist()) for i in range(40)]
    rows += [("g0", 40, [0.0] * 5), ("g1", 41, None), ("g1", 42, []), ("g2", 43, [1.0, None, 3.0, None, None]), ("g2", 44, [2.0, 1.0]), ("g2", 44, [2.0, 1.0]), ("only", 45, [3.0, 4.0]), ("none", 46, None), (None, 47, [1.0, 0.0]), ("nulls", 48, [None, None]), ("nulls", 49, [None, 1.0])]
    df = spark.createDataFrame(rows, VECTORS).withColumn("_v", F.lit(1)).withColumn("sums", F.lit("x"))
    groups = {}
    for g, _, v in rows:
        if v:
            groups.setdefault(g, []).append([None if x is None else float(np.float32(x)) for x in v])
    got = {r.g: r.centroid for r in clustering.centroids(df, "g", digits=4).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        for at in range(max(map(len, vs))):
            held = [v[at] for v in vs if len(v) > at and v[at] is not None]
            assert got[g][at] is None if not held else abs(got[g][at] - sum(held) / len(held)) < 1e-4
    near = {r.g: (r.intra_sim, r.members) for r in clustering.intra_similarity(df, "g").collect()}
    for g, vs in groups.items():
        full = np.array([[x or 0.0 for x in v] + [0.0] * (5 - len(v)) for v in vs])
        norms = np.linalg.norm(full, axis=1, keepdims=True)
        unit = np.divide(full, norms, out=np.zeros_like(full), where=norms > 0)
        sims = unit @ unit.T
        want = 1.0 if len(vs) == 1 else sims[np.triu_indices(len(vs), 1)].mean()
        assert near[g][1] == len(vs) and abs(near[g][0] - want) < 1e-9


def test_vector_aggregates_add_whole_vectors(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 2.0])], VECTORS)
    for made in (clustering.centroids(df, "g"), clustering.intra_similarity(df, "g")):
        assert "Generate" not in plan(made) and "Window" not in plan(made)
    assert clustering.centroids(df.limit(0), "g").collect() == []
