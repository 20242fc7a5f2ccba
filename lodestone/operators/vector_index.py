"""Exact vector search over a coarse index, pruned by angles [T1, T2, R1, J9].

Every vector belongs to the cell of its nearest centroid; centroids are a bounded sample of the vectors. A cell knows the
widest angle between its centroid and a member, so by the triangle inequality of angles no member of it is nearer to a
query than the query's angle to the centroid less that width. A query first meets the cells of its nearest centroids,
which gives it an n-th best similarity; then only cells that could reach it. Vectors stay where their cell is; queries
travel, each to the blocks that it cannot rule out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.retrieval import block_cosines
from lodestone.plans.ranking import kind, top_per
from lodestone.plans.shared import materialise

#: Vectors of a cell on average, the most centroids (their number bounds what the driver holds and broadcasts), and rows of a
#: block, into which larger cells are split.
CELL, MOST_CELLS, BLOCK = 1024, 1024, 4096
#: Room for rounding in similarities that are compared with bounds.
SLACK = 2e-6
#: The cell of vectors without a direction, and of other lengths than the sample's.
NONE = -1


def directions(vecs, dims: int) -> np.ndarray:
    """Unit vectors as rows; zeros for null ones, other lengths, zero norms and components that are not finite."""
    out = np.zeros((len(vecs), dims))
    at = [i for i, v in enumerate(vecs) if v is not None and len(v) == dims]
    if at:
        m = np.array([vecs[i] for i in at], dtype=float)
        m[~np.isfinite(m).all(axis=1)] = 0
        length = np.sqrt((m * m).sum(axis=1, keepdims=True))
        out[at] = np.divide(m, length, out=np.zeros_like(m), where=length > 0)
    return out


@dataclass
class Index:
    """``rows``: cell, block and the vectors' columns, written to the shared folder. Numbers of cells are small and on the driver."""

    rows: DataFrame
    vec: str
    centroids: np.ndarray
    width: np.ndarray
    blocks: np.ndarray
    none_blocks: int
    none_odd: bool

    def listed(self, cells) -> list[tuple[int, int]]:
        return [(c, b) for c in cells for b in range(self.none_blocks if c == NONE else int(self.blocks[c]))]

    def angles(self, vecs) -> np.ndarray:
        return np.arccos(np.clip(directions(vecs, self.centroids.shape[1]) @ self.centroids.T, -1, 1))

    @property
    def size(self) -> int:
        return int(self.blocks.sum()) + self.none_blocks


def build(vectors: DataFrame, vec: str = "cvec", key: str = "cid", cell: int | None = None, most: int | None = None) -> Index:
    """Index every row of ``vectors``. Centroids are the vectors of the smallest hashes of ``key``, one for ``cell`` rows and
    ``most`` at most."""
    cell, most = cell or CELL, most or MOST_CELLS
    count = vectors.count()
    k = max(1, min(most, -(-count // cell)))
    usable = vectors.where(F.col(vec).isNotNull() & (F.size(vec) > 0))
    sample = [r[0] for r in usable.select(vec, F.xxhash64(key).alias("h"), key).orderBy("h", key).limit(k).select(vec).collect()]
    dims = len(sample[0]) if sample else 0
    c = directions(sample, dims)
    c = c[np.abs(c).sum(axis=1) > 0] if len(c) else c.reshape(0, max(dims, 1))
    held = vectors.sparkSession.sparkContext.broadcast(c)

    def assign(batches):
        known = held.value
        for pdf in batches:
            u = directions(pdf[vec], known.shape[1])
            some = np.abs(u).sum(axis=1) > 0
            near = u @ known.T if len(known) else np.zeros((len(u), 1))
            at = np.where(some & (len(known) > 0), near.argmax(axis=1), NONE)
            angle = np.where(at >= 0, np.arccos(np.clip(near.max(axis=1), -1, 1)), 0.0)
            odd = [v is not None and 0 < len(v) != known.shape[1] for v in pdf[vec]]
            yield pdf.assign(cell=at.astype("int32"), angle=angle, odd=np.array(odd, dtype=bool) | (some & (at < 0)))

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    placed = materialise(vectors.mapInPandas(assign, f"{shape}, cell int, angle double, odd boolean"), "cells")
    cells = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("width"), F.max("odd").alias("odd")).collect()}
    blocks = np.array([-(-cells[i].n // BLOCK) if i in cells else 0 for i in range(len(c))], dtype=int)
    width = np.array([cells[i].width if i in cells else 0.0 for i in range(len(c))])
    none = cells.get(NONE)
    none_blocks = -(-none.n // BLOCK) if none else 0
    parts = F.element_at(F.array(*[F.lit(int(b)) for b in [*blocks, none_blocks]]), F.when(F.col("cell") < 0, len(c) + 1).otherwise(F.col("cell") + 1))
    rows = placed.withColumn("block", F.pmod(F.xxhash64(key), F.greatest(parts, F.lit(1))).cast("int")).drop("angle", "odd")
    return Index(rows, vec, c, width, blocks, none_blocks, bool(none and none.odd))


def visited(index: Index, queries: DataFrame, least: DataFrame | None, probes: int) -> DataFrame:
    """qid, qvec, cell, block: without ``least`` the cells of a query's ``probes`` nearest centroids; with it (qid, least) the others
    that may hold a similarity of ``least``."""
    schema = f"qid {kind(queries, 'qid')}, qvec {kind(queries, 'qvec')}, cell int, block int"
    spark = queries.sparkSession
    held = spark.sparkContext.broadcast(index_numbers := (index.centroids, index.width, index.blocks, index.none_blocks, index.none_odd))
    del index_numbers

    def run(batches):
        centroids, width, blocks, none_blocks, none_odd = held.value
        own = Index(None, "", centroids, width, blocks, none_blocks, none_odd)
        for pdf in batches:
            angle = own.angles(pdf.qvec) if len(centroids) else np.zeros((len(pdf), 0))
            lost = np.abs(directions(pdf.qvec, centroids.shape[1])).sum(axis=1) == 0
            order = np.argsort(angle, axis=1, kind="stable")[:, :probes]
            out = []
            for i in range(len(pdf)):
                first = order[i].tolist()
                if "least" not in pdf:
                    cells = first
                else:
                    least = -2.0 if np.isnan(pdf.least.iloc[i]) else pdf.least.iloc[i] - SLACK
                    bound = np.zeros(len(width)) if lost[i] else np.cos(np.maximum(0.0, angle[i] - width))
                    far = set(first)
                    cells = [c for c in np.flatnonzero(bound >= least).tolist() if c not in far]
                    # a query of another length may be near to rows of that length
                    if none_blocks and (none_odd or least <= 0):
                        cells.append(NONE)
                out += [(pdf.qid.iloc[i], pdf.qvec.iloc[i], c, b) for c, b in own.listed(cells)]
            yield pd.DataFrame(out, columns=["qid", "qvec", "cell", "block"])

    rows = queries.select("qid", "qvec") if least is None else queries.select("qid", "qvec").join(least, "qid", "left")
    return rows.mapInPandas(run, schema)


def met(index: Index, asked: DataFrame, n: int, digits: int) -> DataFrame:
    """qid, cid, sim: the n best rows of each block that a query visits."""

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(q) and len(c):
            c = c.sort_values("cid", kind="stable")
            cid = c.cid.to_numpy()
            for at in range(0, len(q), 256):
                part = q.iloc[at : at + 256]
                for qid, s in zip(part.qid.tolist(), block_cosines(part.qvec, c.cvec, digits)):
                    least = np.partition(s, len(s) - n)[len(s) - n] if len(s) > n else -np.inf
                    top = np.flatnonzero(s >= least)
                    top = top[np.argsort(-s[top], kind="stable")][:n]
                    rows += zip([qid] * len(top), cid[top].tolist(), s[top].tolist())
        return pd.DataFrame(rows, columns=["qid", "cid", "sim"])

    chunks = index.rows.select("cell", "block", "cid", "cvec")
    keys = ["cell", "block"]
    return asked.groupBy(*keys).cogroup(chunks.groupBy(*keys)).applyInPandas(best, f"qid {kind(asked, 'qid')}, cid {kind(chunks, 'cid')}, sim double")


def search(index: Index, queries: DataFrame, n: int, digits: int = 6, probes: int = 2) -> DataFrame:
    """[R1, T2] qid, cid, sim, dense_rank: each query's n nearest rows, ties to the smaller id, equal to ``retrieval.dense``.
    ``queries``: qid, qvec; the index is over cid, cvec."""
    first = materialise(met(index, visited(index, queries, None, probes), n, digits), "first-hits")
    ranked = top_per(first, ["qid"], [F.desc("sim"), "cid"], n, "place")
    least = ranked.where(F.col("place") == n - 1).select("qid", F.col("sim").alias("least"))
    more = met(index, visited(index, queries, least, probes), n, digits)
    return top_per(first.union(more), ["qid"], [F.desc("sim"), "cid"], n, "dense_rank")


def skipped(index: Index, queries: DataFrame, n: int, digits: int = 6, probes: int = 2) -> DataFrame:
    """One row: visits (of a query to a block), all there could be, and the share that the bounds rule out."""
    once = visited(index, queries, None, probes)
    ranked = top_per(met(index, once, n, digits), ["qid"], [F.desc("sim"), "cid"], n, "place")
    least = ranked.where(F.col("place") == n - 1).select("qid", F.col("sim").alias("least"))
    both = once.select("qid").union(visited(index, queries, least, probes).select("qid")).agg(F.count("*").alias("visits"))
    every = queries.agg((F.count("*") * index.size).alias("all_visits"))
    return both.crossJoin(every).select("visits", "all_visits", F.round(1 - F.col("visits") / F.col("all_visits"), 4).alias("skipped"))


def near_cells(index: Index, least: float) -> list[tuple[int, int]]:
    """Pairs of cells (first <= second) that may hold a pair of a similarity of ``least``."""
    between = np.arccos(np.clip(index.centroids @ index.centroids.T, -1, 1))
    nearest = np.maximum(0.0, between - index.width[:, None] - index.width[None, :])
    some = index.blocks > 0
    pairs = np.triu(np.cos(nearest) >= least - SLACK) & some[:, None] & some[None, :]
    return list(zip(*(x.tolist() for x in np.nonzero(pairs))))


def block_pairs(index: Index, least: float) -> DataFrame:
    """The index's rows (id, vec) dealt to the pairs of blocks that may hold a pair of a similarity of ``least`` (above 0): _i, _j,
    _side as ``clustering.vector_blocks`` has them. A row is sent once for each block that its own cannot rule out."""
    starts = np.concatenate([[0], np.cumsum(index.blocks)])
    pairs = []
    for a, b in near_cells(index, least):
        for i in range(int(index.blocks[a])):
            for j in range(i if a == b else 0, int(index.blocks[b])):
                pairs.append((int(starts[a]) + i, int(starts[b]) + j))
    sides = [(i, i, j, 2 if i == j else 0) for i, j in pairs] + [(j, i, j, 1) for i, j in pairs if i != j]
    spark = index.rows.sparkSession
    listed = spark.createDataFrame(sides or [(-1, -1, -1, -1)], "_own int, _i int, _j int, _side int")
    first = F.element_at(F.array(*[F.lit(int(s)) for s in starts]), F.col("cell") + 1)
    rows = index.rows.where("cell >= 0").select("id", F.col(index.vec).alias("vec"), (first + F.col("block")).cast("int").alias("_own"))
    return rows.join(F.broadcast(listed), "_own").select("id", "vec", "_i", "_j", "_side")
