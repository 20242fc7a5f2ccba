"""Dense, lexical and hybrid retrieval [R1-R3, W1-W4, T1, T2].

Cosine similarities of many vectors are matrix products over blocks of both sides, in tasks that Spark deals out; a block
keeps only what can matter outside it (a query's best chunks, a corpus's best score, links that join), before any shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.lexical_index import bm25
from lodestone.plans.ranking import kind, top_per

#: Rows of each side of a block of comparisons, and left rows whose similarities are held at a time.
BLOCK, STRIP = 4096, 256
#: Blocks of a side that meets itself, and rows of one, before there are more.
FEW, WIDE = 8, 32768


def _sizes(side) -> np.ndarray:
    return np.array([0 if v is None else len(v) for v in side], dtype=int)


def _units(side: pd.Series, at: np.ndarray) -> np.ndarray:
    """Unit vectors of the rows ``at``, of one length; zeros for zero norms and components that are not finite."""
    m = np.array([side.iloc[i] for i in at.tolist()], dtype=float)
    m[~np.isfinite(m).all(axis=1)] = 0
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def cosine_strips(left: pd.Series, right: pd.Series, digits: int | None = None, rows: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """[M2] place of the first row and cosines with every right vector of some left rows at a time, so no whole block of them is
    held; 0 for null and empty ones, unequal lengths, zero norms and components that are not finite."""
    rows = rows or STRIP
    sl, sr = _sizes(left), _sizes(right)
    sides = []
    for n in (set(sl.tolist()) & set(sr.tolist())) - {0}:
        i, j = np.flatnonzero(sl == n), np.flatnonzero(sr == n)
        sides.append((i, j, _units(left, i), _units(right, j)))
    for at in range(0, len(left), rows):
        out = np.zeros((min(rows, len(left) - at), len(right)))
        for i, j, u, v in sides:
            low, high = np.searchsorted(i, [at, at + rows])
            if len(j) == len(right):
                out[i[low:high] - at] = u[low:high] @ v.T
            else:
                out[np.ix_(i[low:high] - at, j)] = u[low:high] @ v.T
        yield at, out if digits is None else np.round(out, digits, out=out)


def block_cosines(left: pd.Series, right: pd.Series, digits: int | None = None) -> np.ndarray:
    """[M2] all of ``cosine_strips`` at once."""
    strips = [s for _, s in cosine_strips(left, right, digits)]
    return np.concatenate(strips) if strips else np.zeros((0, len(right)))


def blocks_of(df: DataFrame, wide: bool = False) -> int:
    """Blocks of BLOCK rows. With ``wide``, for a side that meets itself, where a row is sent once for each block: no more than FEW
    while they have at most WIDE rows, so that less is sent."""
    count = df.count()
    fine = max(1, -(-count // BLOCK))
    return min(fine, max(FEW, -(-count // WIDE))) if wide else fine


def by_blocks(queries: DataFrame, chunks: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` over every block of queries (qid, qvec) with every block of chunks (cid, cvec and others)."""
    nq, nc = blocks_of(queries), blocks_of(chunks)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("qid", "qvec", deal("qid", nq).alias("_q"), every(nc).alias("_c"))
    c = chunks.withColumn("_c", deal("cid", nc)).withColumn("_q", every(nq))
    none = lambda left, right: run(left, right) if len(left) and len(right) else pd.DataFrame(columns=[f.split()[0] for f in schema.split(", ")])
    return q.groupBy("_q", "_c").cogroup(c.groupBy("_q", "_c")).applyInPandas(none, schema)


def dense(queries: DataFrame, chunks: DataFrame, n: int, digits: int = 6) -> DataFrame:
    """[R1] qid, cid, sim, dense_rank of the n nearest chunks. ``queries``: qid, qvec; ``chunks``: cid, cvec. Exact: every
    pair is scored; a chunk with the query's own id counts too."""

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(c.cid.to_numpy(), kind="stable")  # places then rank ids, for ties
        cid, rows, qids = c.cid.to_numpy()[order], [], q.qid.tolist()
        for start, sims in cosine_strips(q.qvec, c.cvec.iloc[order], digits):
            for qid, s in zip(qids[start:], sims):
                least = np.partition(s, len(s) - n)[len(s) - n] if len(s) > n else -np.inf
                at = np.flatnonzero(s >= least)
                at = at[np.argsort(-s[at], kind="stable")][:n]
                rows += zip([qid] * len(at), cid[at].tolist(), s[at].tolist())
        return pd.DataFrame(rows, columns=["qid", "cid", "sim"])

    found = by_blocks(queries, chunks.select("cid", "cvec"), best, f"qid {kind(queries, 'qid')}, cid {kind(chunks, 'cid')}, sim double")
    return top_per(found, ["qid"], [F.desc("sim"), "cid"], n, "dense_rank")


def best_by_corpus(queries: DataFrame, chunks: DataFrame, digits: int = 6) -> DataFrame:
    """qid, corpus, sim: hits that hold each corpus's best similarity, for ``coverage.best_scores``. ``chunks``: cid, corpus, cvec.
    A chunk with the query's own id is left out."""

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for corpus, part in c.groupby("corpus"):
            cid = part.cid.to_numpy()
            for start, sims in cosine_strips(q.qvec, part.cvec, digits):
                qid = q.qid.to_numpy()[start : start + len(sims)]
                sims[qid[:, None] == cid[None, :]] = -np.inf
                top = sims.max(axis=1)
                at = np.flatnonzero(top > -np.inf)
                rows += zip(qid[at].tolist(), [corpus] * len(at), top[at].tolist())
        return pd.DataFrame(rows, columns=["qid", "corpus", "sim"])

    return by_blocks(queries, chunks.select("cid", "corpus", "cvec"), best, f"qid {kind(queries, 'qid')}, corpus string, sim double")


def fuse(dense_hits: DataFrame, lexical_hits: DataFrame, n: int, floor: float, k: int = 60) -> DataFrame:
    """[R3, J1, W3, F2, W4] reciprocal-rank fusion over the dense window; lexical hits outside it are left out. The floor
    is applied in fused order, so what is below takes no place. qid, cid, sim, fused, rank."""
    both = dense_hits.join(lexical_hits.select("qid", "cid", "lex_rank"), ["qid", "cid"], "left")
    fused = 1 / (F.lit(float(k)) + F.col("dense_rank") + 1) + F.coalesce(1 / (F.lit(float(k)) + F.col("lex_rank") + 1), F.lit(0.0))
    scored = both.withColumn("fused", F.round(fused, 8)).where(F.col("sim") >= floor)
    return top_per(scored, ["qid"], [F.desc("fused"), "dense_rank"], n).select("qid", "cid", "sim", "fused", "rank")


def hybrid(queries: DataFrame, chunks: DataFrame, n: int = 8, floor: float = 0.3, lexical: bool = True) -> DataFrame:
    """[R3] ``queries``: qid, text, qvec; ``chunks``: cid, text, cvec. Without the lexical leg, dense order."""
    window = max(3 * n, 12)
    near = dense(queries.select("qid", "qvec"), chunks.select("cid", "cvec"), window)
    if not lexical:
        hits = top_per(near.where(F.col("sim") >= floor), ["qid"], ["dense_rank"], n)
        return hits.select("qid", "cid", "sim", "rank")
    return fuse(near, bm25(queries.select("qid", "text"), chunks.select("cid", "text"), n), n, floor)
