"""Evidence-gated clusters of gap inputs [G1-G4, J5-J7, J9, A6-A9, K7]."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import vector
from lodestone.functions.records import histogram
from lodestone.functions.text import member_key
from lodestone.operators import retrieval, vector_index
from lodestone.operators.retrieval import STRIP, blocks_of, cosine_strips
from lodestone.plans.components import components
from lodestone.plans.numbering import numbered
from lodestone.plans.shared import materialise, release

#: Right rows whose similarities to STRIP left ones are held at a time in linkage.
TILE = 2048
#: Pairs that are held until they are computed in full.
HELD = 1 << 20


def vector_blocks(vectors: DataFrame, *more: str) -> DataFrame:
    """``vectors`` (id, vec and ``more``) dealt to pairs of blocks _i <= _j; _side is 0 on the left, 1 on the right, 2 where both blocks are one."""
    n = blocks_of(vectors, wide=True)
    own = vectors.select("id", "vec", *more, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return own.select("id", "vec", *more, F.least("own", "other").alias("_i"), F.greatest("own", "other").alias("_j"), side.alias("_side"))


def similar(block: pd.DataFrame):
    """Sorted rows, places of the right rows, and an iterator of places of some left rows with their similarities to the right ones."""
    block = block.sort_values("id").reset_index(drop=True)
    side = block._side.to_numpy()
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    return block, right, ((left[at : at + len(s)], s) for at, s in cosine_strips(block.vec.iloc[left], block.vec.iloc[right]))


def dealt(vectors: DataFrame, least: float, pruned: bool) -> DataFrame:
    """Blocks of vectors with all others, or, with ``pruned``, those of a coarse index that may hold a pair of ``least`` (above 0)."""
    return vector_index.block_pairs(vector_index.build(vectors.select("id", "vec"), "vec", "id"), least) if pruned else vector_blocks(vectors)


def similar_pairs(vectors: DataFrame, least: float, pruned: bool = False) -> DataFrame:
    """[J9] i < j with sim >= ``least``. ``vectors``: id, vec. As many rows as there are such pairs."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block, right, strips = similar(block)
        ids, found = block.id.to_numpy(), [pd.DataFrame({"i": [], "j": [], "sim": []}).astype({"i": "int64", "j": "int64"})]
        for left, sims in strips:
            x, y = np.nonzero((sims >= least) & (left[:, None] != right[None, :]) & ((block._side.iloc[0] != 2) | (left[:, None] < right[None, :])))
            a, b = ids[left[x]], ids[right[y]]
            found.append(pd.DataFrame({"i": np.minimum(a, b), "j": np.maximum(a, b), "sim": sims[x, y]}))
        return pd.concat(found, ignore_index=True)

    return dealt(vectors, least, pruned).groupBy("_i", "_j").applyInPandas(run, "i bigint, j bigint, sim double")


def joining_pairs(vectors: DataFrame, least: float, pruned: bool = False) -> DataFrame:
    """a, b: enough similar pairs to join what all of them join; a block gives at most one for each row."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block, right, strips = similar(block)
        ids = block.id.to_numpy()
        group, found = np.arange(len(ids)), []
        for i, row in ((i, row) for left, sims in strips for i, row in zip(left.tolist(), sims)):
            j = right[row >= least]
            other, first = np.unique(group[j], return_index=True)
            new = other != group[i]
            found += [(ids[i], ids[k]) for k in j[first[new]].tolist()]
            group[np.isin(group, other[new])] = group[i]
        return pd.DataFrame(found, columns=["a", "b"])

    return dealt(vectors, least, pruned).groupBy("_i", "_j").applyInPandas(run, "a bigint, b bigint")


def linked_components(vectors: DataFrame, least: float, pruned: bool = False) -> DataFrame:
    """id and component (its smallest id) of every vector."""
    found = components(joining_pairs(vectors, least, pruned))
    return vectors.select("id").join(found.toDF("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def near_places(ids, n, v, known, left, right, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that are not ``known`` and have a partner of mean similarity ``least`` or more on the other side, with the place and
    similarity of the nearest one; the smaller id on ties. ``left`` and ``right``: places, the known ones last; the same list where a
    side meets itself. A pair is computed once, for both of its ends and in single precision; what may be nearest is computed again in full."""
    own = left is right
    mean = v / n[:, None]
    slack = np.float32(2.0**-22 * (v.shape[1] + 8) * max(1.0, float((mean * mean).sum(axis=1).max(initial=0.0))))
    mean = mean.astype(np.float32)
    l, r = mean[left], mean[right]
    open_left, open_right = int((~known[left]).sum()), int((~known[right]).sum())
    top = np.where(known, np.inf, least).astype(np.float32)
    best, to = np.full(len(ids), -np.inf), np.zeros(len(ids), dtype=int)
    held: list[tuple] = []

    def settle():
        x, y, s = (np.concatenate(c) for c in zip(*held))
        held.clear()
        near = s >= np.minimum(top[x], top[y]) - slack
        x, y = x[near], y[near]
        s = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", v[x[i : i + TILE]], v[y[i : i + TILE]]) for i in range(0, len(x), TILE)]])
        s = np.round(s / (n[x] * n[y]), 12)
        x, y, s = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([s, s])
        good = (s >= least) & ~known[x] & ((s > best[x]) | ((s == best[x]) & (ids[y] < ids[to[x]])))
        x, y, s = x[good], y[good], s[good]
        order = np.lexsort((ids[y], -s, x))
        first = order[np.unique(x[order], return_index=True)[1]]
        best[x[first]], to[x[first]] = s[first], y[first]

    for i in range(0, len(left), STRIP):
        xs = left[i : i + STRIP]
        for j in range(i if own else 0, len(right) if i < open_left else open_right, TILE):
            ys = right[j : j + TILE]
            s = l[i : i + STRIP] @ r[j : j + TILE].T
            once = np.tri(len(xs), len(ys), i - j, dtype=bool) if own and j < i + len(xs) else None
            if once is not None:
                s[once] = -np.inf
            hit = s >= np.float32(least) - slack
            if np.count_nonzero(hit) > s.size // 32:  # of many, those that may be the best of their row or column
                top[xs], top[ys] = np.maximum(top[xs], s.max(axis=1)), np.maximum(top[ys], s.max(axis=0))
                hit = s >= np.minimum(top[xs][:, None], top[ys][None, :]) - slack
                if np.count_nonzero(hit) > s.size // 32:  # the first in full, by id
                    a, b = np.argsort(ids[xs]), np.argsort(ids[ys])
                    full = np.round(v[xs[a]] @ v[ys[b]].T / np.outer(n[xs[a]], n[ys[b]]), 12)
                    if once is not None:
                        full[once[np.ix_(a, b)]] = -np.inf
                    x, y = np.concatenate([a, a[full.argmax(axis=0)]]), np.concatenate([b[full.argmax(axis=1)], b])
                    hit = np.zeros_like(hit)
                    hit[x, y] = s[x, y] > -np.inf
            x, y = np.divmod(np.flatnonzero(hit), len(ys))
            if len(x):
                some, x, y = s[x, y], xs[x], ys[y]
                np.maximum.at(top, x, some)
                np.maximum.at(top, y, some)
                near = some >= np.minimum(top[x], top[y]) - slack
                held.append((x[near], y[near], some[near]))
                if sum(len(h[0]) for h in held) > HELD:
                    settle()
    if held:
        settle()
    at = np.flatnonzero(best >= least)
    return at, to[at], best[at]


def nearest(clusters: DataFrame, least: float) -> DataFrame:
    """c, other, sim: each cluster's nearest one by mean similarity of members, the smaller id on ties, where it is ``least`` or
    more. ``clusters``: id, n, vec (the sum of its members' unit vectors, so a mean over pairs is one product) and, if there are
    some that need no search, known. A block of clusters gives a row for each of them at most."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        known = block.known.to_numpy(dtype=bool)
        block = block.iloc[np.argsort(known, kind="stable")]
        ids, side, known = block.id.to_numpy(), block._side.to_numpy(), np.sort(known)
        left = np.flatnonzero(side != 1)
        right = left if len(side) and side[0] == 2 else np.flatnonzero(side != 0)
        v = np.array(block.vec.tolist(), dtype=float).reshape(len(block), -1)
        at, to, sims = near_places(ids, block.n.to_numpy(dtype=float), v, known, left, right, least)
        return pd.DataFrame({"c": ids[at], "other": ids[to], "sim": sims})

    flagged = clusters if "known" in clusters.columns else clusters.withColumn("known", F.lit(False))
    found = vector_blocks(flagged, "n", "known").groupBy("_i", "_j").applyInPandas(run, "c bigint, other bigint, sim double")
    best = found.groupBy("c").agg(F.max(F.struct("sim", (-F.col("other")).alias("other"))).alias("b"))
    return best.select("c", (-F.col("b.other")).alias("other"), "b.sim")


def merges(clusters: DataFrame, least: float) -> DataFrame:
    """into, id: all merges of at most one block of clusters, in one task; the rounds of ``cluster``. ``clusters``: id, n, vec."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id")
        ids, n, v = block.id.to_numpy(), block.n.to_numpy(dtype=float), np.array(block.vec.tolist(), dtype=float).reshape(len(block), -1)
        other, done = np.full(len(ids), -1), []
        while len(ids):
            known = other >= 0
            every = np.argsort(known, kind="stable")
            at, to, _ = near_places(ids, n, v, known, every, every, least)
            other[at] = to
            into = np.flatnonzero((other > np.arange(len(ids))) & (other[other] == np.arange(len(ids))))
            if not len(into):
                break
            gone = other[into]
            done.append(np.stack([ids[into], ids[gone]], axis=1))
            v[into] += v[gone]
            n[into] += n[gone]
            left = other >= 0
            other[np.isin(other, np.concatenate([into, gone]))] = -1
            left[gone] = False
            place = np.cumsum(left) - 1
            ids, n, v, other = ids[left], n[left], v[left], other[left]
            other = np.where(other >= 0, place[other], -1)
        return pd.DataFrame(np.concatenate(done) if done else np.zeros((0, 2), dtype="int64"), columns=["into", "id"])

    return clusters.select("id", "n", "vec").groupBy().applyInPandas(run, "into bigint, id bigint")


def cluster(vectors: DataFrame, least: float = 0.75) -> DataFrame:
    """[G2, M5] id and cluster (its smallest id) of every vector, by greedy average linkage: the pair of clusters with the highest
    mean similarity is merged while that is ``least`` (above 0) or more; of equal pairs the one of smaller ids is first.

    Average linkage is reducible: a merge brings no cluster nearer to a third one than the nearer of its halves was. So two
    clusters that are each other's nearest stay so until they merge, whatever is merged elsewhere, and all such pairs merge
    in one round with the result of merging one at a time. A cluster whose nearest is below ``least`` is done, and one whose
    nearest has not merged keeps it: only new clusters and those whose nearest has merged are compared with all. Clusters are
    kept as sums of unit vectors and counts; rounds are written to the shared folder. The last rounds, which are many and of
    few merges, run in one task once the clusters left fit one block. Equal vectors are one cluster from the
    start. Null, empty and zero vectors and those with components that are not finite stay alone.
    """
    if least <= 0:
        raise ValueError("least must be above 0")
    doubles = F.transform("vec", lambda x: x.cast("double"))
    good = F.coalesce(F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False)) & (vector.norm(F.col("vec")) > 0)
    units = vectors.select("id", doubles.alias("vec")).where(good).select("id", F.transform(vector.unit(F.col("vec")), lambda x: x + 0.0).alias("vec"))
    copies = materialise(units.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("n")), "copies")
    active = copies.select("id", "n", F.transform("vec", lambda x: x * F.col("n")).alias("vec"), F.lit(None).cast("bigint").alias("other"), F.lit(None).cast("double").alias("sim"))
    merged = []
    while active.count() > retrieval.BLOCK:
        known = F.col("other").isNotNull()
        searched = nearest(active.select("id", "n", "vec", known.alias("known")), least)
        best = materialise(searched.union(active.where(known).select("id", "other", "sim")), "nearest")
        mutual = best.alias("a").join(best.alias("b"), F.expr("a.c = b.other and a.other = b.c and a.c < b.c")).select(F.col("a.c").alias("into"), F.col("b.c").alias("id"))
        pairs = materialise(mutual, "merged")
        if pairs.isEmpty():
            break
        merged.append(pairs)
        ends = pairs.select(F.explode(F.array(F.struct(F.col("into").alias("id"), "into"), F.struct("id", "into"))).alias("e")).select("e.*")
        near = best.join(ends.select(F.col("id").alias("other"), F.lit(True).alias("gone")), "other", "left").select(F.col("c").alias("id"), F.when(F.col("gone").isNull(), F.col("other")).alias("other"), F.when(F.col("gone").isNull(), F.col("sim")).alias("sim"))
        left = active.select("id", "n", "vec").join(near, "id").join(ends, "id", "left")
        two = left.where("into is not null").groupBy("into").agg(F.sum("n").alias("n"), F.collect_list("vec").alias("vs"))
        total = F.zip_with(F.element_at("vs", 1), F.element_at("vs", 2), lambda x, y: x + y)
        new = two.select(F.col("into").alias("id"), "n", total.alias("vec"), F.lit(None).cast("bigint").alias("other"), F.lit(None).cast("double").alias("sim"))
        before = active, best
        active = materialise(left.where("into is null").drop("into").union(new), "clusters")
        release(*before)
    else:
        merged.append(materialise(merges(active, least), "merged"))
        release(active)
    own = units.join(copies.select("vec", F.col("id").alias("copy")), "vec").select("id", "copy")
    if merged:
        links = reduce(DataFrame.union, merged).toDF("a", "b")
        own = own.join(components(links).toDF("copy", "component"), "copy", "left").select("id", F.coalesce("component", "copy").alias("cluster"))
    else:
        own = own.select("id", F.col("copy").alias("cluster"))
    found = materialise(vectors.select("id").join(own, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster")), "clustered")
    release(copies, *merged)
    return found


def vector_sums(rows: DataFrame, group: str, *more: Column) -> DataFrame:
    """group, sums, counts (arrays by position) and the columns of ``more``, which are sums. ``rows``: group, vec.

    A vector is added whole into a partial sum on the side of the map, with its present components counted in the
    same vector. Vectors of a group may differ in length: those of one length are summed first, and the few sums of a group
    are then added with missing places as 0. Null components count nowhere; null and empty vectors take no part.
    """
    doubles = F.transform("vec", lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    present = F.transform("vec", lambda x: x.isNotNull().cast("double"))
    added = [f"_s{i}" for i in range(len(more))]
    wide = rows.where(F.size("vec") > 0).select(group, F.size("vec").alias("_d"), F.concat(doubles, present).alias("_v"), *[c.alias(n) for n, c in zip(added, more)])
    wide = wide.withColumn("_v", array_to_vector("_v"))
    partial = wide.groupBy(group, "_d").agg(Summarizer.sum(F.col("_v")).alias("_v"), *[F.sum(n).alias(n) for n in added])
    both = partial.withColumn("_v", vector_to_array("_v"))
    halves = both.select(group, F.struct(F.slice("_v", F.lit(1), F.col("_d")).alias("s"), F.slice("_v", F.col("_d") + 1, F.col("_d")).alias("n")).alias("h"), *added)
    plus = lambda x, y: F.zip_with(x, y, lambda u, v: F.coalesce(u, F.lit(0.0)) + F.coalesce(v, F.lit(0.0)))
    empty = F.array().cast("array<double>")
    lengths = halves.groupBy(group).agg(F.collect_list("h").alias("_h"), *[F.sum(n).alias(n) for n in added])  # a row for each length
    total = F.aggregate("_h", F.struct(empty.alias("s"), empty.alias("n")), lambda t, h: F.struct(plus(t["s"], h["s"]).alias("s"), plus(t["n"], h["n"]).alias("n")))
    return lengths.withColumn("_t", total).select(group, F.col("_t.s").alias("sums"), F.col("_t.n").alias("counts"), *added)


def centroids(rows: DataFrame, group: str, digits: int = 6) -> DataFrame:
    """[A7] element-wise means of the components that are there, null where none is. ``rows``: group, vec."""
    mean = F.zip_with("sums", "counts", lambda s, n: F.round(s / F.nullif(n, F.lit(0.0)), digits))
    return vector_sums(rows, group).select(group, mean.alias("centroid"))


def intra_similarity(rows: DataFrame, group: str) -> DataFrame:
    """[A8] mean cosine of a group's pairs, 1 for single members. ``rows``: group, id, vec.

    The sum over pairs follows from the sum of unit vectors, |s|^2 = sum |u|^2 + 2 * pairs, so no pairs are made. Zero
    vectors are members at cosine 0; null and empty ones are none.
    """
    known = F.transform("vec", lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    units = rows.select(group, vector.unit(known).alias("vec"))
    sums = vector_sums(units, group, vector.dot(F.col("vec"), F.col("vec")), F.lit(1).cast("bigint"))
    n = F.col("_s1")
    pairs = (vector.dot(F.col("sums"), F.col("sums")) - F.col("_s0")) / F.nullif(n * (n - 1), F.lit(0))
    return sums.select(group, F.when(n < 2, 1.0).otherwise(pairs).alias("intra_sim"), n.alias("members"))


def summarise(clustered: DataFrame, n_min: int = 2, least: float = 0.75) -> DataFrame:
    """[G3, G4, A6-A9] a row for each cluster. ``clustered``: cluster, id, vec, classification, ts. The gate uses the unrounded similarity."""
    base = clustered.groupBy("cluster").agg(F.array_sort(F.collect_list("id")).alias("member_ids"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    intra = intra_similarity(clustered, "cluster")
    gated = intra.select("cluster", F.round("intra_sim", 4).alias("intra_sim"), ((F.col("members") >= n_min) & (F.col("intra_sim") >= least)).alias("is_candidate"))
    counts = histogram(clustered.withColumn("classification", F.coalesce("classification", F.lit("unknown"))), ["cluster"], "classification", "coverage_classes")
    return base.join(centroids(clustered, "cluster"), "cluster").join(gated, "cluster").join(counts, "cluster")


def stale(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """[G1, J7] rows whose text the cache does not hold: id, text, hash."""
    return rows.withColumn("hash", F.sha2("text", 256)).join(cache.select("id", "hash"), ["id", "hash"], "left_anti")


def stable_ids(clusters: DataFrame, stored: DataFrame, next_seq: int) -> DataFrame:
    """[K7, J6, X21, X22, ST6] ``clusters`` (member_ids) with the stored id and status of equal member sets; others get ids from the sequence in order of their key."""
    keyed = clusters.withColumn("key", member_key(F.col("member_ids")))
    old = stored.select(member_key(F.col("member_ids")).alias("key"), "cluster_id", "status").dropDuplicates(["key"])
    both = keyed.join(old, "key", "left")
    fresh = numbered(both.where("cluster_id is null").select("key", "member_ids"), ["key"])
    new = fresh.select("key", "member_ids", F.format_string("cc_%04d", F.col("number") + F.lit(next_seq)).alias("cluster_id"), F.lit("open").alias("status"))
    return both.where("cluster_id is not null").select("key", "member_ids", "cluster_id", "status").unionByName(new).drop("key")


def without_open_proposal(clusters: DataFrame, proposals: DataFrame) -> DataFrame:
    """[J10] clusters that have no proposal other than rejected ones."""
    return clusters.join(proposals.where("status <> 'rejected'").select("cluster_id"), "cluster_id", "left_anti")
