"""Operator 5: near-duplicate documents by BagMinHash, banding and a check of the multiset overlap.

1. Each text gets a BagMinHash signature; texts of equal shingle multisets become one class, so large groups of copies
   cost one row from here on. A class is named by the digest of its multiset, never by a document's id.
2. Classes that share a band meet in a bucket. A bucket links its members to two leaders (the class of most copies, and
   the first in a random order shared by all buckets), never all with all. Pairs whose signatures or sizes rule out the
   threshold leave. Each class's most promising pair is checked on whole texts, then all others that still join two
   components.
3. Where a bucket still holds several components, its members are compared in blocks. First signatures alone tell which
   members have a likely partner in another component; only these bring their texts. Then every likely pair of two
   components is checked on whole texts, within the block's task, in the first band the pair shares; what leaves the task
   are links that join components there, so at most one for each member. Members of very large buckets are joined
   exactly instead, by prefixes: a pair at the threshold shares an element among the first of each text, in an order that
   puts rare elements first, at places that leave room for the overlap. Passages of a crowd are common and come last, so
   they bring no pairs together.
4. Components of the links are the groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodestone.llm.bagminhash import BANDS, PLACES, ROWS, describe, elements, similarities
from lodestone.llm.tokens import chunks
from lodestone.plans.components import components
from lodestone.plans.session import table
from lodestone.plans.shared import materialise, text_batches

THRESHOLD = 0.8
#: A pair is checked from this share of equal places on, five standard deviations below the threshold.
FIRST_PASS = 0.62
#: Members of a bucket, and shingles of their texts, that one side of a comparison holds.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
#: Members of buckets of more than CROWD are joined by prefixes, without signatures.
CROWD = 8192
#: Cells that count elements of crowds, for an order by rarity; any counts give the same links, good ones fewer comparisons.
CELL_BITS = 18
#: Of two texts at THRESHOLD, the overlap's least share of both sizes together.
SHARE = THRESHOLD / (1 + THRESHOLD)
CHUNK_CHARS = 1_500_000


def text_key() -> F.Column:
    """16 bytes that name a text."""
    return F.unhex(F.md5(F.encode("text", "UTF-8")))


def _thin(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def signatures_of(docs: DataFrame) -> DataFrame:
    """doc_id, tkey (the text's key), digest (of the shingle multiset), size and sig (a byte for each place) of every row."""

    def run(batches):
        for b in batches:
            for rows, texts in chunks(list(range(b.num_rows)), b.column(2).to_pylist(), CHUNK_CHARS):
                cols = list(zip(*describe(texts)))
                kept = b.slice(rows[0], len(rows))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["doc_id", "tkey", "digest", "size", "sig"])

    return _thin(docs).select("doc_id", text_key().alias("tkey"), "text").mapInArrow(run, "doc_id bigint, tkey binary, digest binary, size bigint, sig binary")


def stacked(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), dtype=np.uint8).reshape(-1, PLACES)


def agreement(same: np.ndarray) -> np.ndarray:
    """Estimated similarity from equal bytes of the places; unlike places have equal bytes once in 256."""
    return (same.mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


@F.pandas_udf(DoubleType())
def _estimate(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(agreement(stacked(a) == stacked(b)), dtype="float64")


@F.pandas_udf(DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    out: list[float] = []
    left, right = a.tolist(), b.tolist()
    for rows, texts in chunks(list(range(len(left))), left, CHUNK_CHARS):
        out += similarities(texts, [right[i] for i in rows])
    return pd.Series(out, dtype="float64")


def sizes_fit(a, b):
    """The overlap is at most the smaller size over the larger."""
    return F.least(a, b) >= F.lit(THRESHOLD) * F.greatest(a, b)


def likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) with their estimate, where sizes and signatures leave room for THRESHOLD."""
    side = lambda x: reps.select(F.col("digest").alias(x), F.col("size").alias(f"size_{x}"), F.col("sig").alias(f"sig_{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(sizes_fit("size_a", "size_b"))
    # said to be nondeterministic, so that the filter does not evaluate it a second time in a worker of its own
    estimate = _estimate.asNondeterministic()("sig_a", "sig_b")
    return materialise(met.select("a", "b", estimate.alias("estimate")).where(F.col("estimate") >= FIRST_PASS), "likely")


def best_each(pairs: DataFrame) -> DataFrame:
    """The pair of highest estimate of every end; at most one pair for each class."""
    end = lambda x, y: F.struct(F.col(x).alias("node"), F.struct("estimate", F.col(y).alias("other")).alias("best"))
    ends = pairs.select(F.explode(F.array(end("a", "b"), end("b", "a"))).alias("e")).select("e.node", "e.best")
    best = ends.groupBy("node").agg(F.max("best")["other"].alias("other"))
    return best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet; no other pair can change a component."""
    side = lambda x: groups.toDF(x, f"component_{x}")
    named = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return named.where(F.coalesce("component_a", "a") != F.coalesce("component_b", "b")).select("a", "b")


def texts_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """digest and text of the classes ``reps`` (digest, doc_id, tkey), each from a row that has both its doc_id and its text."""
    key = lambda c: F.coalesce(c, F.lit(-1))  # noqa: E731  the text's key decides; the id only spreads rows of one text
    found = _thin(docs).select(key("doc_id").alias("near"), text_key().alias("tkey"), "text")
    wanted = reps.select(key("doc_id").alias("near"), "tkey", "digest")
    return materialise(found.join(wanted, ["near", "tkey"]).select("digest", "text").dropDuplicates(["digest"]), "texts")


def check(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts overlap by THRESHOLD or more."""
    side = lambda x: texts.select(F.col("digest").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return materialise(both.where(_similarity("text_a", "text_b") >= THRESHOLD).select("a", "b"), "links")


def band(i) -> F.Column:
    """The bytes of one band's places, led by the band's number."""
    return F.concat(F.unhex(F.lpad(F.hex(i), 2, "0")), F.substring("sig", i * ROWS + 1, F.lit(ROWS)))


def shared_buckets(reps: DataFrame) -> DataFrame:
    """Every member (digest) of the buckets (key) of two or more, with the bucket's two leaders l1 and l2."""
    rows = reps.select("digest", "copies", F.explode(F.array(*[band(F.lit(i)) for i in range(BANDS)])).alias("key"))
    first = F.max(F.struct("copies", "digest"))["digest"]
    second = F.min("digest")  # a digest is random already
    leaders = rows.groupBy("key").agg(F.count("*").alias("n"), first.alias("l1"), second.alias("l2")).where("n > 1").drop("n")
    return materialise(rows.select("digest", "key").join(leaders, "key"), "buckets")


def star_pairs(members: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's two leaders."""
    met = members.select("digest", F.explode(F.array_distinct(F.array("l1", "l2"))).alias("leader")).where("digest <> leader")
    return met.select(F.least("digest", "leader").alias("a"), F.greatest("digest", "leader").alias("b")).distinct()


def partners(block: pd.DataFrame):
    """For each left row of one bucket's block: the row's place and those of its likely right partners in other components,
    where the bucket is the first band that they share."""
    band_here, sig = bytes(block["key"].iloc[0])[0], stacked(block.sig)
    comp, size, side = pd.factorize(block.component)[0], block["size"].to_numpy(), block.side.to_numpy()
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    for i in left.tolist():
        j = right[(comp[right] != comp[i]) & (np.minimum(size[right], size[i]) >= THRESHOLD * np.maximum(size[right], size[i]))]
        if side[i] == 2:
            j = j[j > i]
        same = sig[j] == sig[i]
        good = agreement(same) >= FIRST_PASS
        j, shared = j[good], same[good].reshape(-1, BANDS, ROWS).all(axis=2)
        j = j[shared.any(axis=1) & (shared.argmax(axis=1) == band_here)]
        if len(j):
            yield i, j


def prefix_partners(block: pd.DataFrame):
    """For each left row of one element's block: the row's place and those of the right rows in other components whose texts
    are as long or longer and may overlap enough if the element is the first that they share. Rows are in order of digest."""
    comp, size, side = pd.factorize(block.component)[0], block["size"].to_numpy(), block.side.to_numpy()
    left, right, rest = np.flatnonzero(side != 1), np.flatnonzero(side != 0), size - block.place.to_numpy()
    place = np.arange(len(block))
    for i in left.tolist():
        j = right[(comp[right] != comp[i]) & (size[i] >= THRESHOLD * size[right])]
        j = j[(size[j] > size[i]) | (size[j] == size[i]) & (place[j] > i)]
        j = j[np.minimum(rest[i], rest[j]) >= SHARE * (size[i] + size[j]) - 1e-9]
        if len(j):
            yield i, j


def by_digest(block: pd.DataFrame) -> pd.DataFrame:
    """The rows in one order, so that a task that runs again finds the same links."""
    return block.assign(digest=block.digest.map(bytes)).sort_values("digest", kind="stable").reset_index(drop=True)


def with_partners(block: pd.DataFrame) -> pd.DataFrame:
    """The rows of a bucket's block that have a likely partner in another component."""
    some = np.zeros(len(block), dtype=bool)
    for i, j in partners(block):
        some[i] = some[j] = True
    return block[some]


def with_prefix_partners(dealt: DataFrame) -> DataFrame:
    """The rows of elements' blocks that have a partner by the conditions of ``prefix_partners``: on the left as side 0, on
    the right as side 1. Two semi-joins within (key, i, j), so no pair is made."""
    columns = ["digest", "component", "size", "place"]
    part = lambda side, x: dealt.where(F.col("side") != 1 - side).select("key", "i", "j", *[F.col(c).alias(x + c) for c in columns])
    left, right = part(0, "l_"), part(1, "r_")
    later = F.expr("r_size > l_size OR (r_size = l_size AND r_digest > l_digest)")
    room = F.least(F.expr("l_size - l_place"), F.expr("r_size - r_place")) >= SHARE * F.expr("l_size + r_size") - 1e-9
    fits = F.expr("l_component <> r_component") & (F.col("l_size") >= THRESHOLD * F.col("r_size")) & later & room

    def hit(a: DataFrame, b: DataFrame, x: str, side: int) -> DataFrame:
        met = (a["key"] == b["key"]) & (a["i"] == b["i"]) & (a["j"] == b["j"])
        found = a.join(b, met & fits, "left_semi")
        return found.select("key", "i", "j", *[F.col(x + c).alias(c) for c in columns], F.lit(side).alias("side"))

    return hit(left, right, "l_", 0).union(hit(right, left, "r_", 1))


def joining_links(meet):
    """Links (a, b) of a block's pairs by ``meet`` whose texts overlap by THRESHOLD or more; pairs that the block's links have joined are passed over."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = by_digest(block)
        text, element = elements(block.text.tolist())
        element = np.unique(element, return_inverse=True)[1]
        ends = np.searchsorted(text, np.arange(len(block) + 1))
        size = np.diff(ends)
        owner = pd.factorize(block.component)[0]
        found, mark = [], np.zeros(element.max(initial=0) + 1, dtype=bool)
        for i, j in meet(block):
            own = element[ends[i] : ends[i + 1]]
            mark[own] = True
            j = j[owner[j] != owner[i]]
            while len(j):
                now, j = j[:256], j[256:]
                both = np.array([np.count_nonzero(mark[element[ends[k] : ends[k + 1]]]) for k in now.tolist()])
                for k in now[both >= THRESHOLD * (size[i] + size[now] - both)].tolist():
                    if owner[k] != owner[i]:
                        found.append((i, k))
                        owner[owner == owner[k]] = owner[i]
                j = j[owner[j] != owner[i]]
            mark[own] = False
        digest = block.digest.tolist()
        return pd.DataFrame([sorted((digest[i], digest[k])) for i, k in found], columns=["a", "b"])

    return run


def links_of(some: DataFrame, texts: DataFrame, meet) -> DataFrame:
    """Links (a, b) within the blocks (key, i, j) of the rows that have a partner, which alone bring their texts."""
    return materialise(some, "partners").join(texts, "digest").groupBy("key", "i", "j").applyInPandas(joining_links(meet), "a binary, b binary")


def blocks_of(n: F.Column) -> F.Column:
    return F.ceil(F.greatest(n / BLOCK, F.col("all") / BLOCK_SHINGLES)).cast("int")


def several(rows: DataFrame, *more: F.Column) -> DataFrame:
    """The rows of keys that hold more than one component, with the key's number of rows and of their shingles."""
    held = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.min("component").alias("x"), F.max("component").alias("y"), *more)
    return materialise(rows.join(held.where("x <> y").drop("x", "y"), "key"), "several")


def rarity(texts: DataFrame) -> np.ndarray:
    """How many elements of ``texts`` fall to each of 2**CELL_BITS cells, an array of fixed size."""

    def run(batches):
        n = np.zeros(1 << CELL_BITS, dtype=np.int64)
        for b in batches:
            for _, some in chunks(list(range(b.num_rows)), b.column(0).to_pylist(), CHUNK_CHARS):
                n += np.bincount((elements(some)[1] >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(n))
        cells = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(n[cells], pa.int64())], names=["cell", "n"])

    found = texts.select("text").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(1 << CELL_BITS, dtype=np.int64)
    n[found.cell.to_numpy(dtype=np.int64)] = found.n.to_numpy(dtype=np.int64)
    return n


def prefixes(texts: DataFrame) -> DataFrame:
    """digest, component, size, key (an element) and place of the elements of each text's prefix, rare ones first."""
    counts = texts.sparkSession.sparkContext.broadcast(rarity(texts))

    def run(batches):
        n = counts.value
        for b in batches:
            for rows, some in chunks(list(range(b.num_rows)), b.column(2).to_pylist(), CHUNK_CHARS):
                text, element = elements(some)
                order = np.lexsort((element, n[(element >> np.uint64(64 - CELL_BITS)).astype(np.int64)], text))
                text, element = text[order], element[order]
                size = np.bincount(text, minlength=len(some))
                place = np.arange(len(text)) - (np.cumsum(size) - size)[text]
                # an overlap of THRESHOLD of the text's size has an element among these
                first = size[text] - place >= THRESHOLD * size[text] - 1e-9
                text, element, place = text[first], element[first], place[first]
                held = b.slice(rows[0], len(rows)).take(pa.array(text, pa.int64()))
                yield pa.RecordBatch.from_arrays([held.column(0), held.column(1), pa.array(size[text], pa.int64()), pa.array(element.view(np.int64), pa.int64()), pa.array(place, pa.int64())], names=["digest", "component", "size", "key", "place"])

    return texts.select("digest", "component", "text").mapInArrow(run, "digest binary, component binary, size bigint, key bigint, place bigint")


def crowd_blocks(crowd: DataFrame) -> DataFrame:
    """The blocks in which texts (digest, component, text) meet by shared elements of their prefixes.

    The shorter text of a pair holds its first shared element within a prefix of about half the length ("early"), so early
    rows stand on the left, all on the right, and elements that are early nowhere bring nothing together.
    """
    early = F.col("size") - F.col("place") >= 2 * SHARE * F.col("size") - 1e-9
    rows = several(prefixes(crowd).withColumn("early", early), F.count_if("early").alias("n_early")).where("n_early > 0")
    spread = lambda n: F.pmod(F.xxhash64("digest"), F.col(n)).cast("int")
    rows = rows.withColumn("blocks_i", blocks_of(F.col("n_early"))).withColumn("blocks_j", blocks_of(F.col("n")))
    rows = rows.withColumn("own_i", spread("blocks_i")).withColumn("own_j", spread("blocks_j"))
    right = F.expr("transform(sequence(0, blocks_i - 1), x -> struct(x AS i, own_j AS j, if(early AND x = own_i, 2, 1) AS side))")
    left = F.expr("transform(filter(sequence(0, blocks_j - 1), x -> early AND x <> own_j), x -> struct(own_i AS i, x AS j, 0 AS side))")
    return rows.withColumn("at", F.explode(F.concat(right, left))).select("digest", "key", "component", "size", "place", "at.i", "at.j", "at.side")


def cross_links(members: DataFrame, reps: DataFrame, groups: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between components that share a bucket. Buckets of more than a block are compared block by block, members of crowds by prefixes."""
    rows = members.select("digest", "key").join(groups.toDF("digest", "component"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    mixed = several(rows.join(reps.select("digest", "size"), "digest"))
    own = mixed.where(F.col("n") <= CROWD).join(reps.select("digest", "sig"), "digest").withColumn("blocks", blocks_of(F.col("n")))
    own = own.withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    # block i meets block j for i <= j; the row stands on the left, on the right, or on both sides of its own block
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = own.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("digest", "key", "component", "size", "sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"))
    links = links_of(dealt.groupBy("key", "i", "j").applyInPandas(with_partners, dealt.schema), texts, partners)
    crowd = mixed.where(F.col("n") > CROWD).select("digest", "component").distinct()
    if not crowd.isEmpty():
        dealt = crowd_blocks(materialise(crowd.join(texts, "digest"), "crowd"))
        links = links.union(links_of(with_prefix_partners(dealt), texts, prefix_partners))
    return materialise(links.distinct(), "links")


def near_groups(docs: DataFrame) -> DataFrame:
    """A row for every row of ``docs``: doc_id, group_id, group_size, n_links, kept, group_key, text_key.

    The group is a component of texts that are linked by a weighted Jaccard similarity of THRESHOLD or more of their
    shingles of five words. group_id is its smallest doc_id; group_key (hex) names it even where an id stands on several
    texts. ``kept`` marks one document: the rows of that doc_id with one text (of its texts in the group, the one whose
    key comes first), so only rows that repeat an id and its text stay together. ``n_links`` counts the checked links of a
    document's class that were needed to form the group. text_key is the md5 of the text, which with doc_id names a row.
    Null counts as the empty text; texts without words are one class of copies. Shorter texts have one shingle of all
    their words. A null id never names a group unless it holds nothing else; group_id is null then. An empty table gives
    no rows; other columns of ``docs`` are not read.
    """
    text_batches(docs.sparkSession)
    sigs = materialise(signatures_of(docs), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey", "size", "sig")).alias("row")
    classes = sigs.groupBy("digest").agg(first, F.count("*").alias("copies"))
    classes = materialise(classes.select("digest", "copies", "row.doc_id", "row.tkey", "row.size", "row.sig"), "classes")
    reps = classes.where("size > 0")
    members = shared_buckets(reps)
    texts = texts_of(docs, reps.join(members.select("digest"), "digest", "left_semi"))
    star = likely(star_pairs(members), reps)
    best = materialise(best_each(star), "best")
    links = check(best, texts)
    groups = materialise(components(links), "components")
    links = links.union(check(apart(star.join(best, ["a", "b"], "left_anti"), groups), texts))
    groups = materialise(components(links), "components")
    links = links.union(cross_links(members, reps, groups, texts))
    groups = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("digest")).groupBy("digest").agg(F.count("*").alias("n_links"))
    named = classes.select("digest", "copies", "doc_id", "tkey").join(groups.toDF("digest", "component"), "digest", "left").join(degree, "digest", "left")
    named = materialise(named.select("digest", "copies", "doc_id", "tkey", F.coalesce("component", "digest").alias("component"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")), "named")
    whole = named.groupBy("component").agg(F.sum("copies").alias("group_size"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey", "digest")).alias("head"))
    head = F.when(F.col("head.digest") == F.col("digest"), F.col("head.tkey")).alias("head")
    named = named.join(whole, "component").select("digest", F.col("head.doc_id").alias("group_id"), "group_size", "n_links", F.lower(F.hex("component")).alias("group_key"), head)
    rows = sigs.select("doc_id", "tkey", "digest").join(named, "digest")
    kept = F.coalesce(F.col("tkey") == F.col("head"), F.lit(False)) & F.col("doc_id").eqNullSafe(F.col("group_id"))
    return rows.select("doc_id", "group_id", "group_size", "n_links", kept.alias("kept"), "group_key", F.lower(F.hex("tkey")).alias("text_key"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
