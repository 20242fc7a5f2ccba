"""Operator 4: exact deduplication by a log-structured merge index.

Each task fills a memtable of digests; a full one is flushed as a sorted run, cut into shards by digest prefix, each
with a Bloom filter. Compaction, one task per few shards, adds the filters of a shard's runs: only digests whose every
filter place is set in two runs can repeat, so the others leave at once. The rest is merged in digest order, texts of
equal digests are compared byte by byte, and the surviving identifier of each text is kept.

Within a memtable copies meet byte by byte too, so a run holds a text once: a group of any size has at most one entry
per run. Only the answer for groups of two or more goes back to the documents, in a join that Spark can split.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.session import table
from lodestone.plans.shared import text_batches

#: A memtable is flushed at either bound.
MEMTABLE_ROWS, MEMTABLE_BYTES = 20_000, 24_000_000
#: Bits of filter per entry, and hash places per entry.
FILTER_BITS, FILTER_PLACES = 10, 4
#: Text bytes that one compaction shard holds about.
SHARD_BYTES = 6_000_000
ENTRY = "shard int, run bigint, kind int, digest binary, fp bigint, doc_id bigint, n bigint, data binary"


def _places(prefixes: np.ndarray, bits: int) -> np.ndarray:
    """FILTER_PLACES bit numbers for each digest, from its second and third eight bytes."""
    a, b = prefixes[:, 1], prefixes[:, 2] | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) % np.uint64(bits) for k in range(FILTER_PLACES)], axis=1).astype(np.int64)


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d.ljust(32, b"\0")[:32] for d in digests), dtype=">u8").astype(np.uint64).reshape(-1, 4)


def _filter_bits(entries: int) -> int:
    """A power of two, so that filters of runs of different sizes fold onto each other."""
    return 1 << max(6, int(entries * FILTER_BITS - 1).bit_length())


def _fold(data: bytes, bits: int) -> np.ndarray:
    f = np.unpackbits(np.frombuffer(data, dtype=np.uint8))
    return f.reshape(-1, bits).any(axis=0) if len(f) >= bits else np.tile(f, bits // len(f)).astype(bool)


def _flush(memtable: dict, task: int, number: int, shards: int):
    """Sorted run segments with a filter each, as entry rows."""
    rows = sorted((d, fp, best, n, text) for (d, text), (fp, best, n) in memtable.items())
    shard = (_words([r[0] for r in rows])[:, 0] % np.uint64(shards)).astype(np.int32)
    run = task * 1_000_000 + number
    cols = [shard.tolist(), [run] * len(rows), [1] * len(rows), *map(list, zip(*rows))]
    for s in np.unique(shard).tolist():
        mine = [rows[i][0] for i in np.flatnonzero(shard == s)]
        bits = _filter_bits(len(mine))
        f = np.zeros(bits, dtype=np.uint8)
        f[_places(_words(mine), bits).ravel()] = 1
        for c, v in zip(cols, (s, run, 0, b"", 0, None, len(mine), np.packbits(f).tobytes())):
            c.append(v)
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["shard", "run", "kind", "digest", "fp", "doc_id", "n", "data"])


def _runs(keyed: DataFrame, shards: int, keep: str) -> DataFrame:
    better = max if keep == "largest" else min

    def fill(batches):
        from pyspark import TaskContext

        task, number, held, rows = TaskContext.get().partitionId(), 0, 0, 0
        memtable: dict = {}
        for b in batches:
            for d, fp, doc, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                key, rows = (d, text), rows + 1
                if (old := memtable.get(key)) is None:
                    memtable[key] = (fp, doc, 1)
                    held += len(text)
                else:
                    memtable[key] = (fp, doc if old[1] is None else old[1] if doc is None else better(doc, old[1]), old[2] + 1)
                if len(memtable) >= MEMTABLE_ROWS or held >= MEMTABLE_BYTES:
                    yield _flush(memtable, task, number, shards)
                    memtable, held, number = {}, 0, number + 1
        if memtable:
            yield _flush(memtable, task, number, shards)

    return keyed.select("digest", "fp", "doc_id", F.encode("text", "UTF-8")).mapInArrow(fill, ENTRY)


def compact(segments: pd.DataFrame, keep: str = "largest") -> pd.DataFrame:
    """The groups of two or more documents in one shard: digest, fp, keep_id, group_size."""
    better = max if keep == "largest" else min
    out: list[tuple] = []
    filters, entries = segments[segments.kind == 0], segments[segments.kind == 1].reset_index(drop=True)
    if len(entries):
        bits = _filter_bits(int(filters.n.max()))
        seen = np.zeros(bits, dtype=np.int64)
        for data in filters.data:
            seen += _fold(data, bits)
        maybe = (seen[_places(_words(list(entries.digest)), bits)] >= 2).all(axis=1)
        alone = entries[~maybe & (entries.n > 1).to_numpy()]
        out += [tuple(r) for r in alone[["digest", "fp", "doc_id", "n"]].itertuples(index=False)]
        merged = entries[maybe].sort_values(["digest", "run"], kind="stable")
        texts: dict[bytes, list] = {}
        before = None
        def settle():
            prints = [x[0] for x in texts.values()]
            if len(set(prints)) < len(prints):
                raise ValueError("different texts share digest, checksum and length")
            out.extend((before, fp, best, n) for fp, best, n in texts.values() if n > 1)
        for d, fp, doc, n, text in merged[["digest", "fp", "doc_id", "n", "data"]].itertuples(index=False):
            if d != before:
                settle()
                texts, before = {}, d
            if (held := texts.get(text)) is None:  # a hit counts only if the bytes are equal
                texts[text] = [fp, doc, n]
            else:
                held[1] = doc if pd.isna(held[1]) else held[1] if pd.isna(doc) else better(doc, held[1])
                held[2] += n
        settle()
    got = pd.DataFrame(out, columns=["digest", "fp", "keep_id", "group_size"])
    return got.astype({"fp": "int64", "keep_id": "Int64", "group_size": "int64"})


def exact_groups(docs: DataFrame, keep: str = "largest", digest_bytes: int = 32) -> DataFrame:
    """Every row with its group of identical texts: doc_id, keep_id, group_size, kept, text_sha256.

    Null counts as the empty text, and empty texts are equal. The row with the largest (or ``keep="smallest"``) doc_id
    stays; rows that repeat that doc_id stay with it, as they are the same document. Null ids never outrank others; a
    group of null ids alone has a null keep_id and stays. ``digest_bytes`` shortens the digest, for tests of collisions.
    """
    spark = docs.sparkSession
    text_batches(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    size = thin.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    shards = max(1, int(size // SHARD_BYTES) + 1)
    sha = F.sha2(F.encode("text", "UTF-8"), 256)
    # the second print tells texts apart whose digests collide
    keyed = thin.select("doc_id", "text", sha.alias("text_sha256"), F.unhex(F.substring(sha, 1, 2 * digest_bytes)).alias("digest"), F.xxhash64("text", F.octet_length("text")).alias("fp"))
    entries = _runs(keyed, shards, keep)
    groups = entries.groupBy("shard").applyInPandas(lambda pdf: compact(pdf, keep), "digest binary, fp bigint, keep_id bigint, group_size bigint")
    rows = keyed.drop("text").join(groups, ["digest", "fp"], "left")
    best = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select("doc_id", best.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"), F.col("doc_id").eqNullSafe(best).alias("kept"), "text_sha256")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
