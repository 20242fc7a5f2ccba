"""Operator 1: packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document's whole windows of tokens stand alone. What is left of each document is dealt evenly over groups of about a
thousand rests, and cut into pieces of at most 128 ids where cuts are allowed. Within a group the partial partitions of
widest spread are merged first, the largest sums of one with the smallest of the other, which leaves near-equal windows.
While a window is over capacity, the number of windows rises and the group is dealt anew.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bpe import coder
from lodestone.llm.tokens import ROWS, chunks
from lodestone.plans.session import table
from lodestone.plans.shared import text_batches

GROUP_RESTS = 1000
#: Longest piece of a rest that is dealt to a window; short pieces leave sums so near that few windows are added.
PIECE_IDS = 128
#: Room for unequal sums in the first count of windows that is tried.
SPREAD_IDS = 4
#: Characters encoded at a time and parts cached: larger chunks repeat more words, which costs less CPU and more memory.
PACK_CHARS, PACK_PARTS = 16_000_000, 100_000
LEAN_CHARS, LEAN_PARTS = 1_500_000, 60_000
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Items of each of ``k`` parts of near-equal sums. A partial partition lists its occupied parts by falling sum, relative to its smallest part."""
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    if k == 1:
        return [list(range(len(sizes)))]
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        both = max(0, len(a) + len(b) - k)
        head, tail = a[: len(a) - both], a[len(a) - both :]
        # the smallest of a meet the largest of b's that find no free part
        met = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(tail, reversed(b[len(b) - both :] if both else []))]
        parts = head + met + b[: len(b) - both]
        parts.sort(key=lambda x: -x[0])
        low = parts[-1][0] if len(parts) == k else 0
        if low:
            parts = [(s - low, items) for s, items in parts]
        heapq.heappush(heap, (-parts[0][0], number, parts))
        number += 1
    parts = [items for _, items in heap[0][2]] if heap else []
    return parts + [[] for _ in range(k - len(parts))]


def windows(sizes: list[int], capacity: int, piece: int | None = PIECE_IDS) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start, length), each of at most ``capacity`` in all.

    Items longer than ``piece`` are cut into pieces of that length and a rest (never with None, where an item may be as
    long as ``capacity``). The number of windows begins near the least that could do and rises while one is over capacity.
    """
    piece = min(piece, capacity) if piece else None
    parts = [(i, a, min(piece or n, n - a)) for i, n in enumerate(sizes) for a in range(0, n, piece or max(n, 1))]
    if not parts:
        return []
    lengths = [p[2] for p in parts]
    # short pieces leave sums that differ by a few ids, so a count without room for that would have to rise
    k = -(-sum(lengths) // max(capacity - (SPREAD_IDS if piece else 0), 1))
    while True:
        dealt = difference(lengths, k)
        most = max(sum(lengths[i] for i in w) for w in dealt)
        if most <= capacity:
            return [joined(sorted(parts[i] for i in w)) for w in dealt if w]
        k += max(1, k * (most - capacity) // (2 * capacity))


def joined(pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Sorted pieces, neighbours of one item as one."""
    out = pieces[:1]
    for i, start, length in pieces[1:]:
        if out[-1][0] == i and out[-1][1] + out[-1][2] == start:
            out[-1] = (i, out[-1][1], out[-1][2] + length)
        else:
            out.append((i, start, length))
    return out


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, piece: int | None = PIECE_IDS, lean: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (gapless in its sequence).

    A document is its ids and ``end_id``; null counts as the empty text, which is ``end_id`` alone. Every row of the
    table is packed, repeated rows each on their own. Null ids stay null. An empty table gives no rows. ``lean`` keeps a
    Python worker's memory low, for jobs that do more than packing: smaller chunks and caches, which go with the task.
    """
    spark = docs.sparkSession
    text_batches(spark, ROWS)
    groups = max(1, docs.count() // GROUP_RESTS)

    def cut_up(batches):
        from pyspark import TaskContext

        c, row = coder(path), TaskContext.get().partitionId() * 7919
        c.most = LEAN_PARTS if lean else PACK_PARTS
        wide = "<u2" if len(c.bytes_of) <= 1 << 16 else "<u4"
        for b in batches:
            for keys, texts in chunks(b.column(0).to_pylist(), b.column(1).to_pylist(), LEAN_CHARS if lean else PACK_CHARS):
                out: list[list] = [[] for _ in range(7)]
                for doc, ids in zip(keys, c.encode(texts)):
                    row += 1
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    n = len(ids)
                    for start in range(0, n, capacity):
                        part = ids[start : start + capacity]
                        whole = len(part) == capacity
                        for col, v in zip(out, (row % groups, doc, start, len(part), zlib.crc32(part.tobytes()) if whole else None, n, None if whole else part.astype(wide).tobytes())):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=names)
        if lean:
            c.release()

    names = ["grp", "doc_id", "start", "length", "crc", "doc_tokens", "ids"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        # rows of one id may have different texts: the ids themselves decide, whatever order the rows arrived in
        pdf = pdf.sort_values(["doc_id", "start", "doc_tokens", "crc", "ids"], kind="stable").reset_index(drop=True)
        whole = pdf.ids.isna().to_numpy()
        base = int(pdf.grp.iloc[0]) << 32
        full = pdf[whole]
        done = pd.DataFrame({"doc_id": full.doc_id, "start": full.start, "length": full.length, "ids_crc32": full.crc, "doc_tokens": full.doc_tokens, "sequence_id": base + np.arange(len(full)), "offset": 0})
        rest = pdf[~whole].reset_index(drop=True)
        rows = []
        docs_, starts, totals, data = rest.doc_id.tolist(), rest.start.tolist(), rest.doc_tokens.tolist(), rest.ids.tolist()
        lengths = rest.length.tolist()
        for w, pieces in enumerate(windows(lengths, capacity, piece)):
            at = 0
            for i, start, length in pieces:
                wide = len(data[i]) // lengths[i]
                ids = np.frombuffer(data[i], dtype=f"<u{wide}")[start : start + length].astype("<u4")
                rows.append((docs_[i], starts[i] + start, length, zlib.crc32(ids.tobytes()), totals[i], base + len(full) + w, at))
                at += length
        both = pd.concat([done, pd.DataFrame(rows, columns=done.columns)], ignore_index=True) if rows else done
        return both.astype({"doc_id": "Int64"}).astype({c: "int64" for c in both.columns if c != "doc_id"})

    thin = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = thin.mapInArrow(cut_up, "grp bigint, doc_id bigint, start bigint, length bigint, crc bigint, doc_tokens bigint, ids binary")
    return parts.groupBy("grp").applyInPandas(fill, PIECES)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"))
