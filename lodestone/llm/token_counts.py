"""Operator 11: token counts by compiled finite-state transducers.

A text is cut into chunks that begin at no mark that could join what stands before and inside no special string. Chunks
are counted in any task: what a chunk does to a segment that is open at its start is its head, the characters up to the
first place where all entry states of the splitter agree and a segment begins; its tail is its last segment, which may go on.
A document is the composition of its chunks: their own counts, and the counts of what tails and heads make together.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.transducer import Compiled, compiled
from lodestone.plans.session import table
from lodestone.plans.shared import text_batches

#: Code points of a chunk, and of the chunks that are counted together.
CHUNK, FLUSH = 65536, 1_500_000
#: Chunks end only before a character that no mark of composition or special string can reach across.
CUT = r"(?s).{1,%d}(?:[\p{M}\p{Cn}\x{1100}-\x{11FF}\x{A960}-\x{A97F}\x{D7B0}-\x{D7FF}]|(?<=<[|a-z]{0,13})[|a-z>])*+"


def elements(c: Compiled, texts: list[str], begins: list[bool], ends: list[bool]) -> list[tuple[bool, bytes, int, bytes]]:
    """Of each chunk: whether its states meet, head, tokens between head and tail, and tail. ``begins`` and ``ends`` say whether a
    chunk is its document's first or last; the first has no head and the last no tail. If the states never meet, all is
    head. Heads and tails are code points as the splitter reads them, four bytes each."""
    points, at = c.read(texts)
    starts, tokens = c.segments(points, at)
    upto = np.concatenate([[0], np.cumsum(tokens)])
    out = []
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        from_, to = a, b
        if not begins[i]:
            place = c.splitter.settled(c.kind[points[a:b]].tolist())
            if place < 0:
                out.append((False, points[a:b].tobytes(), 0, b""))
                continue
            from_ = a + place
        lo = np.searchsorted(starts, from_)
        hi = np.searchsorted(starts, b)
        if not ends[i] and b > a:
            # an apostrophe at the end may begin a contraction that goes on
            hi = max(lo, hi - 1)
            while hi > lo and starts[hi - 1] >= b - 2 and points[starts[hi - 1]] == 39:
                hi -= 1
            to = int(starts[hi])
        out.append((True, points[a:from_].tobytes(), int(upto[hi] - upto[lo]), points[to:b].tobytes()))
    return out


def open_parts(parts: Iterable[tuple[bool, bytes, bytes]]) -> list[bytes]:
    """What tails and heads make together, over a document's chunks in order."""
    out, held = [], []
    for met, head, tail in parts:
        held.append(head)
        if met:
            out.append(b"".join(held))
            held = [tail]
    return [t for t in [*out, b"".join(held)] if t]


def open_tokens(c: Compiled, parts: list[bytes]) -> np.ndarray:
    """Tokens of each of the code point sequences, which stand alone."""
    points = np.frombuffer(b"".join(parts), dtype="<u4")
    c.meet(points)
    at = np.cumsum([0, *(len(p) // 4 for p in parts)])
    starts, tokens = c.segments(points, at)
    upto = np.concatenate([[0], np.cumsum(tokens)])[np.searchsorted(starts, at)]
    return np.diff(upto)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row.

    Null counts as the empty text, which has no tokens. Repeated rows give a row each, a null id stays null, an empty table
    gives no rows; other columns are not looked at. Special strings inside a text are one token each.
    """
    spark = docs.sparkSession
    text_batches(spark)
    chunks = F.regexp_extract_all(F.col("text"), F.lit(CUT % chunk), F.lit(0))
    thin = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    cut = thin.select("row", "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), chunks.alias("chunks"))
    rows = cut.select("row", "doc_id", "n_bytes", F.size("chunks").alias("n"), F.posexplode_outer("chunks").alias("c", "text"))

    def run(batches):
        c = compiled(path)
        for b in batches:
            col = {k: b.column(i).to_pylist() for i, k in enumerate(b.schema.names)}
            at = 0
            while at < b.num_rows:
                end, size = at, 0
                while end < b.num_rows and size < FLUSH:
                    size += len(col["text"][end] or "")
                    end += 1
                part = slice(at, end)
                place = [x or 0 for x in col["c"][part]]
                done = elements(c, [t or "" for t in col["text"][part]], [x == 0 for x in place], [x + 1 >= n for x, n in zip(place, col["n"][part])])
                met, head, inner, tail = (list(x) for x in zip(*done))
                cols = [col["row"][part], col["doc_id"][part], col["n_bytes"][part], place, met, head, inner, tail]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], names=names)
                at = end

    names = ["row", "doc_id", "n_bytes", "c", "met", "head", "inner", "tail"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.binary()]
    parts = rows.mapInArrow(run, "row bigint, doc_id bigint, n_bytes bigint, c int, met boolean, head binary, inner bigint, tail binary")
    ends = F.when((F.octet_length("head") > 0) | (F.octet_length("tail") > 0), F.struct("c", "met", "head", "tail"))
    whole = parts.groupBy("row", "doc_id", "n_bytes").agg(F.sum("inner").alias("inner"), F.array_sort(F.collect_list(ends)).alias("ends"))

    def composed(batches):
        c = compiled(path)
        for b in batches:
            total = np.array(b.column(2).to_pylist(), dtype=np.int64)
            found = [open_parts((x["met"], x["head"], x["tail"]) for x in e) if e else [] for e in b.column(3).to_pylist()]
            if every := [p for f in found for p in f]:
                np.add.at(total, np.repeat(np.arange(len(found)), [len(f) for f in found]), open_tokens(c, every))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total)], names=["doc_id", "n_bytes", "n_tokens"])

    counted = whole.select("doc_id", "n_bytes", "inner", "ends").mapInArrow(composed, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return count_tokens(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"))
