"""Operator 7: byte-level BPE encoding and decoding of whole texts, and its query."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bpe import coder
from lodestone.plans.session import table
from lodestone.plans.shared import text_batches

#: Characters of text that are encoded at a time; with the Arrow batch this bounds a worker's memory.
CHUNK_CHARS = 6_000_000
ROWS = 4000


def chunks(ids: list, texts: list[str], chars: int = CHUNK_CHARS) -> Iterator[tuple[list, list[str]]]:
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield ids[start : i + 1], texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield ids[start:], texts[start:]


def encode(docs: DataFrame, path: str, pattern: str | None = None, offsets: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int) for every row; with ``offsets`` also the byte and character each id starts at.

    Null counts as the empty text, which has no ids. Every row gives one row, repeated rows too; a null id stays null.
    """
    text_batches(docs.sparkSession, ROWS)
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = coder(path, pattern)
        for b in batches:
            for keys, texts in chunks(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = c.encode(texts)
                cols = {id_col: keys, "ids": [x.astype("int32") for x in ids]}
                if offsets:
                    at = [c.starts(x, t) for x, t in zip(ids, texts)]
                    cols |= {"byte_start": [x[0] for x in at], "char_start": [x[1] for x in at]}
                yield pa.RecordBatch.from_pydict(cols, schema=pa.schema([(id_col, b.schema.field(0).type), ("ids", pa.list_(pa.int32())), *([("byte_start", pa.list_(pa.int64())), ("char_start", pa.list_(pa.int64()))] if offsets else [])]))

    more = ", byte_start array<bigint>, char_start array<bigint>" if offsets else ""
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).mapInArrow(run, f"`{id_col}` {key}, ids array<int>{more}")


def decode(encoded: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``data`` (binary): the bytes of ``ids``, in which characters split between ids are whole again."""
    key = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        c = coder(path, pattern)
        for b in batches:
            data = [c.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=[id_col, "data"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {key}, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """Digest columns of encoding and decoding in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    text_batches(docs.sparkSession, ROWS)

    def run(batches):
        c = coder(path, pattern)
        for b in batches:
            for keys, texts in chunks(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = c.encode(texts)
                sha = lambda x: hashlib.sha256(x).hexdigest()
                yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(x.tobytes()) for x in ids]), pa.array([sha(c.decode(x)) for x in ids])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {key}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return round_trip(table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
