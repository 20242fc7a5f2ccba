"""Operator 12: phrase collocation mining.

All 1..max_n-grams within pieces are counted per language, parts are joined to their wholes, the lowest-scoring cut is taken
in exact decimals, phrases inside frequent one-word extensions leave by an anti-join, and ranks are places in a global order.

The n-grams are exploded twice. The first pass makes rows of 48-bit hashes with the counts of a task and sums them on
Spark: a hash that is rarer than ``least`` holds no frequent phrase. The others set bits of a filter whose size follows
their number up to a fixed bound; as it fills, it lets more rare n-grams through, but never holds a frequent one back. The
second pass makes rows of the phrases themselves for the n-grams that pass, so counts are exact and only a few rows with
strings are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bpe import trim
from lodestone.plans.numbering import numbered
from lodestone.plans.session import table
from lodestone.plans.shared import materialise, text_batches

#: UTF-8 bytes of texts that are counted together in a task, and counts held before they are passed on.
FLUSH_BYTES, HELD = 3_000_000, 3_000_000
HASH_BITS = 48
#: Bits of the filter: at least 16 for each frequent hash, within these powers of two (64 MB at most).
LEAST_BITS, MOST_BITS = 23, 29
#: Languages whose two numbers are broadcast.
MOST_LANGUAGES = 100_000
# The bytes that end a piece and those that part words.
PIECE_ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def byte_kinds() -> np.ndarray:
    """0 for bytes of words, 1 for gaps, 2 for the ends of pieces."""
    kinds = np.zeros(256, dtype=np.uint8)
    kinds[list(GAPS)], kinds[list(PIECE_ENDS)] = 1, 2
    return kinds


KINDS = byte_kinds()


class Words:
    """The words of some texts: distinct ones, the code of each place, and the number of the piece that a place is in."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts).translate(LOWER), dtype=np.uint8)
        kinds = KINDS[data]
        inside = kinds == 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts = np.flatnonzero(first)
        self.piece = np.cumsum(kinds == 2, dtype=np.int32)[starts]
        body = data[inside]
        ends = np.append((np.cumsum(inside, dtype=np.int32) - 1)[starts], np.int32(len(body))).astype(np.int64)
        array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(body.tobytes())])
        coded = array.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct: list[bytes] = coded.dictionary.to_pylist()

    def hashes(self, lang: str) -> np.ndarray:
        salt = xxhash.xxh32_intdigest(lang.encode())
        return np.fromiter((xxhash.xxh3_64_intdigest(w, salt) for w in self.distinct), dtype=np.uint64, count=len(self.distinct))[self.codes]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: xor-shifts and odd multiplications."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0xBF58476D1CE4E5B9)


def grams(words: Words, hashes: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each n the places where an n-gram begins, all in one piece, and its hash of HASH_BITS bits."""
    held, at = hashes, np.arange(len(hashes))
    for n in range(1, most + 1):
        if n > 1:
            same = words.piece[at[:-1]] == words.piece[at[:-1] + n - 1] if len(at) else np.zeros(0, dtype=bool)
            at = at[:-1][same] if len(at) else at
            held = mixed(held[: len(same)][same] * np.uint64(3) + hashes[at + n - 1])
            if n < most:  # a longer gram needs the place after it
                keep = at + n <= len(hashes)
                at, held = at[keep], held[keep]
        yield n, at, held >> np.uint64(64 - HASH_BITS)


def by_language(batches) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of a language together, as they come, in groups of about FLUSH_BYTES."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.setdefault(lang, []).append(text.encode())
            size += len(held[lang][-1])
            if size >= FLUSH_BYTES:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def thin(docs: DataFrame) -> DataFrame:
    text_batches(docs.sparkSession)
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def frequent_hashes(docs: DataFrame, most: int, least: int) -> DataFrame:
    """h: hashes of n-grams with counts of ``least`` or more; hashes that meet add up, so no frequent n-gram is missing."""

    def run(batches):
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def summed(h: np.ndarray, c: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            """Distinct hashes and the sums of their counts (1 each without counts)."""
            if c is None:
                h.sort()
            else:
                order = np.argsort(h)
                h, c = h[order], c[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, dtype=np.int64)
            counts = np.diff(np.append(first, len(h))) if c is None else np.add.reduceat(c, first) if len(first) else c
            return h[first], counts.astype(np.int32)

        def made(h: np.ndarray, c: np.ndarray):
            for i in range(0, len(h), 250_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 250_000].astype(np.int64)), pa.array(c[i : i + 250_000].astype(np.int64))], names=["h", "c"])

        for lang, texts in by_language(batches):
            words = Words(texts)
            kept.append(summed(np.concatenate([h for _, _, h in grams(words, words.hashes(lang), most)]), None))
            del words
            if sum(len(x) for x, _ in kept) > HELD:
                kept = [summed(*(np.concatenate(x) for x in zip(*kept)))]
                if len(kept[0][0]) > HELD * 3 // 4:
                    yield from made(*kept.pop())
        if kept:
            yield from made(*summed(*(np.concatenate(x) for x in zip(*kept))))
        kept.clear()
        trim()

    return thin(docs).mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select("h")


def filter_of(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """Bits (packed, at most 2**MOST_BITS) set by the hashes, and the power of two. Spark sets them in blocks of 4 KB; only the blocks reach the driver."""
    bits = LEAST_BITS
    n = hashes.count()
    while bits < MOST_BITS and n * 16 > 1 << bits:
        bits += 1
    place = F.shiftright("h", HASH_BITS - bits)
    blocks = hashes.select(F.shiftright(place, 15).cast("int").alias("block"), place.bitwiseAND(32767).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in blocks.toLocalIterator():  # a few thousand blocks at most
        out[r.block * 4096 : (r.block + 1) * 4096] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return out, bits


def counted(docs: DataFrame, most: int, least: int) -> DataFrame:
    """lang, k (words), phrase, f: exact counts of n-grams, all with ``least`` or more among them; and a row with k = 0 for a language, whose f is the number of its words."""
    spark = docs.sparkSession
    packed, bits = filter_of(materialise(frequent_hashes(docs, most, least), "hashes"))
    passed = spark.sparkContext.broadcast(packed)

    def run(batches):
        known = passed.value
        for lang, texts in by_language(batches):
            words = Words(texts)
            rows = [[lang], [0], [""], [len(words.codes)]]
            for k, at, h in grams(words, words.hashes(lang), most):
                place = (h >> np.uint64(HASH_BITS - bits)).astype(np.int64)
                hit = at[(known[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0]
                key = words.codes[hit]
                for j in range(1, k):  # exact keys: numbers of the distinct beginnings, then the next word
                    key = (np.unique(key, return_inverse=True)[1] if j > 1 else key) * len(words.distinct) + words.codes[hit + j]
                _, one, f = np.unique(key, return_index=True, return_counts=True)
                first = hit[one]
                said = [words.distinct[i] for i in words.codes[first].tolist()]
                for j in range(1, k):
                    said = [a + b" " + words.distinct[i] for a, i in zip(said, words.codes[first + j].tolist())]
                rows[0] += [lang] * len(said)
                rows[1] += [k] * len(said)
                rows[2] += [s.decode() for s in said]
                rows[3] += f.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int64())], names=["lang", "k", "phrase", "f"])

    return thin(docs).mapInArrow(run, "lang string, k int, phrase string, f bigint").groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))


def scored(counts: DataFrame) -> DataFrame:
    """lang, k, phrase, a, l, r, score of phrases of two words or more: the cut of the lowest score, the first on ties. ``counts`` as of ``counted``."""
    whole = counts.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cut = whole.select("lang", "k", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    said = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cut = cut.select("lang", "k", "phrase", "a", "cut", said(F.lit(1), F.col("cut")).alias("left"), said(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    part = lambda side, f: counts.where("k > 0").select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    both = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr("(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * 1000000) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b")
    return both.groupBy("lang", "k", "phrase", "a").agg(best).select("lang", "k", "phrase", "a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, most: int = 3, least: int = 10, first: int = 2000, share: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``first`` phrases of 2 to ``most`` words that occur ``least`` times.

    Null text counts as empty, a null language as ``und``; repeated rows count each. A phrase inside a longer candidate that
    has at least ``share`` percent of its count is dropped; a longer candidate with a shorter one between has no more counts
    than that one, so extensions by one word decide. Ties of score go by count, then by the phrase's bytes. An empty table
    gives no rows; other columns are not looked at.
    """
    all_counts = materialise(counted(docs, most, least), "phrase-counts")
    counts = all_counts.where((F.col("k") > 0) & (F.col("f") >= least))
    found = scored(counts)
    part = lambda start: F.array_join(F.slice("w", F.lit(start), F.col("k") - 1), " ")
    wider = counts.where("k > 2").withColumn("w", F.split("phrase", " "))
    longer = wider.select("lang", F.explode(F.array_distinct(F.array(part(1), part(2)))).alias("phrase"), F.col("f").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    covered = found.select("lang", "phrase", "a").join(longer, ["lang", "phrase"]).where(F.col("longer") * 100 >= F.col("a") * share).select("lang", "phrase")
    kept = found.join(covered, ["lang", "phrase"], "left_anti")
    placed = numbered(kept.withColumns({"down": -F.col("score"), "fewer": -F.col("a")}), ["lang", "down", "fewer", "phrase"], "place")
    placed = materialise(placed, "phrase-places")
    langs = placed.groupBy("lang").agg(F.min("place").alias("start")).join(all_counts.where("k = 0").select("lang", F.col("f").alias("n")), "lang")
    if langs.count() <= MOST_LANGUAGES:  # else languages are many and so no hot keys
        langs = F.broadcast(langs)
    ranked = placed.join(langs, "lang").withColumn("rank", F.col("place") - F.col("start") + 1).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k),
c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM c WHERE k = 1 GROUP BY 1),
a AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM c WHERE k > 1 AND f >= 10),
x AS (SELECT *, unnest(range(1, k)) AS cut FROM a),
y AS (SELECT x.lang, x.k, x.phrase, x.a, x.cut, l.f AS l, r.f AS r, 1000000::HUGEINT * x.a * x.a // (l.f::HUGEINT * r.f) AS score FROM x
      JOIN c l ON l.lang = x.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN c r ON r.lang = x.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
s AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
k AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.lang = s.lang AND b.k > s.k AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * b.a >= 50 * s.a)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT o.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""
