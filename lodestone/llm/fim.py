"""Operator 13: fill-in-middle transformation by a parallel scan of the unit automaton.

A unit is a run of ASCII letters or any other single code point. The automaton that cuts units has two states, outside
and inside a run of letters. A text is cut into chunks of code points; each chunk gives its transition function and, for
either entry state, the number of units that begin in it. Functions and counts compose associatively, so a scan over the
chunks' few numbers gives every chunk its entry state and the units before it; the chunk that holds a cut follows, and
only that chunk is looked at unit by unit.

Texts of up to ``giant`` code points are scanned inside their row, in built-in expressions and without a shuffle. Longer
ones become one row a chunk, spread over tasks: functions from all chunks at once, a scan over their numbers, a join of the
cuts with the chunks that hold them, and digests of output and restored text streamed from the sorted pieces.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.plans.session import table
from lodestone.plans.shared import materialise, text_batches

#: Code points of a chunk inside a row, and of a row's chunk of a giant document.
CHUNK, PIECE = 2048, 16384
#: Texts of more code points are spread over tasks.
GIANT = 1 << 16
# The marks of the output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = "[A-Za-z]+|[^A-Za-z]"


def cut_up(text: Column, size: int) -> Column:
    """Chunks of ``size`` code points; their cost is linear in the text."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0))


def chunk_map(c: Column) -> Column:
    """The chunk's transition function (the state after it from outside and from inside a run) and its counts of units begun from
    either state, with its length."""
    begins = F.regexp_like(c, F.lit(r"\A[A-Za-z]"))
    ends = F.regexp_like(c, F.lit(r"[A-Za-z]\z"))
    units = F.length(F.regexp_replace(c, "[A-Za-z]+", "a")).cast("bigint")
    return F.struct(ends.alias("from_out"), ends.alias("from_in"), units.alias("n_out"), (units - begins.cast("bigint")).alias("n_in"), F.length(c).cast("bigint").alias("chars"))


def entered(maps: Column) -> Column:
    """The scan: entry state, units and code points before each chunk, and one more entry for the end of the text."""
    entry = lambda inside, units, chars: F.struct(inside.alias("inside"), units.alias("units"), chars.alias("chars"))
    zero = F.lit(0).cast("bigint")

    def step(done: Column, m: Column) -> Column:
        last = F.element_at(done, -1)
        after = entry(F.when(last["inside"], m["from_in"]).otherwise(m["from_out"]), last["units"] + F.when(last["inside"], m["n_in"]).otherwise(m["n_out"]), last["chars"] + m["chars"])
        return F.concat(done, F.array(after))

    return F.aggregate(maps, F.array(entry(F.lit(False), zero, zero)), step)


def place_in_chunk(chunk: Column, inside: Column, skip: Column) -> Column:
    """Code points of the chunk before its unit number ``skip`` (from 0) of those that begin in it."""
    carried = F.when(inside & F.regexp_like(chunk, F.lit(r"\A[A-Za-z]")), 1).otherwise(0)
    units = F.regexp_extract_all(chunk, F.lit(UNITS), F.lit(0))
    return F.length(F.array_join(F.slice(units, F.lit(1), (skip + carried).cast("int")), "")).cast("bigint")


def draws(id_col: str, seed: int) -> list[Column]:
    """Four 32-bit draws of a document: the first 8-digit groups of the hex sha256 of ``seed:id``; a null id counts as the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def form_of(marked: Column, empty: Column, h3: Column, h4: Column, rate: int, spm: int) -> Column:
    return F.when(empty | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")


def has_mark(text: Column) -> Column:
    return F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))


def assembled(form: Column, prefix: Column, middle: Column, suffix: Column, text: Column) -> Column:
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    return F.when(form == "plain", text).when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))


def restored(output: Column, form: Column) -> Column:
    """The text from its output: parts end at the next mark, which no part holds."""
    body = F.substr(output, F.lit(4))
    parted = lambda mark: F.substring_index(body, mark, 1)
    first = F.when(form == "psm", parted(SUFFIX)).otherwise(parted(PREFIX))
    rest = F.substr(body, F.length(first) + 4)
    second = F.substring_index(rest, MIDDLE, 1)
    middle = F.substr(rest, F.length(second) + 4)
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def in_rows(docs: DataFrame, seed: int, rate: int, spm: int) -> DataFrame:
    """Texts that stay in their rows: doc_id, n, form, prefix, middle, suffix, output."""
    h = draws("doc_id", seed)
    d = docs.withColumn("chunks", cut_up(F.col("text"), CHUNK)).withColumn("scan", entered(F.transform("chunks", chunk_map)))
    end = F.element_at("scan", -1)
    d = d.withColumn("n", end["units"]).withColumn("form", form_of(has_mark(F.col("text")), F.col("text") == "", h[2], h[3], rate, spm))
    d = d.withColumn("a", h[0] % (F.col("n") + 1)).withColumn("b", h[1] % (F.col("n") + 1))

    def place(u: Column) -> Column:
        # the last chunk with no more units before it than u, or the end of the text
        at = F.size(F.filter("scan", lambda e: e["units"] <= u))
        e, chunk = F.element_at("scan", at), F.element_at("chunks", at)
        return F.when(u == F.col("n"), end["chars"]).otherwise(e["chars"] + place_in_chunk(chunk, e["inside"], u - e["units"]))

    cut = F.when(F.col("form") != "plain", F.struct(place(F.least("a", "b")).alias("p"), place(F.greatest("a", "b")).alias("q")))
    d = d.withColumn("cut", cut)
    part = lambda start, length: F.substr("text", (start + 1).cast("int"), length.cast("int"))
    p, q = F.col("cut.p"), F.col("cut.q")
    d = d.select("doc_id", "text", "n", "form", part(F.lit(0), p).alias("prefix"), part(p, q - p).alias("middle"), part(q, end["chars"] - q).alias("suffix"))
    return d.withColumn("output", assembled(F.col("form"), F.col("prefix"), F.col("middle"), F.col("suffix"), F.col("text"))).drop("text")


def in_pieces(docs: DataFrame, seed: int, rate: int, spm: int) -> DataFrame:
    """Giant texts: a row for each piece of an output, in parts P, M and S: row, doc_id, n, form, prefix_chars, middle_chars, part, c
    (the chunk, -1 for a part's mark), text. The texts are written once as chunks in the shared folder."""
    chunks = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", has_mark(F.col("text")).alias("marked"), F.posexplode(cut_up(F.col("text"), PIECE)).alias("c", "text"))
    pieces = materialise(chunks, "fim-pieces")
    maps = pieces.select("row", "doc_id", "marked", "c", chunk_map(F.col("text")).alias("m")).select("row", "doc_id", "marked", "c", "m.*")
    by_row = Window.partitionBy("row").orderBy("c")
    # both states lead to one, so a chunk's entry state is its neighbour's; counts then add up
    inside = F.coalesce(F.lag("from_out").over(by_row), F.lit(False))
    units = F.when(F.col("inside"), F.col("n_in")).otherwise(F.col("n_out"))
    scan = maps.withColumn("inside", inside).withColumn("units", units)
    before = by_row.rowsBetween(Window.unboundedPreceding, -1)
    scan = scan.withColumn("before", F.coalesce(F.sum("units").over(before), F.lit(0))).withColumn("chars_before", F.coalesce(F.sum("chars").over(before), F.lit(0)))
    h = draws("doc_id", seed)
    whole = scan.groupBy("row", "doc_id", "marked").agg(F.sum("units").alias("n"), F.sum("chars").alias("size")).withColumn("form", form_of(F.col("marked"), F.lit(False), h[2], h[3], rate, spm))
    whole = whole.withColumn("a", h[0] % (F.col("n") + 1)).withColumn("b", h[1] % (F.col("n") + 1)).select("row", "n", "size", "form", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    wanted = whole.where("form <> 'plain'").select("row", F.explode(F.array(F.struct(F.lit("p").alias("which"), F.col("u").alias("cut")), F.struct(F.lit("q").alias("which"), F.col("v").alias("cut")))).alias("x")).select("row", "x.*")
    held = wanted.join(scan, "row").where("before <= cut and cut < before + units").select("row", "which", "c", "inside", (F.col("cut") - F.col("before")).alias("skip"), "chars_before")
    found = held.join(pieces.select("row", "c", "text"), ["row", "c"]).select("row", "which", (F.col("chars_before") + place_in_chunk(F.col("text"), F.col("inside"), F.col("skip"))).alias("place"))
    places = found.groupBy("row").agg(F.max(F.when(F.col("which") == "p", F.col("place"))).alias("p"), F.max(F.when(F.col("which") == "q", F.col("place"))).alias("q"))
    cuts = whole.join(places, "row", "left").select("row", "n", "form", F.when(F.col("form") != "plain", F.coalesce("p", "size")).alias("p"), F.when(F.col("form") != "plain", F.coalesce("q", "size")).alias("q"))
    lined = pieces.join(scan.select("row", "c", "chars_before"), ["row", "c"]).join(cuts, "row")
    at, p, q = F.col("chars_before"), F.col("p"), F.col("q")
    inner = lambda a, b: F.substr("text", (F.greatest(a - at, F.lit(0)) + 1).cast("int"), F.greatest(b - F.greatest(a, at), F.lit(0)).cast("int"))
    end = at + F.length("text")
    part = lambda name, a, b, text: F.struct(F.lit(name).alias("part"), F.col("c").alias("c"), text.alias("text"))
    plain = F.array(part("P", at, end, F.col("text")))
    three = F.array(part("P", at, p, inner(at, F.least(p, end))), part("M", p, q, inner(p, F.least(q, end))), part("S", q, end, inner(q, end)))
    marks = F.array(*[F.struct(F.lit(k).alias("part"), F.lit(-1).alias("c"), F.lit(m).alias("text")) for k, m in (("P", PREFIX), ("M", MIDDLE), ("S", SUFFIX))])
    rows = F.when(F.col("form") == "plain", plain).otherwise(F.when(F.col("c") == 0, F.concat(marks, three)).otherwise(three))
    out = lined.select("row", "doc_id", "n", "form", p.alias("prefix_chars"), (q - p).alias("middle_chars"), F.explode(rows).alias("x"))
    return out.select("row", "doc_id", "n", "form", "prefix_chars", "middle_chars", "x.*").where("text <> ''")


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The digest columns of ``in_pieces``: pieces are sorted by document and streamed; no task holds a whole text."""
    place = lambda *order: F.when(F.col("part") == order[0], 0).when(F.col("part") == order[1], 1).otherwise(2)
    lined = pieces.withColumn("o", F.when(F.col("form") == "spm", place("S", "P")).otherwise(place("P", "S")))
    back = pieces.where("c >= 0").withColumn("o", place("P", "M"))  # marks tell the parts apart; the text is their natural order
    both = lined.withColumn("kind", F.lit(0)).unionByName(back.withColumn("kind", F.lit(1)))
    dealt = both.repartition("row", "kind").sortWithinPartitions("row", "kind", "o", "c")
    names = ["row", "kind", "doc_id", "n", "form", "prefix_chars", "middle_chars", "sha"]

    def run(batches):
        key, held, sha = None, None, None
        for b in batches:
            for r in b.to_pylist():
                if (r["row"], r["kind"]) != key:
                    if key is not None:
                        yield made([(*held, sha.hexdigest())])
                    key, sha = (r["row"], r["kind"]), hashlib.sha256()
                    held = tuple(r[k] for k in names[:-1])
                sha.update(r["text"].encode())
        if key is not None:
            yield made([(*held, sha.hexdigest())])

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    done = dealt.mapInArrow(run, "row bigint, kind int, doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, sha string")
    sha = lambda k: F.max(F.when(F.col("kind") == k, F.col("sha")))
    return done.groupBy("row", "doc_id", "n", "form", "prefix_chars", "middle_chars").agg(sha(0).alias("output_sha256"), sha(1).alias("restored_sha256")).drop("row")


def _thin(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def transform(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix, middle, suffix and output of every row, in its row.

    Of 100 documents about ``rate`` are cut, ``spm`` of 100 of those with the suffix first. Null counts as the empty text,
    which stays plain, as do texts that hold a mark; plain rows have null parts. Every row gives one row, repeated rows
    too; rows of one id are cut alike where their texts are. A null id is drawn like an empty one. An empty table gives
    no rows; other columns are not looked at.
    """
    return in_rows(_thin(docs), seed, rate, spm)


def digest(docs: DataFrame, giant: int = GIANT, seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """The digest columns of every row, texts of more than ``giant`` code points spread over tasks."""
    text_batches(docs.sparkSession)
    thin = _thin(docs)
    rows = in_rows(thin.where(F.length("text") <= giant), seed, rate, spm)
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    chars = lambda c: F.length(c).cast("bigint")
    short = rows.select("doc_id", "n", "form", chars(F.col("prefix")).alias("prefix_chars"), chars(F.col("middle")).alias("middle_chars"), sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
    return short.unionByName(piece_digests(in_pieces(thin.where(F.length("text") > giant), seed, rate, spm)))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


LETTERS = "regexp_replace(t, '[A-Za-z]+', 'a', 'g')"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
n AS (SELECT *, CAST(length({LETTERS}) AS BIGINT) AS n FROM u),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM n),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM f),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""
