"""Documents to blocks and chunks [S7, S8, E7-E9, F10, U3, U4, W6, W11-W13, X21]."""

from __future__ import annotations

from html.parser import HTMLParser
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import format_table, likely_header, strip_glyphs, strip_section_prefix, trimmed, verbatim_span, word_count
from lodestone.plans.shared import materialise, release, text_batches

MIN_WORDS, MAX_WORDS = 100, 350
#: Consecutive places that one task sums, and lines of a document that are grouped in its row.
BLOCK_ROWS, LONG_LINES = 100_000, 5000
#: Pages whose blocks a Python worker holds at a time.
PAGES = 50


class Blocks(HTMLParser):
    """Headings and paragraphs of a page in order. Text counts inside paragraph tags only; scripts, styles, navigation and
    page furniture are skipped; an unclosed paragraph ends where the next block starts. Tags are parameters, so other
    page families need no other machine."""

    def __init__(self, headings=("h1", "h2", "h3"), paragraphs=("p", "li"), skip=("script", "style", "nav", "footer", "header", "aside"), skip_classes=("ad",), stop=None):
        super().__init__(convert_charrefs=True)
        self.headings, self.paragraphs, self.skip, self.skip_classes, self.stop = headings, paragraphs, skip, skip_classes, stop
        self.blocks: list[tuple[str, str]] = []
        self.kind: str | None = None
        self.buffer: list[str] = []
        self.skipping: list[str] = []
        self.done = False

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text and self.kind and not self.done:
            self.done = self.stop is not None and text == self.stop
            if not self.done:
                self.blocks.append((self.kind, text))
        self.buffer, self.kind = [], None

    def handle_starttag(self, tag, attrs):
        if self.skipping:
            if tag == self.skipping[0]:
                self.skipping.append(tag)
            return
        if tag in self.skip or set((dict(attrs).get("class") or "").split()) & set(self.skip_classes):
            self.flush()
            self.skipping = [tag]
        elif tag in self.headings or tag in self.paragraphs:
            self.flush()
            self.kind = "heading" if tag in self.headings else "paragraph"
        elif tag == "br" and self.kind:
            self.buffer.append(" ")

    def handle_endtag(self, tag):
        if self.skipping:
            if tag == self.skipping[0]:
                self.skipping.pop()
        elif tag in self.headings or tag in self.paragraphs or tag in ("div", "article", "section", "body"):
            self.flush()

    def handle_data(self, data):
        if self.kind and not self.skipping:
            self.buffer.append(data)


def page_blocks(pages: DataFrame) -> DataFrame:
    """[S8] page_id, i, kind, text of every block; an unparsable or null page has none. A parser is needed, so this runs in Arrow
    batches, of few pages as these are texts; a batch's blocks are passed on some pages at a time."""
    text_batches(pages.sparkSession)
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, PAGES):
                out: list[list] = [[] for _ in types]
                for pid, html in zip(*(b.column(c).slice(at, PAGES).to_pylist() for c in (0, 1))):
                    p = Blocks()
                    p.feed(html or "")
                    p.close()
                    p.flush()
                    for i, (kind, text) in enumerate(p.blocks):
                        for col, v in zip(out, (pid, i, kind, text)):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["page_id", "i", "kind", "text"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "html").mapInArrow(run, "page_id bigint, i bigint, kind string, text string")


def groups_of_words(sizes, most: int = MAX_WORDS):
    """[W11] a group number for each size of an array: a new group starts where a non-empty one would exceed ``most``. The fold
    keeps the groups' first places only, and the numbers are spread out at the end."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("at"), zero.alias("w"), F.array(F.lit(0).cast("bigint")).alias("firsts"))

    def fold(s, n):
        n = n.cast("bigint")
        new = (s["w"] > 0) & (s["w"] + n > most)
        firsts = F.when(new, F.concat(s["firsts"], F.array(s["at"]))).otherwise(s["firsts"])
        return F.struct((s["at"] + 1).alias("at"), F.when(new, n).otherwise(s["w"] + n).alias("w"), firsts.alias("firsts"))

    def spread(s):
        ends = F.concat(F.slice(s["firsts"], 2, F.size(s["firsts"])), F.array(s["at"]))
        places = F.sequence(F.lit(1), F.size(s["firsts"]))
        numbers = F.transform(places, lambda i: F.array_repeat(i - 1, (F.element_at(ends, i) - F.element_at(s["firsts"], i)).cast("int")))
        return F.flatten(numbers)

    return F.aggregate(sizes, start, fold, spread)


def segmented_sums(rows: DataFrame, key: str, order: str, value: str, block: int = BLOCK_ROWS) -> DataFrame:
    """[W8, W12] ``rows`` with ``before``: the sum of ``value`` over earlier rows of the key. Two levels: places are summed inside
    blocks of ``block`` consecutive values of ``order`` (whole numbers, each once in its key), and block totals, a row each, between
    blocks; so a hot key is spread over tasks."""
    placed = rows.withColumn("_b", F.floor(F.col(order) / F.lit(block)))
    inner = Window.partitionBy(key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(key, F.floor(F.col(order) / F.lit(block)).alias("_b")).agg(F.sum(value).alias("_t"))
    outer = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select(F.col(key).alias("_k"), F.col("_b").alias("_o"), F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_f"))
    own = placed.withColumn("_s", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    both = own.join(firsts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_o")))
    return both.withColumn("before", F.col("_s") + F.col("_f")).drop("_b", "_s", "_k", "_o", "_f")


def next_starts(lines: DataFrame, key: str, most: int) -> DataFrame:
    """key, n, next: where a group that starts at each line ends (the place after the last line for the last group). ``lines``: key, n
    (from 0), words, before (as of ``segmented_sums``). The line that holds the first word beyond the budget is met by an
    equi-join on buckets of ``most`` words; a line longer than the budget is a group with the empty lines before it."""
    spans = lines.where("words > 0").select(key, F.col("n").alias("m"), F.col("before").alias("low"), (F.col("before") + F.col("words")).alias("high"))
    held = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / most), F.floor((F.col("high") - 1) / most))))
    asked = lines.select(F.col(key).alias("_k"), "n", "before", (F.col("before") + most).alias("beyond")).withColumn("_b", F.floor(F.col("beyond") / most))
    met = asked.join(held, F.col("_k").eqNullSafe(F.col(key)) & (F.col("_b") == F.col("bucket"))).where("low <= beyond and beyond < high")
    return met.select(key, "n", F.when(F.col("low") == F.col("before"), F.col("m") + 1).otherwise(F.col("m")).alias("next"))


def group_starts(lines: DataFrame, key: str, most: int = MAX_WORDS) -> DataFrame:
    """[W11] key, n of every group's first line, by pointer doubling: the lines reached so far are joined with pointers that skip twice
    as many groups in each round, so rounds grow with the logarithm of a document's groups and no task folds a document."""
    last = lines.groupBy(key).agg(F.max("n").alias("last"))
    jumps = next_starts(lines, key, most).join(last, key).where("next <= last").select(key, "n", "next")
    jumps = materialise(jumps, "jumps")
    reached = materialise(lines.where("n = 0").select(key, "n"), "reached")
    while not jumps.isEmpty():
        before = reached, jumps
        more = reached.join(jumps, [key, "n"]).select(key, F.col("next").alias("n"))
        reached = materialise(reached.union(more).distinct(), "reached")
        far = jumps.select(F.col(key).alias("_k"), F.col("n").alias("_n"), F.col("next").alias("_far"))
        jumps = materialise(jumps.join(far, (F.col(key) == F.col("_k")) & (F.col("next") == F.col("_n"))).select(key, "n", F.col("_far").alias("next")), "jumps")
        release(*before)
    return reached


def long_groups(lines: DataFrame, key: str, most: int = MAX_WORDS) -> DataFrame:
    """``lines`` (key, not null; n from 0 without gaps; words) with ``grp``, equal to ``groups_of_words`` but spread over tasks."""
    summed = materialise(segmented_sums(lines, key, "n", "words"), "summed")
    starts = group_starts(summed, key, most).withColumn("first", F.lit(1))
    marked = summed.join(starts, [key, "n"], "left").withColumn("first", F.coalesce("first", F.lit(0)))
    counted = segmented_sums(marked.drop("before"), key, "n", "first")
    return counted.select(*lines.columns, (F.col("before") + F.col("first") - 1).alias("grp"))


def grouped_lines(docs: DataFrame, key: str, sizes: str, most: int = MAX_WORDS, long: int = LONG_LINES) -> DataFrame:
    """[W11, E7] key, n, words, grp for every line of ``docs`` (key, and an array of the lines' words): documents of up to ``long`` lines
    are grouped in their row, longer ones over tasks."""
    short = docs.where(F.size(sizes) <= long)
    z = short.select(key, F.posexplode(F.arrays_zip(F.col(sizes).alias("words"), groups_of_words(F.col(sizes), most).alias("grp"))).alias("n", "x"))
    inside = z.select(key, F.col("n").cast("bigint").alias("n"), F.col("x.words").cast("bigint").alias("words"), F.col("x.grp").cast("bigint").alias("grp"))
    far = docs.where(F.size(sizes) > long)
    if far.isEmpty():
        return inside
    lines = far.select(key, F.posexplode(sizes).alias("n", "words")).select(key, F.col("n").cast("bigint").alias("n"), F.col("words").cast("bigint").alias("words"))
    return inside.unionByName(long_groups(lines, key, most).select(key, "n", "words", "grp"))


def offsets(blocks: DataFrame, key: str, order: str, joint: int = 2) -> DataFrame:
    """[W12] char_start and char_end of each block in the canonical text, which joins blocks by ``joint`` characters. ``order`` holds
    whole numbers, each once in its key."""
    summed = segmented_sums(blocks.withColumn("_size", F.length("text") + joint), key, order, "_size")
    return summed.withColumn("char_start", F.col("before")).withColumn("char_end", F.col("before") + F.length("text")).drop("before", "_size")


def page_texts(pages: DataFrame, tables: DataFrame, least: int = 10) -> DataFrame:
    """[S7, U4] doc, page, place, kind, text: each page's cleaned text (place 0), then its tables of ``least`` words or more as
    pages of their own. ``pages``: doc, page, text; ``tables``: doc, page, idx (from 1), rows (arrays of cells). Blank pages
    are left out, their tables are not."""
    text = trimmed(strip_glyphs(F.coalesce("text", F.lit(""))))
    plain = pages.select("doc", "page", F.lit(0).alias("place"), F.lit("text").alias("kind"), text.alias("text")).where("text <> ''")
    cells = tables.select("doc", "page", F.col("idx").cast("int").alias("place"), F.lit("table").alias("kind"), format_table(F.col("rows")).alias("text"))
    return plain.unionByName(cells.where(word_count(F.col("text")) >= least))


def statute_chunks(blocks: DataFrame) -> DataFrame:
    """[E8, U3] chunks of pages' articles: paragraphs below a heading in groups of at most MAX_WORDS, title first, later parts
    marked as continued; with chunk_id and place in the canonical text. ``blocks``: page_id, i, kind, text."""
    by_page = Window.partitionBy("page_id").orderBy("i")
    titled = blocks.withColumn("title", F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(by_page)).withColumn("article", F.sum((F.col("kind") == "heading").cast("int")).over(by_page))
    paras = titled.where("kind = 'paragraph'").groupBy("page_id", "article").agg(F.first("title", ignorenulls=True).alias("title"), F.array_sort(F.collect_list(F.struct("i", "text"))).alias("ps"))
    grouped = paras.withColumn("g", groups_of_words(F.transform("ps", lambda p: word_count(p["text"]))))
    parts = grouped.select("page_id", "article", "title", (F.array_max("g") + 1).alias("parts"), F.explode(F.arrays_zip("ps", "g")).alias("x"))
    body = parts.groupBy("page_id", "article", "title", "parts", F.col("x.g").alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x.ps.i", "x.ps.text"))), lambda p: p["text"]), "\n\n").alias("body"))
    head = F.when(F.col("part") == 0, F.col("title")).otherwise(F.concat("title", F.lit(" (cont.)")))
    label = F.when(F.col("parts") == 1, F.col("title")).otherwise(F.concat("title", F.lit(" (part "), (F.col("part") + 1).cast("string"), F.lit(")")))
    chunks = body.withColumn("text", F.when(F.col("title").isNull(), F.col("body")).otherwise(F.concat(head, F.lit("\n\n"), F.col("body")))).withColumn("section_title", label)
    numbered = chunks.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("article", "part")) - 1)
    placed = offsets(numbered, "page_id", "n")
    return placed.select("page_id", F.format_string("%d_chunk_%d", "page_id", "n").alias("chunk_id"), "n", "section_title", "text", "char_start", "char_end")


def canonical_text(chunks: DataFrame) -> DataFrame:
    """[K6] page_id, canonical_text, sha256, chunk_count."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda c: c["text"]), "\n\n")
    return chunks.groupBy("page_id").agg(whole.alias("canonical_text"), F.count("*").alias("chunk_count")).withColumn("sha256", F.sha2("canonical_text", 256))


def pin_chunks(chunks: DataFrame, canonical: DataFrame, key: str = "page_id") -> DataFrame:
    """[E9] place of each chunk's body in the canonical text: the whole body, else its first 200 characters, else -1."""
    body = F.col("_body")
    j = chunks.withColumn("_body", trimmed(strip_section_prefix(F.col("text")))).join(canonical.select(key, "canonical_text"), key)
    full, part = verbatim_span(body, F.col("canonical_text")), verbatim_span(F.left(body, F.lit(200)), F.col("canonical_text"))
    span = F.coalesce(full, part)
    return j.withColumn("char_start", F.coalesce(span["start"], F.lit(-1))).withColumn("char_end", F.coalesce(span["end"], F.lit(-1))).drop("_body", "canonical_text")


def without_navigation(lines: DataFrame, is_nav, is_artifact, key: str = "doc_id", order: str = "n") -> DataFrame:
    """[F10, W6] lines less artifacts, and less navigation fragments that have another beside them."""
    w = Window.partitionBy(key).orderBy(order)
    marked = lines.withColumn("_nav", is_nav)
    beside = F.coalesce(F.lag("_nav").over(w), F.lit(False)) | F.coalesce(F.lead("_nav").over(w), F.lit(False))
    return marked.withColumn("_beside", beside).where(~is_artifact & ~(F.col("_nav") & F.col("_beside"))).drop("_nav", "_beside")


def clean_page_text(c):
    """[X13]"""
    return trimmed(strip_glyphs(c))


def section_chunks(paragraphs: DataFrame, known: list[str]) -> DataFrame:
    """[E7, W13, X16] chunks of MIN_WORDS to MAX_WORDS words of paginated documents. ``paragraphs``: doc_id, page, n, text.

    Headers are found and carried forward in Spark. What remains depends on a running buffer, so each document is folded
    by itself: a header closes a buffer that is long enough, a shorter one goes on into the new section; a buffer that
    would be too long is closed if long enough and the rest cut at sentences; the end of a page adds a short rest to the
    page's last chunk.
    """
    first = F.trim(F.split_part("text", F.lit("\n"), F.lit(1)))
    headed = paragraphs.withColumn("header", F.when(likely_header(first, known), first))
    carried = headed.withColumn("section", F.coalesce(F.last("header", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("page", "n")), F.lit("Introduction")))

    def fold(doc_id, rows: list[dict]) -> list[tuple]:
        out: list[list] = []
        size = lambda t: len(t.split())
        for page, here in groupby(rows, lambda r: r["page"]):
            # what is held is kept as pieces with their words counted, so a line is split once
            held, words, section = [], 0, None
            for r in here:
                text = r["text"]
                if r["header"] is not None and words >= MIN_WORDS:
                    out.append(["".join(held), page, section])
                    held, words = [], 0
                section = r["section"]
                more = size(text)
                if words + more <= MAX_WORDS:
                    # an empty buffer takes the text as it is
                    held += ["\n\n", text] if any(held) else [text]
                    words += more
                    continue
                if words >= MIN_WORDS:
                    out.append(["".join(held), page, section])
                    both = text
                else:
                    both = "".join([*held, "\n\n", text] if any(held) else [text])
                rest, words = "", 0
                for s in both.replace(". ", ".\n").split("\n"):
                    more = size(s)
                    if rest and words + more > MAX_WORDS:
                        out.append([rest, page, section])
                        rest, words = s, more
                    else:
                        rest, words = f"{rest} {s}".strip(), words + more
                held = [rest]
            last = "".join(held)
            if last.strip():
                if words < MIN_WORDS and out and out[-1][1] == page:
                    out[-1][0] += "\n\n" + last
                else:
                    out.append([last, page, section])
        return [(doc_id, i, p, s, t if t.startswith(s) else f"[{s}]\n\n{t}") for i, (t, p, s) in enumerate(out)]

    names, types = ["doc_id", "n", "page", "section_title", "text"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            for doc_id, rows in zip(b.column(0).to_pylist(), b.column(1)):
                found = fold(doc_id, rows.as_py())
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    # a document is a row: a group of its own would cost Python more than the fold does
    text_batches(paragraphs.sparkSession)
    rows = F.array_sort(F.collect_list(F.struct("page", "n", F.coalesce("text", F.lit("")).alias("text"), "header", "section")))
    docs = carried.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(rows.alias("rows"))
    return docs.mapInArrow(run, "doc_id bigint, n bigint, page bigint, section_title string, text string")
