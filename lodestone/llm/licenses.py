"""Operator 3: license scans by ordered signature rules over a text's words.

Rules are regular expressions over the lower-cased words joined by single spaces (``license_rules``): names and short forms
of licenses, passages of license texts, identifiers, weak notices. A rule is tried only where one of its keywords occurs.
A form of reference right before a name widens its detection and raises its priority. Detections are taken by priority,
then length; one that lies within a detection taken before is suppressed. All steps are linear in the text, but for a
logarithm.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.license_rules import FORMS, NAMES, PASSAGES, WEAK, V
from lodestone.plans.session import table
from lodestone.plans.shared import text_batches

# Base phrases with labels; labels that "mit" and others have after a word that makes them a license.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
SHORT = r"(?:licen[cs]e|licen[cs]es|licen[cs]ed under|under|license type)(?: is| the)? (mit|isc|bsd|zlib|wtfpl|unlicense)(?! license)"
SHORT_LABELS = {"mit": "MIT", "isc": "ISC", "bsd": "BSD", "zlib": "Zlib", "wtfpl": "WTFPL", "unlicense": "Unlicense"}
#: Words of a text: lower-cased ASCII letters and digits and every byte of a character beyond ASCII.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@lru_cache(maxsize=1)
def rules() -> list[tuple[int, float, str, tuple[str, ...], re.Pattern]]:
    """(priority, confidence, label, keywords, pattern) in order of priority."""
    lines = [(5, 0.8, line) for line in NAMES.strip().splitlines()] + [(3, 0.9, line) for line in PASSAGES.strip().splitlines()] + [(6, c, line) for c, line in WEAK]
    out = []
    for p, c, line in lines:
        label, keywords, pattern = line.split(" | ", 2)
        out.append((p, c, label, tuple(keywords.split(",")), pattern.replace("V", V + " ?")))
    for label in sorted({r[2] for r in out if r[0] == 5}):
        tag = re.sub(r"[^a-z0-9]+", " ", label.lower())
        out.append((1, 1.0, label, ("spdx",), rf"spdx license identifier {tag}(?: only| or later)?"))
    out.sort(key=lambda r: r[0])
    return [(p, c, label, keywords, re.compile(rf"(?<= ){pattern}(?= )")) for p, c, label, keywords, pattern in out]


@lru_cache(maxsize=1)
def by_keyword() -> dict[str, list[int]]:
    """Numbers of the rules that a keyword opens."""
    out: dict[str, list[int]] = {k: [] for k in SHORT_LABELS}
    for n, r in enumerate(rules()):
        for k in r[3]:
            out.setdefault(k, []).append(n)
    return out


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Finds all keywords in one pass over a text."""
    found = ahocorasick.Automaton()
    for k in by_keyword():
        found.add_word(k, k)
    found.make_automaton()
    return found


def present_in(words: str) -> set[str]:
    """The keywords that occur."""
    return {k for _, k in automaton().iter(words)}


@lru_cache(maxsize=1)
def forms() -> list[tuple[int, float, re.Pattern]]:
    return [(p, c, re.compile(rf"(?<= ){pattern} ")) for p, c, pattern in FORMS]


def folded(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(FOLD).split())


def uncontained(found: list[tuple]) -> list[tuple]:
    """Of (start, end, ...) in order of precedence those that lie within none taken before, by the largest end of all starts up to a place."""
    starts = sorted({d[0] for d in found})
    reach = [-1] * (len(starts) + 1)
    kept = []
    for d in found:
        at = place = bisect_left(starts, d[0]) + 1
        within = False
        while at and not within:
            within = reach[at] >= d[1]
            at &= at - 1
        if not within:
            kept.append(d)
            while place < len(reach):
                reach[place] = max(reach[place], d[1])
                place += place & -place
    return kept


def detect(words: str, present: set[str]) -> list[tuple[int, int, int, float, str]]:
    """(start, end, priority, confidence, label) that stay, over words padded by spaces; ``present`` are the keywords that occur."""
    known, opened = rules(), sorted({n for k in present for n in by_keyword()[k]})
    found = [(m.start(), m.end(), p, c, label) for p, c, label, _, pattern in map(known.__getitem__, opened) for m in pattern.finditer(words)]
    if not present.isdisjoint(SHORT_LABELS) and ("licen" in words or "under" in words):
        found += [(m.start(), m.end(), 4, 0.9, SHORT_LABELS[m[1]]) for m in re.finditer(rf"(?<= ){SHORT}(?= )", words)]
    if any(d[2] == 5 for d in found):
        before: dict[int, tuple[int, int, float]] = {}
        for p, c, pattern in reversed(forms()):
            before |= {m.end(): (m.start(), p, c) for m in pattern.finditer(words)}
        found = [(*before[d[0]][:1], d[1], *before[d[0]][1:], d[4]) if d[2] == 5 and d[0] in before else d for d in found]
    found.sort(key=lambda d: (d[2], d[0] - d[1], d[0], d[4]))
    return sorted(uncontained(found))


def judge_text(text: str) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    raw = folded(text)
    n = raw.count(b" ") + 1 if raw else 0
    words = f" {raw.decode('utf-8', 'surrogatepass')} "
    present = present_in(words)
    if not present:
        return n, 0, None, None, "", "", 0.0, []
    places = [(m.start(), label) for phrase, label in BASE for m in re.finditer(f"(?= {phrase} )", words)]
    kept = detect(words, present)
    if not places and not kept:
        return n, 0, None, None, "", "", 0.0, []
    spaces = [m.start() for m in re.finditer(" ", words)]
    number = lambda at: bisect_left(spaces, at)  # noqa: E731  of spaces before the place
    starts = [number(at) for at, _ in places]
    base = {label for _, label in places}
    score = max([0.6 * bool(base), *(d[3] for d in kept)])
    return n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {d[4] for d in kept})), score, [(number(a) - 1, number(b), label) for a, b, _, _, label in kept]


def scan(docs: DataFrame, with_detections: bool = False) -> DataFrame:
    """A row for every row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null counts as the empty text, which has no words, empty label strings and score 0. ``with_detections`` adds the
    words (from, to exclusive) and label of each detection that stays.
    """
    text_batches(docs.sparkSession)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
    more = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64()), ("label", pa.string())]))

    def run(batches):
        for b in batches:
            got = [(doc, *judge_text(t)) for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            cols = list(zip(*got)) or [[]] * 9
            arrays = [pa.array(c, t) for c, t in zip(cols[:8], types)]
            if with_detections:
                arrays.append(pa.array([[dict(zip(("first", "past", "label"), d)) for d in x] for x in cols[8]], more))
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "detections"][: len(arrays)])

    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    thin = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return thin.mapInArrow(run, schema + (", detections array<struct<first:bigint,past:bigint,label:string>>" if with_detections else ""))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
