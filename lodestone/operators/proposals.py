"""Amendment proposals [G5-G8, M6, P4, P13, T4, F5, F13]."""

from __future__ import annotations

from bisect import bisect_left
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.plans.shared import materialise

SPANS = "array<struct<op:string,a0:int,a1:int,b0:int,b1:int>>"
MIN_RATIO = 0.3


SPAN = T.StructType([T.StructField("op", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("a0", "a1", "b0", "b1")]])


#: Common runs of this length or more are listed; shorter ones are looked for at each length in turn.
LONG = 7
#: Up to this length common runs that are too many to list are looked for at each length in turn; the longest of more is found by halving.
SHORT_RUN = 16
#: Characters of the pairs that are aligned together.
TOGETHER = 1 << 16
#: Odd numbers, not multiples of each other, that spread characters, places and parts over 32 bits.
MIXED, STEP, SALT = 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35


class Runs:
    """Numbers of all runs of characters of two texts: equal runs of one length have equal numbers. Runs of few characters are numbered by
    those, side by side. Of others, runs of 1, 2, 4, ... characters are numbered as pairs of halves; a run of any other length is a
    pair of such that overlap."""

    def __init__(self, a: str, b: str):
        codes = np.frombuffer((a + b).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.split, self.width = len(a), len(codes) + 1
        if codes.max(initial=0) < 1 << 16:
            seen = np.zeros(1 << 16, dtype=bool)
            seen[codes] = True
            ranks = (np.cumsum(seen) - 1)[codes]
        else:
            ranks = np.unique(codes, return_inverse=True)[1].astype(np.int64)
        self.numbers = [ranks]
        self.bits = max(1, int(ranks.max(initial=0)).bit_length())
        self.hashes = {1: ranks.astype(np.uint32) * np.uint32(MIXED)}

    def few(self, n: int) -> bool:
        return n * self.bits <= 56

    def most(self, n: int) -> int:
        """A number above those of runs of ``n`` characters."""
        return 1 << n * self.bits if self.few(n) else self.width**2

    def at(self, places: np.ndarray, n: int) -> np.ndarray:
        if self.few(n):
            out = self.numbers[0][places]
            for k in range(1, n):
                out = out << self.bits | self.numbers[0][places + k]
            return out
        k = n.bit_length() - 1
        while len(self.numbers) <= k:
            half, low = 1 << (len(self.numbers) - 1), self.numbers[-1]
            self.numbers.append(np.unique(low[:-half] * self.width + low[half:], return_inverse=True)[1].astype(np.int64))
        return self.numbers[k][places] * self.width + self.numbers[k][places + (n - (1 << k))]

    def mixed(self, n: int) -> np.ndarray:
        """32 bits that equal runs of ``n`` characters share, at every place; those of a run follow from those of its two pieces."""
        if n in self.hashes:
            return self.hashes[n]
        tail = 1 << (n - 1).bit_length() - 1
        out = self.mixed(n - tail)[: max(self.width - n, 0)] * np.uint32(pow(STEP, tail, 1 << 32))
        out += self.mixed(tail)[n - tail :]
        if n <= LONG or n == 2 * tail:
            self.hashes[n] = out
        return out

    def common(self, parts: np.ndarray, n: int):
        """Part and start in a of every run of ``n`` characters that the part's other side holds too, in order; starts in b by number of run
        and place, and the first and last of them for each. ``parts``: rows of start and end in a, start and end in b."""
        more = np.maximum(parts[:, [1, 3]] - parts[:, [0, 2]] - n + 1, 0)
        more[(more == 0).any(axis=1)] = 0
        total, mixed = more.sum(axis=0), self.mixed(n)
        start = [np.arange(t) + np.repeat(lo - np.cumsum(c) + c, c) for t, c, lo in zip(total, more.T, (parts[:, 0], parts[:, 2] + self.split))]
        # most runs have no partner: a table of hashes rules them out before anything is numbered or sorted
        bits = min(max(12, int(total.max()).bit_length() + 2), 32)
        salt = np.arange(len(parts), dtype=np.uint32) * np.uint32(SALT)
        x, y = (((mixed[s] + np.repeat(salt, c)) >> np.uint32(32 - bits)).astype(np.int64) for s, c in zip(start, more.T))
        seen = np.zeros((2, 1 << bits), dtype=bool)
        seen[0][y] = True
        maybe = [np.flatnonzero(seen[0][x])]
        seen[1][x[maybe[0]]] = True
        maybe.append(np.flatnonzero(seen[1][y]))
        own = [np.searchsorted(np.cumsum(c), at, "right") for c, at in zip(more.T, maybe)]
        start = [s[at] for s, at in zip(start, maybe)]
        x, y = (self.at(s, n) for s in start)
        if self.most(n) * len(parts) >= 1 << 63:
            both = np.unique(np.concatenate([x, y]), return_inverse=True)[1].astype(np.int64)
            x, y = both[: len(x)], both[len(x) :]
        x, y = x * len(parts) + own[0], y * len(parts) + own[1]
        order = np.argsort(y, kind="stable")
        y, places = y[order], start[1][order] - self.split
        first = np.searchsorted(y, x)
        hit = np.flatnonzero(np.append(y, -1)[first] == x)
        return own[0][hit], start[0][hit], places, first[hit], np.searchsorted(y, x[hit], "right")


def long_runs(runs: Runs, parts: np.ndarray) -> tuple[list[list[tuple[int, int, int]]], np.ndarray]:
    """Common runs of each part, as long as they go and of LONG characters or more: start in a, start in b and length. Parts that
    have too many of them to list come second, as True."""
    own, starts, places, first, last = runs.common(parts, LONG)
    size, count = (parts[:, 1] - parts[:, 0]) + (parts[:, 3] - parts[:, 2]), last - first
    many = np.bincount(own, count, len(parts)) > np.minimum(8 * size + 4096, 1 << 22)
    few = ~many[own]
    own, starts, first, count = own[few], starts[few], first[few], count[few]
    i = np.repeat(starts, count)
    j = places[np.arange(len(i)) + np.repeat(first - np.cumsum(count) + count, count)]
    # a run that goes on is a place and the next one on the same diagonal
    key = np.sort((j - i + runs.width) * runs.width + i)
    new = np.flatnonzero(np.diff(key, prepend=-2) != 1)
    n = np.diff(new, append=len(key)) + LONG - 1
    i = key[new] % runs.width
    j = key[new] // runs.width - runs.width + i
    owner = np.searchsorted(parts[:, 0], i, "right") - 1
    many |= np.bincount(owner, minlength=len(parts)) > size // 2 + 256
    order = np.argsort(owner, kind="stable")
    ends = np.searchsorted(owner[order], np.arange(len(parts) + 1)).tolist()
    rows = list(zip((-n[order]).tolist(), i[order].tolist(), j[order].tolist()))
    return [rows[x:y] for x, y in zip(ends, ends[1:])], many


def take(part: list[int], rows: list[tuple[int, int, int]], found: list) -> list[tuple]:
    """The parts that are left of one when its common ``rows`` (length below 0, start in a, start in b) are taken, the longest first.

    What a taken run cuts from another one is at its ends: no run passes from the part before the taken one to the part behind it, as it
    would be longer."""
    left = [tuple(part)]
    heapify(rows)
    while rows:
        n, i, j = heappop(rows)
        n = -n
        at = max(bisect_left(left, (i + 1,)) - 1, 0)
        while at < len(left) and left[at][0] < i + n:
            alo, ahi, blo, bhi = left[at]
            low, high = max(0, alo - i, blo - j), min(n, ahi - i, bhi - j)
            if low < high:
                if high - low == n:
                    found.append((i, j, n))
                    left[at : at + 1] = [(alo, i, blo, j), (i + n, ahi, j + n, bhi)]
                elif high - low >= LONG:
                    heappush(rows, (low - high, i + low, j + low))
                break
            at += 1
    return left


def by_length(runs: Runs, parts: np.ndarray, least: int, found: list) -> np.ndarray:
    """The parts that are left when common runs of ``least`` characters or more are taken, by length in all parts at once."""
    most, longest = least, int(np.minimum(parts[:, 1] - parts[:, 0], parts[:, 3] - parts[:, 2]).max(initial=0))
    while most < longest and len(runs.common(parts, most)[0]):
        most = min(2 * most, longest)
    while most >= least and len(parts):
        held = runs.common(parts, most)
        if most > max(least, SHORT_RUN) and not len(held[0]):
            low, high = least - 1, most - 1  # runs of low may be there, runs above high are not
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if len(runs.common(parts, middle)[0]) else (low, middle - 1)
            most = low
            continue
        if len(held[0]):
            parts = without(parts, most, held, found)
        most -= 1
    return parts


def aligned(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Rows of pair, start in a, start in b and length: difflib's matching blocks of pairs of texts that are neither equal nor empty.

    A block is the longest common run, the first in a and then in b, then the same to its left and to its right. Which part goes first
    does not matter, so runs are taken by length, the longest first: those of LONG characters or more from a list, then
    shorter ones in all parts of all pairs at once, in a part from left to right, each behind the one before. What is left
    between runs of one length holds shorter runs only.
    """
    ends = np.cumsum([[0, 0], *[(len(a), len(b)) for a, b in pairs]], axis=0)
    runs = Runs("".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    parts = np.concatenate([ends[:-1, :1], ends[1:, :1], ends[:-1, 1:], ends[1:, 1:]], axis=1)
    listed, many = long_runs(runs, parts)
    found: list[tuple[int, int, int]] = []
    left = [x for part, rows, m in zip(parts.tolist(), listed, many.tolist()) if not m for x in take(part, rows, found)]
    left += by_length(runs, parts[many], LONG, found).tolist()
    left = np.array([x for x in left if x[0] < x[1] and x[2] < x[3]], dtype=np.int64).reshape(-1, 4)
    for n in range(LONG - 1, 0, -1):
        held = runs.common(left, n)
        if len(held[0]):
            left = without(left, n, held, found)
    i, j, n = np.array(sorted(found), dtype=np.int64).reshape(-1, 3).T
    pair = np.searchsorted(ends[:, 0], i, "right") - 1
    on = (pair[1:] == pair[:-1]) & (i[1:] == i[:-1] + n[:-1]) & (j[1:] == j[:-1] + n[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~on])[: len(i)])
    pair = pair[first]
    return np.stack([pair, i[first] - ends[pair, 0], j[first] - ends[pair, 1], np.add.reduceat(n, first) if len(first) else n], axis=1)


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """difflib's matching blocks of two texts."""
    if a == b or not a or not b:
        return [(0, 0, len(a))] if a and a == b else []
    return [tuple(x) for x in aligned([(a, b)])[:, 1:].tolist()]


def without(parts: np.ndarray, n: int, held, found: list) -> np.ndarray:
    """The parts that are left when runs of ``n`` characters are taken, which are added to ``found``. ``held``: as of ``Runs.common``."""
    own, starts, places, first, last = held
    new = np.flatnonzero(np.diff(own, prepend=-1))
    cut = own[new]
    places, left = places.tolist(), []
    ends = [*new[1:].tolist(), len(own)]
    hits = zip(starts.tolist(), first.tolist(), last.tolist())
    for (i, ahi, j, bhi), count in zip(parts[cut].tolist(), np.diff(ends, prepend=0).tolist()):
        for at, low, high in islice(hits, count):
            if at >= i:
                k = bisect_left(places, j, low, high)
                if k < high:
                    to = places[k]
                    found.append((at, to, n))
                    if i < at and j < to:
                        left.append((i, at, j, to))
                    i, j = at + n, to + n
        if i < ahi and j < bhi:
            left.append((i, ahi, j, bhi))
    kept = np.ones(len(parts), dtype=bool)
    kept[cut] = False
    return np.concatenate([parts[kept], np.array(left, dtype=np.int64).reshape(-1, 4)])


def differences(pairs: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """difflib's ratios of pairs of texts; the pairs of its operations other than equal; their rows of start and end in a, start and end in b."""
    sizes = np.array([(len(a), len(b)) for a, b in pairs], dtype=np.int64).reshape(-1, 2)
    rows = [np.column_stack([np.arange(len(pairs)), sizes, np.zeros(len(pairs), dtype=np.int64)])]
    group: list[int] = []
    held = 0
    for k, (a, b) in enumerate(pairs):
        if a == b:
            rows.append(np.array([[k, 0, 0, len(a)]]))
        elif a and b:
            if group and held + len(a) + len(b) > TOGETHER:
                rows.append(within(pairs, group))
                group, held = [], 0
            group.append(k)
            held += len(a) + len(b)
    if group:
        rows.append(within(pairs, group))
    pair, i, j, n = (found := np.concatenate(rows))[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))].T
    same = np.bincount(pair, n, len(pairs))
    total = sizes.sum(axis=1)
    ratio = np.divide(2.0 * same, total, out=np.ones(len(pairs)), where=total > 0)
    goes_on = np.concatenate([[False], pair[1:] == pair[:-1]])[: len(pair)]
    a0, b0 = np.where(goes_on, np.roll(i + n, 1), 0), np.where(goes_on, np.roll(j + n, 1), 0)
    changed = (a0 < i) | (b0 < j)
    return ratio, pair[changed], np.stack([a0, i, b0, j], axis=1)[changed]


def within(pairs: list[tuple[str, str]], group: list[int]) -> np.ndarray:
    found = aligned([pairs[k] for k in group])
    found[:, 0] = np.array(group)[found[:, 0]]
    return found


def operations(spans: np.ndarray) -> list[str]:
    kind = np.where(spans[:, 0] == spans[:, 1], "insert", np.where(spans[:, 2] == spans[:, 3], "delete", "replace"))
    return kind.tolist()


def changes(a: str, b: str) -> tuple[float, list[dict]]:
    """difflib's ratio of two texts and its operations other than equal."""
    ratio, _, spans = differences([(a, b)])
    return float(ratio[0]), [dict(zip(("op", "a0", "a1", "b0", "b1"), (op, *span))) for op, span in zip(operations(spans), spans.tolist())]


@F.arrow_udf(T.StructType([T.StructField("ratio", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN))]))
def compare(anchor: pa.Array, proposed: pa.Array) -> pa.Array:
    """[G5, M6] character-level similarity and changed spans; no built-in function aligns two texts."""
    ratio, pair, spans = differences([(a or "", b or "") for a, b in zip(anchor.to_pylist(), proposed.to_pylist())])
    columns = [pa.array(operations(spans), pa.string()), *[pa.array(c.astype(np.int32)) for c in spans.T]]
    rows = pa.StructArray.from_arrays(columns, SPAN.names)
    ends = np.searchsorted(pair, np.arange(len(ratio) + 1)).astype(np.int32)
    return pa.StructArray.from_arrays([pa.array(ratio), pa.ListArray.from_arrays(pa.array(ends), rows)], ["ratio", "spans"])


def neighbours(texts: DataFrame) -> DataFrame:
    """[G5, M6] doc_id, ratio and n_spans of each text with the next one of its source. ``texts``: doc_id, source, text.

    Texts are dealt out by ranges of source and id, so a large source is spread over tasks and a text is sent once. A task
    compares the neighbours that it holds and passes on its first and last row, from which the pairs between tasks are made."""
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    schema = f"doc_id {kinds['doc_id']}, ratio double, n_spans int, task int, last boolean, source {kinds['source']}, text string"
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts.select("doc_id", "source", "text").repartitionByRange(parts, "source", "doc_id").sortWithinPartitions("source", "doc_id")

    def run(batches):
        task, before, names = TaskContext.get().partitionId(), None, [c.split()[0] for c in schema.split(", ")]

        def edge(row, last):
            return pa.RecordBatch.from_arrays([row["doc_id"], pa.nulls(1, pa.float64()), pa.nulls(1, pa.int32()), pa.array([task], pa.int32()), pa.array([last]), row["source"], row["text"]], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            if before is None:
                yield edge(batch.slice(0, 1), False)
            else:
                batch = pa.Table.from_batches([before, batch]).combine_chunks().to_batches()[0]
            source, text = batch["source"].to_pylist(), batch["text"].to_pylist()
            at = [k for k in range(len(text) - 1) if source[k] == source[k + 1]]
            ratio, pair, _ = differences([(text[k] or "", text[k + 1] or "") for k in at])
            count, rows = np.bincount(pair, minlength=len(at)).astype(np.int32), len(at)
            none = [pa.nulls(rows, batch.schema.field(c).type) for c in ("source", "text")]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(at, pa.int64())), pa.array(ratio), pa.array(count), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.bool_()), *none], names)
            before = batch.slice(len(text) - 1, 1)
        if before is not None:
            yield edge(before, True)

    found = materialise(ordered.mapInArrow(run, schema), "neighbours")
    w = Window.partitionBy("source").orderBy("task", "last")  # two rows for each task
    edges = found.where("task is not null").withColumn("next", F.lead(F.struct("text")).over(w)).where("last and next is not null")
    met = edges.withColumn("c", compare(F.col("text"), F.col("next.text"))).select("doc_id", "c.ratio", F.size("c.spans").alias("n_spans"))
    return found.where("task is null").select("doc_id", "ratio", "n_spans").unionByName(met)


def decide(rows: DataFrame, tau_policy: float = 0.65) -> DataFrame:
    """[G6] kind, proposed_text, diff_spans and notice. ``rows``: similarity, source_text, drafted (null without a usable draft).

    Unanchored clusters, drafts equal to the anchor and drafts unlike it get a notice and no text.
    """
    anchor = F.trim("source_text")
    anchored = F.coalesce((F.col("similarity") >= tau_policy) & (F.length("source_text") > 0), F.lit(False))
    c = rows.withColumn("anchor_text", F.when(anchored, anchor)).withColumn("_c", compare(F.when(anchored, anchor), F.col("drafted")))
    fine = anchored & F.col("drafted").isNotNull() & (F.col("drafted") != F.col("anchor_text")) & (F.col("_c.ratio") >= MIN_RATIO)
    out = c.withColumn("kind", F.when(fine, "amendment").otherwise("coverage_notice")).withColumn("proposed_text", F.when(fine, F.col("drafted")))
    out = out.withColumn("diff_spans", F.when(fine, F.col("_c.spans")).otherwise(F.array().cast(SPANS)))
    reason = F.when(fine, None).when(anchored, "an anchor was found, but no usable adaptation").otherwise("no clause near enough to anchor a change")
    return out.withColumn("notice", reason).drop("_c")


def conduct_summaries(clusters: DataFrame, submissions: DataFrame) -> DataFrame:
    """[P13, J5] cluster_id and summaries: a line for each member in order. ``submissions``: id, allegation_type, summary."""
    members = clusters.select("cluster_id", F.posexplode("member_ids").alias("pos", "id")).join(submissions, "id", "left")
    types = F.coalesce(F.nullif(F.array_join("allegation_type", ", "), F.lit("")), F.lit("unspecified"))
    line = F.concat(F.lit("- ["), types, F.lit("] "), F.coalesce("summary", F.lit("")))
    return members.withColumn("line", line).groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("summaries"))


def refusals(decisions: DataFrame) -> DataFrame:
    """adds why a decision is refused; null where it is fine. ``decisions``: action, text, reason."""
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return decisions.withColumn("refused", F.when(~F.col("action").isin("accept", "modify", "reject"), "unknown action").when((F.col("action") == "modify") & empty("text"), "text is needed").when((F.col("action") == "reject") & empty("reason"), "reason is needed"))


def apply_decisions(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """[G8, K9] proposals with new status and decision; refused and unknown ones change nothing; a later decision replaces an earlier."""
    good = refusals(decisions).where("refused is null").select("proposal_id", F.element_at(F.create_map(F.lit("accept"), F.lit("accepted"), F.lit("modify"), F.lit("modified"), F.lit("reject"), F.lit("rejected")), F.col("action")).alias("_status"), F.struct("action", "text", "reason").alias("_decision"))
    both = proposals.join(good, "proposal_id", "left")
    return both.withColumn("status", F.coalesce("_status", "status")).withColumn("reviewer_decision", F.coalesce("_decision", "reviewer_decision") if "reviewer_decision" in proposals.columns else F.col("_decision")).drop("_status", "_decision")


def listed(proposals: DataFrame, status: str | None = None) -> DataFrame:
    """[F5, T4] newest first, those without a time last."""
    rows = proposals if status is None else proposals.where(F.col("status") == status)
    return rows.orderBy(F.desc_nulls_last("created_at"), "proposal_id")
