"""Operator 9: quality classification by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded from counts of its byte classes and of neighbouring classes
and from how much of it repeats; gated attention weighs the encoded passages, and the weighted sum is scored. Labels are of documents only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.langid import fold, held_out
from lodestone.llm.tokens import chunks
from lodestone.plans.session import table
from lodestone.plans.shared import text_batches

PASSAGE = 512
#: Bounds of the training sample: documents of each label, passages of a document (evenly spaced).
PER_LABEL, BAG = 2000, 48
HIDDEN, GATE = 24, 12
EPOCHS, LEAST_STEPS, BATCH, RATE = 12, 1000, 64, 0.005


def _classes() -> np.ndarray:
    """Byte classes: padding, space, line break, vowels, other lower-case letters, capitals, digits, common marks each, other marks, bytes beyond ASCII."""
    out = np.full(256, 14, dtype=np.uint8)
    for k, chars in enumerate((b"\0", b" ", b"\n\r\t", b"aeiou", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".", b",", b"|", b"*#%$&", b"!?", b"=:;/", b"()[]{}<>\"'")):
        for c in chars:
            if out[c] == 14:
                out[c] = k
    out[128:] = 15
    return out


CLASSES = _classes()
K = 16
FEATURES = K + K * K + 3


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of the whole texts, and the number of passages of each; an empty text has one empty passage."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    counts = np.array([max(1, -(-len(b) // PASSAGE)) for b in raw])
    x = np.frombuffer(b"".join(b.ljust(n * PASSAGE, b"\0") for b, n in zip(raw, counts.tolist())), dtype=np.uint8).reshape(-1, PASSAGE)
    c = CLASSES[x]
    n = len(c)
    row = (np.arange(n, dtype=np.int64) * (K * K))[:, None]
    pairs = np.bincount((row + c[:, :-1].astype(np.int64) * K + c[:, 1:]).ravel(), minlength=n * K * K).reshape(n, K, K).astype("float32")
    held = np.maximum((c != 0).sum(axis=1), 1).astype("float32")
    pairs[:, 0, :] = pairs[:, :, 0] = 0
    single = pairs.sum(axis=2)
    shares = np.sqrt(np.concatenate([single, pairs.reshape(n, -1)], axis=1) / held[:, None])
    return np.concatenate([shares, distinct(x, held)], axis=1), counts


def distinct(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    """How much of each passage repeats, from the number of distinct runs of four bytes: three terms of one ratio."""
    w = x.astype(np.uint32)
    code = np.sort((w[:, :-3] << 24) | (w[:, 1:-2] << 16) | (w[:, 2:-1] << 8) | w[:, 3:], axis=1)
    r = np.minimum(1, ((code[:, 1:] != code[:, :-1]).sum(axis=1) + 1).astype("float32") / np.maximum(held - 3, 1))[:, None]
    return np.concatenate([r, r * r, np.sqrt(1 - r)], axis=1)


class Attention:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        g = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.params = {"w": g(FEATURES, HIDDEN) * 2, "b": np.zeros(HIDDEN), "v": g(HIDDEN, GATE), "u": g(HIDDEN, GATE), "a": g(GATE, 1)[:, 0], "o": g(HIDDEN, 1)[:, 0], "c": np.zeros(1)}

    def forward(self, x: np.ndarray, counts: np.ndarray):
        p = self.params
        first = np.cumsum(counts) - counts
        bag = np.repeat(np.arange(len(counts)), counts)
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * s) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["c"][0], -30, 30)))
        return y, (bag, first, h, t, s, a, z)

    def gradient(self, x, counts, target):
        p = self.params
        y, (bag, first, h, t, s, a, z) = self.forward(x, counts)
        d = (y - target) / len(target)
        dz = d[:, None] * p["o"][None]
        dh = a[:, None] * dz[bag]
        da = (h * dz[bag]).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, first)[bag])
        dt, ds = de[:, None] * p["a"] * s * (1 - t * t), de[:, None] * p["a"] * t * s * (1 - s)
        dh += dt @ p["v"].T + ds @ p["u"].T
        dx = dh * (1 - h * h)
        return {"w": x.T @ dx, "b": dx.sum(axis=0), "v": h.T @ dt, "u": h.T @ ds, "a": (de[:, None] * t * s).sum(axis=0), "o": z.T @ d, "c": np.array([d.sum()])}

    def fit(self, bags: list[np.ndarray], target: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.params.items()}
        second = {k: np.zeros_like(v) for k, v in self.params.items()}
        step = 0
        for _ in range(max(EPOCHS, -(-LEAST_STEPS // -(-len(bags) // BATCH)))):
            order = rng.permutation(len(bags))
            for s in range(0, len(bags), BATCH):
                i = order[s : s + BATCH]
                step += 1
                g = self.gradient(np.concatenate([bags[j] for j in i]).astype(float), np.array([len(bags[j]) for j in i]), target[i])
                for k in g:
                    d = g[k] + 1e-4 * self.params[k]
                    first[k] = 0.9 * first[k] + 0.1 * d
                    second[k] = 0.999 * second[k] + 0.001 * d * d
                    self.params[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


def train(docs: DataFrame, labels: DataFrame) -> Attention:
    """Fit on about PER_LABEL documents of each label outside the held-out fold, taken by a hash of the id.

    A document with labels of both kinds counts as 0. At most PER_LABEL ids a label are broadcast.
    """
    text_batches(docs.sparkSession)
    known = labels.where((fold() != 2) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    by_hash = F.xxhash64(F.col("doc_id").cast("string"), F.lit(11))
    some = known.where("quality = 0").orderBy(by_hash).limit(PER_LABEL).unionByName(known.where("quality = 1").orderBy(by_hash).limit(PER_LABEL))

    def run(batches):
        for b in batches:
            for rows, texts in chunks(list(range(b.num_rows)), b.column(1).to_pylist(), 1_000_000):
                x, counts = passages(texts)
                ends = np.cumsum(counts)
                kept = [x[np.unique(np.linspace(e - n, e - 1, min(n, BAG)).astype(int))].astype("float16").tobytes() for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(rows[0], len(rows)), pa.array(kept, pa.binary())], names=["quality", "bag"])

    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id").select(F.col("quality").cast("int").alias("quality"), "text")
    bags = chosen.mapInArrow(run, "quality int, bag binary")  # ids that repeat give more bags than ids; a hash says which stay
    rows = bags.orderBy(F.xxhash64("bag", "quality"), "bag", "quality").limit(3 * PER_LABEL).collect()
    model = Attention()
    if rows:
        rows.sort(key=lambda r: (r["quality"], bytes(r["bag"])))  # the fit does not depend on the order of tasks
        model.fit([np.frombuffer(r["bag"], dtype="float16").reshape(-1, FEATURES) for r in rows], np.array([float(r["quality"]) for r in rows]))
    return model


def classify(docs: DataFrame, model: Attention, threshold: float = 0.7) -> DataFrame:
    """A row for every row of ``docs``: doc_id, held_out, score, predicted. Null counts as the empty text, which is scored too."""
    text_batches(docs.sparkSession)
    params = {k: v.astype("float32") for k, v in model.params.items()}

    def run(batches):
        m = Attention()
        m.params = params
        for b in batches:
            for rows, texts in chunks(list(range(b.num_rows)), b.column(2).to_pylist(), 1_000_000):
                y = m.forward(*passages(texts))[0].astype(float)
                part = b.slice(rows[0], len(rows))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(y, pa.float64()), pa.array((y >= threshold).astype("int32"), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    thin = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return thin.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
