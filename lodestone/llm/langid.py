"""Operator 10: language identification by a byte convolutional network.

Filters of several widths run over byte embeddings of fixed-length windows, each keeps its largest response in a window,
and a softmax layer turns these into probabilities. Training is numpy on the driver, on a bounded sample of windows.
A filter's response is a sum of terms for byte pairs, so tasks look terms up in tables instead of multiplying.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.tokens import chunks
from lodestone.plans.session import table
from lodestone.plans.shared import text_batches

WINDOW = 256
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 16, 8
#: Bounds of the training sample: documents of a language, documents in all, languages (the most frequent), characters of
#: each document's window. Up to 200 languages have PER_LANGUAGE documents each, more have equal shares of SAMPLE.
PER_LANGUAGE, SAMPLE, LANGUAGES, SAMPLE_CHARS = 1200, 240_000, 4000, 240
EPOCHS, BATCH, RATE = 6, 64, 0.01
LETTER = re.compile("[A-Za-z]")


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4; 2 is held out. A null id is in no fold."""
    return F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(4))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


class Network:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        n = max(1, len(languages))
        self.languages = languages
        self.params = {"e": rng.normal(0, 0.5, (256, EMBEDDING)), "d": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), n)), "b": np.zeros(n)}
        for w in WIDTHS:
            self.params[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS))
            self.params[f"c{w}"] = np.zeros(FILTERS)

    def pooled(self, x: np.ndarray):
        """Per width: largest responses (windows, FILTERS) after relu, and where they are."""
        e = self.params["e"][x]
        out = []
        for w in WIDTHS:
            cols = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, w * EMBEDDING)
            r = cols @ self.params[f"w{w}"] + self.params[f"c{w}"]
            at = r.argmax(axis=1)
            out.append((np.maximum(np.take_along_axis(r, at[:, None], 1)[:, 0], 0), at))
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.params.items()}
        second = {k: np.zeros_like(v) for k, v in self.params.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for s in range(0, len(x), BATCH):
                i = order[s : s + BATCH]
                step += 1
                for k, g in self.gradient(x[i], y[i]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.params[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, pooled = self.params, self.pooled(x)
        h = np.concatenate([r for r, _ in pooled], axis=1)
        q = softmax(h @ p["d"] + p["b"])
        q[np.arange(len(y)), y] -= 1
        q /= len(y)
        g = {"d": h.T @ q, "b": q.sum(axis=0), "e": np.zeros_like(p["e"])}
        back = q @ p["d"].T
        rows = np.arange(len(x))[:, None, None]
        for k, (w, (r, at)) in enumerate(zip(WIDTHS, pooled)):
            d = back[:, k * FILTERS : (k + 1) * FILTERS] * (r > 0)
            seen = x[rows, at[:, :, None] + np.arange(w)]  # the bytes below each filter's largest response
            g[f"w{w}"] = np.einsum("nf,nfx->xf", d, p["e"][seen].reshape(len(x), FILTERS, -1))
            g[f"c{w}"] = d.sum(axis=0)
            np.add.at(g["e"], seen, d[:, :, None, None] * p[f"w{w}"].T.reshape(FILTERS, w, EMBEDDING)[None])
        return g

    def tables(self) -> dict:
        """Terms of each width by byte pair (and by byte, for an odd width), as float32."""
        e = self.params["e"]
        out = {}
        for w in WIDTHS:
            terms = [e @ self.params[f"w{w}"][j * EMBEDDING : (j + 1) * EMBEDDING] for j in range(w)]
            pairs = [(terms[j][:, None] + terms[j + 1][None]).reshape(65536, FILTERS).astype("float32") for j in range(0, w - 1, 2)]
            out[w] = (pairs, terms[-1].astype("float32") if w % 2 else None)
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    q = np.exp(z - z.max(axis=1, keepdims=True))
    return q / q.sum(axis=1, keepdims=True)


class Scorer:
    """Applies a fitted network to texts; built once per task."""

    def __init__(self, net: Network):
        self.net, self.tables = net, net.tables()

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (windows, languages) of byte windows (windows, WINDOW)."""
        p = self.net.params
        out = []
        for s in range(0, len(x), 64):  # what the lookups make stays in the cache
            flat = x[s : s + 64].ravel()
            pair = flat[:-1].astype(np.int32) * 256 + flat[1:]
            pair = np.append(pair, 0)
            h = []
            for w in WIDTHS:
                pairs, odd = self.tables[w]
                r = pairs[0][pair]
                for j, t in enumerate(pairs[1:], 1):
                    r[: len(r) - 2 * j] += t[pair[2 * j :]]
                if odd is not None:
                    r[: len(r) - w + 1] += odd[flat[w - 1 :]]
                h.append(np.maximum(r.reshape(-1, WINDOW, FILTERS)[:, : WINDOW - w + 1].max(axis=1) + p[f"c{w}"], 0))
            out.append(softmax(np.concatenate(h, axis=1) @ p["d"] + p["b"]))
        return np.concatenate(out)

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.net.languages:
            return out
        use = [i for i, t in enumerate(texts) if t and (LETTER.search(t) or any(c.isalpha() for c in t))]
        if not use:
            return out
        raw = [texts[i].encode("utf-8", "surrogatepass") for i in use]
        counts = np.array([-(-len(b) // WINDOW) for b in raw])
        x = np.frombuffer(b"".join(b.ljust(n * WINDOW, b"\0") for b, n in zip(raw, counts.tolist())), dtype=np.uint8).reshape(-1, WINDOW)
        q = self.windows(x) * (x != 0).sum(axis=1, keepdims=True)  # by what a window holds
        q = np.add.reduceat(q, np.cumsum(counts) - counts, axis=0)
        q /= np.maximum(q.sum(axis=1, keepdims=True), 1e-12)
        for i, best, row in zip(use, q.argmax(axis=1).tolist(), q):
            out[i] = (self.net.languages[best], float(min(1.0, row[best])))
        return out


def train(docs: DataFrame) -> Network:
    """A network for the languages of ``docs`` outside the held-out fold. The sample takes about PER_LANGUAGE documents of each
    language, fewer where there are very many, by a hash of the id, and from each a window at a place that the hash gives."""
    usable = docs.where((fold() != 2) & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "text", "lang")
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r["lang"] for r in counts)
    net = Network(languages)
    if len(languages) < 1:
        return net
    each = min(PER_LANGUAGE, SAMPLE // len(languages))
    chance = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, each / r["count"]))])
    h = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)), F.lit(1 << 30))
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    picked = usable.where(F.lit(1.0 * (1 << 30)) * F.coalesce(chance[F.col("lang")], F.lit(0.0)) > h)
    piece = F.substring(F.col("text"), (F.pmod(h, room) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    rows = picked.select(h.alias("h"), "lang", piece.alias("piece")).orderBy("h", "piece").limit(2 * each * len(languages)).collect()
    rng = np.random.default_rng(1)
    number = {x: i for i, x in enumerate(languages)}
    x, y = [], []
    for r in rows:
        b = r["piece"].encode()[:WINDOW]
        x.append(b)
        x.append(b[: int(rng.integers(4, 64))])  # short texts are as frequent as full windows
        y += [number[r["lang"]]] * 2
    if x:
        net.fit(np.frombuffer(b"".join(b.ljust(WINDOW, b"\0") for b in x), dtype=np.uint8).reshape(-1, WINDOW), np.array(y))
    return net


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """A row for every row of ``docs``: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are ``und`` with score 0, as is all where no language was learned. The score is
    the mean probability over all windows of the whole text, by the bytes they hold.
    """
    text_batches(docs.sparkSession)

    def run(batches):
        scorer = Scorer(net)
        for b in batches:
            for rows, texts in chunks(list(range(b.num_rows)), [t or "" for t in b.column(2).to_pylist()]):
                got = scorer.score(texts)
                part = b.slice(rows[0], len(rows))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, net: Network, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose language the network gives with a score of ``least`` or more; ``und`` goes."""
    schema = docs.schema
    text_batches(docs.sparkSession)

    def run(batches):
        scorer = Scorer(net)
        for b in batches:
            at = b.schema.get_field_index("text")
            for rows, texts in chunks(list(range(b.num_rows)), [t or "" for t in b.column(at).to_pylist()]):
                keep = [g[0] != "und" and g[1] >= least for g in scorer.score(texts)]
                yield b.slice(rows[0], len(rows)).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
