"""The pipeline's stages against brute force on a small fixture."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers as P
import pytest

from lodestone.llm import bpe, langid, secrets
from tests.llm.test_llm_operators import DOCS, near_brute


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    vocab = {"en": [f"the{i}ing" for i in range(80)], "fr": [f"éau{i}eux" for i in range(80)]}
    rows = []
    for i in range(60):
        lang = rng.choice(["en", "fr"])
        words = [rng.choice(vocab[lang]) for _ in range(rng.randint(25, 60))]
        rows.append((i, " ".join(words), lang, "s", 1))
        if i % 5 == 0:
            rows.append((100 + i, " ".join(words), lang, "s", 1))
        if i % 7 == 0:
            words[3] = "changed"
            rows.append((200 + i, " ".join(words), lang, "s", 1))
        if i % 9 == 0:
            rows.append((300 + i, " ".join([*(rng.choice(vocab[lang]) for _ in words), "token", "=", "abcdefgh1234"]), lang, "s", 1))
    rows += [(900, "12345 !!", "en", None, 1), (901, None, "fr", None, 1), (902, "", None, None, 0), rows[0]]
    return spark.createDataFrame(rows, DOCS)


def test_stages_by_brute_force(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "secret_scan", "packing"]
    rows = [tuple(r) for r in docs.collect()]
    got = stages["language_id"](spark, docs, "")
    scored = langid.Scorer(langid.train(docs)).score([r[1] for r in rows])
    rows = [r for r, (lang, s) in zip(rows, scored) if lang != "und" and s >= 0.5]
    assert Counter(map(tuple, got.collect())) == Counter(rows) and not {900, 901, 902} & {r[0] for r in rows}
    got = stages["exact_dedup"](spark, got, "")
    best = defaultdict(list)
    for r in rows:
        best[r[1]].append(r)
    rows = [max(g) for g in best.values()]
    assert Counter(map(tuple, got.collect())) == Counter(rows)
    got = stages["near_dedup"](spark, got, "")
    keep = {min(g) for g in near_brute([r[:2] for r in rows])}
    rows = [r for r in rows if r[0] in keep]
    assert Counter(map(tuple, got.collect())) == Counter(rows)
    got = stages["secret_scan"](spark, got, "")
    texts = {}
    for r in rows:
        t, at = "", 0
        for a, _, b in secrets.scan(r[1]):
            if a >= at:
                t += r[1][at:a] + "[SECRET]"
            at = max(at, b)
        texts[r[0]] = t + r[1][at:]
    assert {r.doc_id: r.text for r in got.collect()} == texts and got.columns == docs.columns
    assert sum("[SECRET]" in t for t in texts.values()) >= 3
    got = stages["packing"](spark, got, "").collect()
    c = bpe.coder(P.path("byte_bpe_50k.json"))
    pieces = defaultdict(int)
    for r in got:
        pieces[r.doc_id] += r.length
    assert pieces == {d: len(c.encode([t])[0]) + 1 for d, t in texts.items()}


def test_stages_with_one_id_on_several_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    stages = dict(corpus_pipeline.STAGES)
    rows = [(5, b, "en", "s", 1), (7, b.replace("b40", "c"), "en", "s", 1), (7, a, "en", "s", 1), (None, a + " d", "en", "s", 1), (None, "alone here", "en", "s", 1)]
    got = stages["near_dedup"](spark, spark.createDataFrame(rows, DOCS), "")
    assert Counter((r.doc_id, r.text[:5]) for r in got.collect()) == Counter([(5, "b0 b1"), (7, "a0 a1"), (None, "alone")])
    rows = [(1, "t", "fr", "s", 1), (1, "t", "en", "s", 1), (1, "t", "en", "s", 1), (1, "u", None, None, None), (None, "t", "en", "s", 1), (None, "v", "en", "s", 1)]
    got = stages["exact_dedup"](spark, spark.createDataFrame(rows, DOCS), "")
    assert Counter(map(tuple, got.collect())) == Counter([(1, "t", "en", "s", 1), (1, "u", None, None, None), (None, "v", "en", "s", 1)])


def test_run_and_empty_table(spark, docs):
    whole = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert whole.count() > 0
    left = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, "")
    assert left.count() == 0
