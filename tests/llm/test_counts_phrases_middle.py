"""Operators 11 to 13 against the tokenizer library and brute force."""

import hashlib
import re
from collections import Counter
from itertools import islice

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import fim, phrases, token_counts
from lodestone.llm.transducer import compiled

PATH = P.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TEXTS = [None, "", " ", "it's they'll we've I'm 'r 'rx ''s", "<|startoftext|>a<|ENDOFTEXT|>b<|endoftext|>", "J̌Á İΣ 각", "日本語 한국어 123", "x<P>y", "the\tcat. The cat; sat", "\n\n", "a" * 5000, "don't" * 700, "'" * 300 + "ve", "the cat sat " * 400]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, "s", 0) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[8], (None, "the cat", None, None, None)], SCHEMA)


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("chunk", [1, 7, 300, 65536])
def test_token_counts_are_the_librarys(spark, docs, chunk):
    library = Tokenizer.from_file(PATH)
    got = by_id(token_counts.count_tokens(docs.withColumn("row", F.lit(1)).withColumn("n_tokens", F.lit("x")), PATH, 100, chunk))
    n = {(r.doc_id, r.text or ""): len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    want = sorted(((r.doc_id, len((r.text or "").encode()), n[r.doc_id, r.text or ""], n[r.doc_id, r.text or ""] > 100) for r in docs.collect()), key=str)
    assert got == want
    assert token_counts.count_tokens(docs.limit(0), PATH).count() == 0


def test_token_counts_of_the_table(spark):
    from lodestone.llm.queries import QUERIES

    library = Tokenizer.from_file(PATH)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    want = sorted((r.doc_id, len(e.ids)) for r, e in zip(rows, library.encode_batch([r.text or "" for r in rows], add_special_tokens=False)))
    assert sorted((r.doc_id, r.n_tokens) for r in QUERIES["op11_token_counts"](spark, "/root/testdata/sf0.01").collect()) == want


def test_pairs_are_what_the_merges_make():
    c = compiled(PATH).counter
    tokens = range(512, 40_000, 977)
    assert all(c.correct(a, b) == (c.merged([*c.spelled[a], *c.spelled[b]]) == [a, b]) for a in tokens for b in tokens if c.spelled[a][-1] < 256)


def test_lane_maps_compose_to_the_sequential_run():
    s = compiled(PATH).splitter
    symbols = compiled(PATH).kind[[ord(c) for c in ("'re 've' 'll x1'" * 300)]]
    before, whole = s.run(symbols)
    for entry in range(len(s.states)):
        state = entry
        for i, c in enumerate(symbols.tolist()):
            assert entry or before[i] == state
            state = int(s.next[state, c])
        assert entry or whole[0] == whole[entry] == state


def brute_phrases(rows, most, least, first):
    f, n = Counter(), Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    found = {x: c for x, c in f.items() if len(x[1]) > 1 and c >= least}
    out = []
    for (lang, w), a in found.items():
        within = lambda v: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))  # noqa: B023, E731
        if any(x[0] == lang and len(x[1]) > len(w) and within(x[1]) and 100 * c >= 50 * a for x, c in found.items()):
            continue
        score, _, left, r = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), left, r))
    out.sort()
    ranked = []
    for lang in sorted(n):
        own = [x for x in out if x[0] == lang]
        ranked += [(lang, i, x[3].decode(), -x[2], x[4], x[5], n[lang], -x[1]) for i, x in enumerate(islice(own, first), 1)]
    return ranked


@pytest.mark.parametrize("most", [2, 3, 4])
def test_phrases_are_those_of_brute_force(spark, docs, most):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang").limit(60).collect()
    table = docs.select("text", "lang").union(spark.createDataFrame(rows, "text string, lang string")).withColumn("h", F.lit(0)).withColumn("phrase", F.lit(""))
    got = sorted(tuple(r) for r in phrases.collocations(table, most, 3, 40).collect())
    assert got == sorted(brute_phrases([(r.text, r.lang) for r in table.collect()], most, 3, 40))
    assert got and phrases.collocations(table.limit(0), most).count() == 0


def test_phrases_with_a_full_filter_are_the_same(spark, docs, monkeypatch):
    plain = sorted(tuple(r) for r in phrases.collocations(docs, 3, 2).collect())
    monkeypatch.setattr(phrases, "filter_of", lambda h: (phrases.np.full(1 << 20, 255, dtype="u1"), 23))
    monkeypatch.setattr(phrases, "MOST_LANGUAGES", 0)
    assert sorted(tuple(r) for r in phrases.collocations(docs, 3, 2).collect()) == plain


def brute_middle(doc, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc, n, "plain", None, None, sha(text), sha(text))
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return (doc, n, form, len(p), len(m), sha(out), sha(text))


@pytest.mark.parametrize("giant,piece", [(1 << 16, 16384), (3, 1), (3, 5), (100, 64)])
def test_middles_are_those_of_brute_force(spark, docs, monkeypatch, giant, piece):
    monkeypatch.setattr(fim, "PIECE", piece)
    small = docs.where("text is null or length(text) < 400") if piece < 10 else docs
    more = small.union(spark.createDataFrame([(100 + i, "ab 1<" * i + "é" * (i % 3), "en", "s", 0) for i in range(30)], SCHEMA))
    got = by_id(fim.digest(more.withColumn("row", F.lit(0)).withColumn("n", F.lit("x")), giant))
    assert got == sorted((brute_middle(r.doc_id, r.text) for r in more.collect()), key=str)
    assert fim.digest(docs.limit(0), giant).count() == 0


def test_middle_parts_make_the_text(spark, docs):
    rows = fim.transform(docs).collect()
    assert {r.form for r in rows} == {"plain", "psm", "spm"} or len(rows) == len(TEXTS) + 2
    texts = Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert texts == Counter((r.doc_id, r.output if r.form == "plain" else r.prefix + r.middle + r.suffix) for r in rows)
