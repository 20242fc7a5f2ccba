"""Operators on the survey's fixtures, and the library's queries on small data."""

import difflib
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.operators import clustering, coverage, ingest, metrics, proposals, rerank, retrieval, rules, sessions, verbatim
from lodestone.plans import catalog, shared
from lodestone.plans.components import components
from lodestone.sources import store
from lodestone.streaming import live


def test_truth_table(spark):
    rows = [(0.7, 0.6, "covered", 0), (0.3, 0.7, "legal_only", 1), (0.7, 0.2, "policy_only", 1), (0.2, 0.2, "uncovered", 2), (None, 0.8, "legal_only", 1), (0.5, 0.49999, "policy_only", 1), (float("nan"), 0.8, "legal_only", None)]
    df = coverage.coverage(spark.createDataFrame(rows, "policy double, legal double, want string, n int"), 0.5, 0.5)
    for r in df.collect():
        assert r.classification == r.want
        assert r.n is None or len(r.absence_notices) == r.n


def hybrid_case(spark, lexical):
    q = spark.createDataFrame([(1, "bribery gifts", [1.0, 0.0])], "qid bigint, text string, qvec array<double>")
    vec = lambda s: [s, (1 - s * s) ** 0.5]
    c = spark.createDataFrame([(1, "travel rules", vec(0.60)), (2, "bribery and gifts are banned", vec(0.58)), (3, "working hours", vec(0.40))], "cid bigint, text string, cvec array<double>")
    return [r.cid for r in retrieval.hybrid(q, c, n=2, floor=0.1, lexical=lexical).orderBy("rank").collect()]


def test_lexical_match_overtakes(spark):
    assert hybrid_case(spark, True) == [2, 1] and hybrid_case(spark, False) == [1, 2]


def test_bm25_edges(spark):
    c = spark.createDataFrame([(1, "bribery policy"), (2, "travel policy"), (3, "gift rules"), (4, "")], "cid bigint, text string")
    q = spark.createDataFrame([(1, "bribery"), (2, "nothing here"), (3, "")], "qid bigint, text string")
    assert [(r.qid, r.cid) for r in retrieval.bm25(q, c, 3).collect()] == [(1, 1)]


def test_vectors_meet_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vecs = [(i, rng.normal(size=4).round(1).tolist()) for i in range(30)] + [(30, None), (31, []), (32, [0.0] * 4), (33, [1.0, 2.0]), (34, [float("nan")] * 4)]
    v = spark.createDataFrame(vecs, "id bigint, vec array<double>")
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in vecs[:30]}
    sims = {(i, j): round(float(unit[i] @ unit[j]), 6) if max(i, j) < 30 else 1.0 if i == j == 33 else 0.0 for i in range(35) for j in range(35)}
    for block in (4096, 7):
        monkeypatch.setattr(retrieval, "BLOCK", block)
        got = {}
        q, c = v.toDF("qid", "qvec"), v.toDF("cid", "cvec")
        for r in retrieval.dense(q, c, 3).orderBy("dense_rank").collect():
            got.setdefault(r.qid, []).append((r.cid, r.sim))
        assert got == {i: sorted(((j, sims[i, j]) for j in range(35)), key=lambda x: (-x[1], x[0]))[:3] for i in range(35)}
        best = {(r.qid, r.corpus): r.sim for r in retrieval.best_by_corpus(q, c.withColumn("corpus", F.when(F.col("cid") % 2 == 0, "policy").otherwise("legal"))).groupBy("qid", "corpus").agg(F.max("sim").alias("sim")).collect()}
        assert best == {(i, k): max(sims[i, j] for j in range(m, 35, 2) if j != i) for i in range(35) for k, m in (("policy", 0), ("legal", 1))}
        pairs = {(r.i, r.j) for r in clustering.similar_pairs(v, 0.8).collect()}
        assert pairs == {(i, j) for i in range(35) for j in range(i + 1, 35) if sims[i, j] >= 0.8}
        label = {i: i for i in range(35)}
        for i, j in sorted(pairs) * 35:
            label[i] = label[j] = min(label[i], label[j])
        assert {r.id: r.component for r in clustering.linked_components(v, 0.8).collect()} == label


def test_verbatim_pairs_by_brute_force(spark):
    words = "the cat sat on mat and saw a rat near".split()
    rng = random.Random(5)
    sources = [(i, " ".join(rng.choice(words) for _ in range(40)) if i else None) for i in range(12)] + [(12, ""), (13, "The  CAT\n sat\u2019s on")]
    cut = lambda t: t[(a := rng.randint(0, 60)) : a + rng.randint(1, 80)]
    quotes = [(i, cut(sources[1 + i % 11][1])) for i in range(60)] + [(60, None), (61, ""), (62, " "), (63, "t sat's o"), (64, "nowhere in any of the sources at all")]
    norm = lambda t: " ".join(t.replace("\u2019", "'").split()).lower()
    got = {(r.qid, r.sid) for r in verbatim.verbatim_pairs(spark.createDataFrame(quotes, "qid bigint, quote string"), spark.createDataFrame(sources, "sid bigint, text string")).collect()}
    assert got == {(q, s) for q, a in quotes for s, t in sources if a and t and norm(a) and norm(a) in norm(t)}


def test_rerank_shapes(spark):
    c = spark.createDataFrame([(q, i, f"clause {i} text here", 0.5) for q in range(1, 6) for i in range(2)], "qid int, idx int, text string, similarity double")
    a = spark.createDataFrame([(1, '```json\n{"scores": [{"index": 1, "score": 8}], "best_quote": {"index": 1, "text": "text here"}}\n```'), (2, '[{"index": 0, "score": 5}, {"index": 1, "score": 9}, {"index": 7, "score": 9}]'), (3, "not json"), (4, '{"scores": [{"index": 0, "score": 1}]}'), (5, '{"scores": [{"index": 0, "score": 4}, {"index": 1, "score": 4}], "best_quote": "clause 1"}')], "qid int, raw string")
    got = {}
    for r in rerank.rerank(c, a).collect():
        got.setdefault(r.qid, []).append((r.status, r.idx, r.quote))
    assert got[1] == [("ok", 1, "text here")] and sorted(x[1] for x in got[2]) == [0, 1]
    assert got[3] == [("unavailable", None, None)] and got[4] == [("no_match", None, None)]
    assert sorted(got[5], key=lambda x: x[1]) == [("ok", 0, None), ("ok", 1, "clause 1")]


def test_pins(spark):
    e = spark.createDataFrame([("p", "d", "beta gamma", (6, 16)), ("p", "d", "changed words", (6, 16)), ("p", "x", "anything", (0, 3))], "corpus string, document_id string, quote string, span struct<start:int,end:int>")
    c = spark.createDataFrame([("p", "d", "alpha beta gamma delta")], "corpus string, document_id string, canonical_text string")
    assert sorted(r.quote for r in rerank.validate_pins(e, c).collect()) == ["anything", "beta gamma"]


def greedy(v, least):
    u = [x / np.linalg.norm(x) for x in v]
    parts = [[i] for i in range(len(v))]
    while len(parts) > 1:
        best = max(((np.mean([u[a] @ u[b] for a in parts[i] for b in parts[j]]), -i, -j) for i in range(len(parts)) for j in range(i + 1, len(parts))))
        if best[0] < least:
            break
        i, j = -best[1], -best[2]
        parts[i] = parts[i] + parts[j]
        del parts[j]
    return sorted(sorted(p) for p in parts)


def test_clusters_equal_the_global_loop(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, vec array<double>")
    got = {}
    for r in clustering.cluster(df, 0.6).collect():
        got.setdefault(r.cluster, []).append(r.id)
    assert sorted(sorted(p) for p in got.values()) == greedy(v, 0.6)


def test_gate(spark):
    rows = [(1, 1, [1.0, 0.0, 0.0], "legal_only", None), (1, 2, [0.98, 0.2, 0.0], None, datetime(2024, 1, 2)), (3, 3, [0.0, 0.0, 1.0], "uncovered", None)]
    s = {r.cluster: r for r in clustering.summarise(spark.createDataFrame(rows, "cluster bigint, id bigint, vec array<double>, classification string, ts timestamp")).collect()}
    assert s[1].is_candidate and not s[3].is_candidate and s[3].intra_sim == 1.0
    assert s[1].intra_sim == pytest.approx(0.98 / (0.98**2 + 0.04) ** 0.5, abs=1e-4) and s[1].coverage_classes == {"legal_only": 1, "unknown": 1}


def test_components_of_odd_shapes(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 40)] + [(500, 501), (501, 500), (7, 7)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(120)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def test_stable_ids(spark):
    new = spark.createDataFrame([([2, 1],), ([3],)], "member_ids array<bigint>")
    old = spark.createDataFrame([([1, 2], "cc_0004", "dismissed")], "member_ids array<bigint>, cluster_id string, status string")
    assert {(r.cluster_id, r.status) for r in clustering.stable_ids(new, old, 5).collect()} == {("cc_0004", "dismissed"), ("cc_0005", "open")}
    p = spark.createDataFrame([("cc_0004", "rejected"), ("cc_0005", "pending")], "cluster_id string, status string")
    assert [r.cluster_id for r in clustering.without_open_proposal(old, p).collect()] == ["cc_0004"]


def test_metrics(spark):
    now = datetime(2024, 6, 1)
    raw = [(now, "covered"), (now, "legal_only"), (now - timedelta(days=90), "legal_only"), (now, "uncovered"), (now, None), (now - timedelta(days=91), "covered"), (None, "covered")]
    r = metrics.coverage_metrics(spark.createDataFrame(raw, "ts timestamp, classification string"), F.lit(now)).first()
    assert (r.covered, r.legal_only, r.policy_only, r.uncovered, r.unclassified, r.total_classified, r.legal_only_rate) == (1, 2, 0, 1, 1, 4, 0.5)
    assert metrics.gap_inputs(spark.createDataFrame(raw, "ts timestamp, classification string"), F.lit(now)).count() == 3
    with pytest.raises(ValueError):
        metrics.in_window(F.col("ts"), F.lit(now), 0)
    p = spark.createDataFrame([("2024-05-01T00:00:00Z",), ("not-a-date",), ("2024-05-01T00:00:00",)], "t string")
    assert [r.x is None for r in p.select(metrics.parse_ts(F.col("t")).alias("x")).collect()] == [False, True, False]


EXTRACTION = "rid bigint, specific_examples_present boolean, witnesses_mentioned boolean, prior_reporting_mentioned boolean, impact_described boolean, retaliation_mentioned boolean, _used_defaults boolean"
FORMS = "rid bigint, management_aware string, sequence_of_events string"


@pytest.mark.parametrize(("facts", "form", "want"), [((True, True, False, True, True, False), ("yes", ""), []), ((False, True, True, True, True, False), ("no", "x" * 60), []), ((True, True, False, True, True, False), ("no", ""), ["no_prior_reporting"]), ((False,) * 5 + (True,), ("no", ""), []), ((False,) * 6, ("no", ""), ["no_specific_example", "no_witnesses_mentioned"])])
def test_rules(spark, facts, form, want):
    got = rules.top_gaps(spark.createDataFrame([(1, *facts)], EXTRACTION), rules.default_rules(spark), spark.createDataFrame([(1, *form)], FORMS))
    assert [r.gap_id for r in got.orderBy("rank").collect()] == want


def test_rule_constraints(spark):
    bad = spark.createDataFrame([("a", "A", 1, True, "boolean_false", "summary", None, "t"), ("a", "B", 1, True, "odd", "nope", None, "")], rules.RULE)
    assert {r.problem for r in rules.violations(bad).collect()} == {"id repeats", "priority repeats", "type does not suit the field", "type is unknown", "field is unknown", "template is empty"}
    assert rules.usable_rules(bad).count() == 5 and rules.violations(rules.default_rules(spark)).count() == 0


def test_proposals(spark):
    anchor = "Employees must report gifts above fifty dollars."
    rows = [(1, 0.9, anchor, anchor.replace("fifty", "twenty")), (2, 0.9, anchor, anchor), (3, 0.9, anchor, "zzzz qqqq"), (4, 0.1, anchor, "x"), (5, 0.9, anchor, None), (6, None, None, None)]
    got = {r.id: r for r in proposals.decide(spark.createDataFrame(rows, "id int, similarity double, source_text string, drafted string")).collect()}
    assert [got[i].kind for i in range(1, 7)] == ["amendment"] + ["coverage_notice"] * 5
    assert got[1].diff_spans and all(0 <= s.a0 <= s.a1 <= len(anchor) for s in got[1].diff_spans) and got[4].anchor_text is None and got[2].proposed_text is None
    p = spark.createDataFrame([("ap_0001", "pending"), ("ap_0002", "pending")], "proposal_id string, status string")
    d = spark.createDataFrame([("ap_0001", "reject", None, "no"), ("ap_0002", "modify", " ", None), ("ap_0009", "accept", None, None)], "proposal_id string, action string, text string, reason string")
    assert {r.proposal_id: r.status for r in proposals.apply_decisions(p, d).collect()} == {"ap_0001": "rejected", "ap_0002": "pending"}


def test_diff_spans_takes_every_document(spark, monkeypatch):
    long = " ".join(f"word{i % 37}" for i in range(300))
    texts = ["abc", long, long.replace("word7 ", "edited "), None, "abcd"]
    docs = spark.createDataFrame([(i, t, "s", None if i == 0 else len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, source string, n_chars bigint")
    monkeypatch.setattr(catalog, "table", lambda *a: docs)
    want = {}
    for i, (a, b) in enumerate(zip(texts, texts[1:])):
        m = difflib.SequenceMatcher(a=a or "", b=b or "", autojunk=False)
        want[i] = (round(m.ratio(), 6), sum(o[0] != "equal" for o in m.get_opcodes()))
    assert {r.doc_id: (r.ratio, r.n_spans) for r in catalog.QUERIES["diff_spans"](spark, "").collect()} == want


def test_matching_blocks_equal_difflib():
    r = random.Random(3)
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    pairs = [(some(s, r.randrange(80)), some(s, r.randrange(80))) for s in ("a", "ab", "abc", "abcdefgh", "a\U0001f600\ud800") for _ in range(40)]
    long = some("abcdef ", 700)
    pairs += [(long, long[:200] + "x" + long[203:500] + long[450:]), (long, long * 2), (long, long), (long, ""), ("a" * 300, "a" * 200 + "b" + "a" * 90)]
    for a, b in pairs:
        m = difflib.SequenceMatcher(a=a, b=b, autojunk=False)
        assert proposals.matching_blocks(a, b) == [tuple(x) for x in m.get_matching_blocks() if x.size]
        ratio, spans = proposals.changes(a, b)
        assert ratio == m.ratio() and [tuple(x.values()) for x in spans] == [o for o in m.get_opcodes() if o[0] != "equal"]



def test_pairs_that_are_aligned_together_equal_difflib(monkeypatch):
    """Listed long runs, runs too many to list, and short ones, in groups of pairs and at several lengths of a long run."""
    r = random.Random(5)
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    wide = "".join(chr(200 + i) for i in range(400))

    def pair():
        letters = r.choice(["a", "ab", "abcdefgh ", "a\U0001f600\ud800", wide])
        words = [some(letters, r.randrange(1, 12)) for _ in range(6)]
        text = lambda: "".join(r.choice(words) for _ in range(r.randrange(30)))
        line = some(letters, r.randrange(5, 60))
        return r.choice([(text(), text()), (line * r.randrange(1, 6), line[3:] * r.randrange(1, 6)), (some(letters, 90), some(letters, 90))])

    for long in (2, 7):
        monkeypatch.setattr(proposals, "LONG", long)
        pairs = [*(pair() for _ in range(150)), ("ab" * 300, "ba" * 250 + "a"), ("", ""), ("", "x"), ("same", "same"), ("same", "same")]
        ratios, of, spans = proposals.differences(pairs)
        for k, (a, b) in enumerate(pairs):
            m = difflib.SequenceMatcher(a=a, b=b, autojunk=False)
            assert ratios[k] == m.ratio() and spans[of == k].tolist() == [list(o[1:]) for o in m.get_opcodes() if o[0] != "equal"]


def test_a_large_source_is_spread_over_tasks(spark, monkeypatch):
    texts = {i: ("s" if i < 300 else None if i < 305 else "t", None if i % 50 == 7 else f"text {i * i} of {i % 7}") for i in range(310)}
    docs = spark.createDataFrame([(i, s, t) for i, (s, t) in texts.items()], "doc_id bigint, source string, text string").repartition(3)
    written = []
    monkeypatch.setattr(proposals, "materialise", lambda df, name: written.append(shared.materialise(df, name)) or written[-1])
    got = {r.doc_id: (r.ratio, r.n_spans) for r in proposals.neighbours(docs).collect()}
    want = {}
    for i in range(309):
        if texts[i][0] == texts[i + 1][0]:
            m = difflib.SequenceMatcher(a=texts[i][1] or "", b=texts[i + 1][1] or "", autojunk=False)
            want[i] = (m.ratio(), sum(o[0] != "equal" for o in m.get_opcodes()))
    assert got == want and written[0].where("source = 's' and task is not null").select("task").distinct().count() > 2


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), "id bigint, name string")
    assert s.read().count() == 0 and s.next_id == 1
    s.create(spark.createDataFrame([("a",), ("b",), ("c",)], "name string"), ["name"])
    assert {tuple(r) for r in s.read().collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert s.delete(spark.createDataFrame([(3,)], "id bigint")) == 1
    s.create(spark.createDataFrame([("d",)], "name string"), ["name"])
    found = s.update(spark.createDataFrame([(1, "A"), (9, "x")], "id bigint, name string"))
    assert {(r.id, r.found) for r in found.collect()} == {(1, True), (9, False)}
    assert {tuple(r) for r in s.read().collect()} == {(1, "A"), (2, "b"), (4, "d")}
    with pytest.raises(ValueError):
        s.replace(s.read(), expected=7)
    s.clear()
    assert s.read().count() == 0 and s.next_id == 5


def test_a_store_outlives_lost_writers(spark, tmp_path):
    path = tmp_path / "s"
    s = store.Store(spark, str(path), "id bigint, name string")
    # a writer that is lost after its table and before the first pointer leaves a new store
    (path / "vlost").mkdir(parents=True)
    assert s.read().count() == 0 and s.next_id == 1
    s.create(spark.createDataFrame([("a",), ("b",)], "name string"), ["name"])
    # one that is lost while it writes a pointer leaves the table before
    (path / "pointer-2").write_text('{"vers')
    assert {tuple(r) for r in s.read().collect()} == {(1, "a"), (2, "b")} and s.next_id == 3
    base = s.number
    s.create(spark.createDataFrame([("c",)], "name string"), ["name"])
    assert {tuple(r) for r in s.read().collect()} == {(1, "a"), (2, "b"), (3, "c")} and s.number == 3
    # a writer that began before another one ended is refused
    with pytest.raises(ValueError, match="another writer"):
        s.replace(s.read().where("id = 1"), base=base)
    assert s.read().count() == 3
    # tables without their pointers are an error, not an empty store
    for p in [*path.glob("pointer-*"), *path.glob(".pointer-*")]:
        p.unlink()
    with pytest.raises(ValueError, match="corrupt"):
        s.read()
    with pytest.raises(ValueError, match="corrupt"):
        s.create(spark.createDataFrame([("d",)], "name string"), ["name"])


def test_json_import(spark, tmp_path):
    items = "struct<id:bigint,name:string>"
    for text, ids, n in (('[{"id": 7, "name": "x"}]', [7], 8), ('{"next_id": 12, "items": [{"id": 7}]}', [7], 12), ("", [], 1)):
        (tmp_path / "f.json").write_text(text)
        rows, next_id = store.import_json(spark, str(tmp_path / "f.json"), items)
        assert [r.id for r in rows.collect()] == ids and next_id == n
    (tmp_path / "f.json").write_text('{"next_id": ')
    with pytest.raises(Exception):
        store.import_json(spark, str(tmp_path / "f.json"), items)[0].collect()


PAGE = "<nav><p>skip</p></nav><h1>Title &amp; more</h1><script>var t='</p>';</script><p>One <b>bold<p>Two<br>lines</p><div class='ad'><p>buy</p></div><h2>Next</h2><p>" + "word " * 200 + "</p><p>" + "word " * 200 + "</p>"


def test_page_chunks(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "page_id bigint, html string")
    blocks = ingest.page_blocks(pages)
    assert [(r.kind, r.text[:8]) for r in blocks.orderBy("i").collect()] == [("heading", "Title & "), ("paragraph", "One bold"), ("paragraph", "Two line"), ("heading", "Next"), ("paragraph", "word wor"), ("paragraph", "word wor")]
    chunks = ingest.statute_chunks(blocks).cache()
    assert [r.section_title for r in chunks.orderBy("n").collect()] == ["Title & more", "Next (part 1)", "Next (part 2)"]
    canonical = ingest.canonical_text(chunks)
    j = chunks.join(canonical, "page_id").select(F.substring("canonical_text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")).alias("x"), "text").collect()
    assert all(r.x == r.text for r in j)
    pinned = ingest.pin_chunks(chunks.drop("char_start", "char_end"), canonical).orderBy("n").first()
    assert pinned.char_start == 0


def test_section_chunks(spark):
    w = lambda n: " ".join(["word"] * n)
    rows = [(1, 1, 0, f"1. First\n{w(120)}"), (1, 1, 1, f"2. Second\n{w(30)}"), (1, 2, 0, f"{w(150)}. {w(150)}. {w(150)}")]
    got = ingest.section_chunks(spark.createDataFrame(rows, "doc_id bigint, page bigint, n bigint, text string"), []).orderBy("n").collect()
    assert got[0].section_title == "1. First" and "2. Second" in got[0].text + got[1].text
    assert all(len(r.text.split()) <= 360 for r in got) and sum(r.text.count("word") for r in got) == 120 + 30 + 450


def test_sections_fold_a_document_a_row(spark):
    w = lambda n, c="w": " ".join([c] * n)
    rows = [(1, 1, i, t) for i, t in enumerate(["", w(90), " ", "2. Next", w(20, "b"), f"{w(200)}. {w(180, 'c')}", w(60), "3. Last", w(5)])] + [(1, 2, 0, w(3, "d")), (2, 1, 0, " ")]
    found = ingest.section_chunks(spark.createDataFrame(rows, "doc_id bigint, page bigint, n bigint, text string"), [])
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.orderBy("doc_id", "n").collect()
    # one w stands before a full stop
    words = {c: sum(r.text.split().count(c) for r in got) for c in "wbcd"}
    assert words == {"w": 354, "b": 20, "c": 180, "d": 3} and {(r.doc_id, r.page) for r in got} == {(1, 1), (1, 2)}


def test_pages_go_to_python_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(ingest, "PAGES", 3)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    pages = spark.createDataFrame([(i, f"<h1>T{i}</h1><p>a {i}</p><p>b</p>" if i % 4 else None) for i in range(40)], "page_id bigint, html string")
    got = ingest.page_blocks(pages)
    assert int(spark.conf.get(key)) <= 500
    assert sorted((r.page_id, r.i, r.kind, r.text) for r in got.collect()) == sorted((i, n, k, t) for i in range(40) if i % 4 for n, (k, t) in enumerate([("heading", f"T{i}"), ("paragraph", f"a {i}"), ("paragraph", "b")]))


def test_similarities_are_held_in_strips():
    r = np.random.default_rng(1)
    left = pd.Series([None if i % 50 == 7 else r.normal(size=3 if i % 40 == 5 else 8) for i in range(700)])
    right = pd.Series([r.normal(size=3 if i % 30 == 2 else 8) for i in range(90)])
    strips = list(retrieval.cosine_strips(left, right))
    assert all(len(s) <= retrieval.STRIP for _, s in strips) and [at for at, _ in strips] == list(range(0, 700, retrieval.STRIP))
    want = [[0.0 if a is None or len(a) != len(b) else a @ b / np.linalg.norm(a) / np.linalg.norm(b) for b in right] for a in left]
    assert np.allclose(np.concatenate([s for _, s in strips]), want)


def test_a_side_that_meets_itself_has_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 10)
    monkeypatch.setattr(retrieval, "WIDE", 50)
    assert [retrieval.blocks_of(spark.range(n), wide=True) for n in (0, 30, 80, 300, 1000)] == [1, 3, 8, 8, 20] and retrieval.blocks_of(spark.range(300)) == 30


def test_sessions_and_streams(spark, tmp_path):
    m = spark.createDataFrame([(1, t, "user", "x" * 400) for t in range(10)], "conv_id bigint, turn bigint, role string, text string")
    assert sorted(r.turn for r in sessions.history(m, context=612 + 360).collect()) == [7, 8, 9]
    assert sessions.digest(m).first().recent.count(" | ") == 1
    m.repartition(3).write.parquet(str(tmp_path / "m"))
    stream = live.session_state(spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "m")))
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("sessions").agg(F.max("n_messages"), F.max("n_chars")).first() == (10, 4000)
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("classification"))
    e.repartition(1).write.parquet(str(tmp_path / "e"))
    q = live.windowed_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), ["error", "purchase"]).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = metrics.daily(e, ["error", "purchase"], "error")
    assert {(str(r.start.date()), r.error, r.purchase) for r in spark.table("counts").collect()} == {(str(r.day), r.error, r.purchase) for r in batch.collect()}


@pytest.mark.parametrize("name", ["coverage_classes", "confusion_matrix", "bm25_topk", "verbatim_spans", "raw_excerpt", "line_neighbour_filter", "chunk_offsets", "gap_rules_top2", "recent_digest", "stable_ids", "section_label", "header_lines"])
def test_queries_equal_duckdb(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations", "events", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), con.execute(catalog.SQL[name]).fetchdf()
    norm = lambda df: sorted(map(str, df[sorted(df.columns)].astype(str).values.tolist()))
    assert sorted(got.columns) == sorted(want.columns) and norm(got) == norm(want)


def test_entry_imports_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nprint(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=str(__import__("pathlib").Path(__file__).resolve().parents[1]))
    assert done.returncode == 0, done.stderr
