
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import records, text, vector
from lodestone.operators import clustering, coverage, ingest, metrics, proposals, retrieval, rules, sessions, vector_index, verbatim
from lodestone.plans.session import table
from lodestone.plans.shared import text_batches

TAU = 0.33
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", vector.doubles(F.col("embedding")).alias("v"))


def _sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Vectors whose id 50 divides are the queries, all vectors are chunks of the corpus that their label's parity names."""
    e = _vectors(spark, sf)
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("v").alias("qvec"))
    c = e.select(F.col("vec_id").alias("cid"), F.when(F.col("label") % 2 == 0, "policy").otherwise("legal").alias("corpus"), F.col("v").alias("cvec"))
    return q, c


def _scores(spark, sf) -> DataFrame:
    return coverage.best_scores(retrieval.best_by_corpus(*_sides(spark, sf)))


VECTORS = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
PAIRS = f"""{VECTORS}, q AS (SELECT vec_id AS qid, v AS qvec FROM v WHERE vec_id % 50 = 0),
c AS (SELECT vec_id AS cid, CASE WHEN label % 2 = 0 THEN 'policy' ELSE 'legal' END AS corpus, v AS cvec FROM v),
p AS (SELECT qid, cid, corpus, round(list_cosine_similarity(qvec, cvec), 6) AS sim FROM q, c)"""
SCORES = f"{PAIRS}, s AS (SELECT qid, max(CASE WHEN corpus = 'policy' THEN sim END) AS policy, max(CASE WHEN corpus = 'legal' THEN sim END) AS legal FROM p WHERE qid <> cid GROUP BY qid)"
CLASS = "CASE WHEN policy >= {0} AND legal >= {1} THEN 'covered' WHEN legal >= {1} THEN 'legal_only' WHEN policy >= {0} THEN 'policy_only' ELSE 'uncovered' END"


@query(f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, cid) - 1 AS dense_rank FROM p) SELECT qid, cid, sim, CAST(dense_rank AS INTEGER) AS dense_rank FROM r WHERE dense_rank < 8")
def dense_topk(spark, sf):
    q, c = _sides(spark, sf)
    return retrieval.dense(q, c.drop("corpus"), 8)


@query(SQL["dense_topk"])
def pruned_topk(spark, sf):
    q, c = _sides(spark, sf)
    return vector_index.search(vector_index.build(c.drop("corpus")), q, 8)


@query(f"WITH {SCORES} SELECT qid, policy, legal, {CLASS.format(TAU, TAU)} AS classification FROM s")
def coverage_classes(spark, sf):
    return coverage.coverage(_scores(spark, sf), TAU, TAU).drop("absence_notices")


@query(f"WITH {SCORES}, k AS (SELECT {CLASS.format(TAU, TAU)} AS classification FROM s) SELECT classification, count(*) AS n FROM k GROUP BY 1")
def coverage_counts(spark, sf):
    return coverage_classes(spark, sf).groupBy("classification").agg(F.count("*").alias("n"))


@query(f"""WITH {SCORES} SELECT qid, concat_ws(' ', CASE WHEN NOT coalesce(policy >= {TAU}, false) THEN 'No passage in the indexed policy corpus met the threshold.' END,
CASE WHEN NOT coalesce(legal >= {TAU}, false) THEN 'No passage in the indexed legal corpus met the threshold.' END) AS notices FROM s""")
def absence_notices(spark, sf):
    return coverage.coverage(_scores(spark, sf), TAU, TAU).select("qid", F.array_join("absence_notices", " ").alias("notices"))


def _records(spark, sf):
    return _scores(spark, sf).withColumn("expected", coverage.classify(F.col("policy"), F.col("legal"), 0.32, 0.34))


EXPECTED = f"{SCORES}, e AS (SELECT *, {CLASS.format(0.32, 0.34)} AS expected FROM s)"
GRID = "g AS (SELECT CAST(range AS DOUBLE) / 100 AS tau FROM range(20, 41, 2))"


@query(f"WITH {EXPECTED}, {GRID} SELECT tau, round(avg(CAST(hit AS DOUBLE)), 6) AS accuracy, CAST(sum(hit) AS BIGINT) AS correct, count(*) AS total FROM (SELECT tau, CAST(({CLASS.format('tau', 'tau')}) = expected AS INTEGER) AS hit FROM e, g) GROUP BY tau")
def threshold_sweep(spark, sf):
    return coverage.sweep(_records(spark, sf), coverage.grid(spark, 20, 40, 2))


@query(f"""WITH {EXPECTED}, {GRID}, h AS (SELECT a.tau AS tau_policy, b.tau AS tau_legal, CAST(({CLASS.format('a.tau', 'b.tau')}) = expected AS INTEGER) AS hit FROM e, g a, g b)
SELECT tau_policy, tau_legal, round(avg(CAST(hit AS DOUBLE)), 6) AS accuracy FROM h GROUP BY 1, 2 ORDER BY accuracy DESC, tau_policy, tau_legal LIMIT 1""")
def best_threshold_pair(spark, sf):
    return coverage.best_pair(_records(spark, sf), coverage.grid(spark, 20, 40, 2))


@query(f"WITH {EXPECTED}, k AS (SELECT expected, {CLASS.format(TAU, TAU)} AS predicted FROM e) SELECT expected, " + ", ".join(f"count(*) FILTER (WHERE predicted = '{c}') AS {c}" for c in coverage.CLASSES) + " FROM k GROUP BY expected")
def confusion_matrix(spark, sf):
    r = _records(spark, sf)
    return coverage.confusion(r.withColumn("predicted", coverage.classify(F.col("policy"), F.col("legal"), TAU, TAU)))


@query("SELECT count(*) FILTER (WHERE contains(lower(d.text), lower(split_part(b.text, ' ', 1)))) AS correct, count(*) AS total FROM documents d JOIN benchmark b ON d.doc_id = b.item_id")
def citation_accuracy(spark, sf):
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    j = d.join(b.select(F.col("item_id").alias("doc_id"), F.split_part("text", F.lit(" "), F.lit(1)).alias("wanted")), "doc_id")
    return coverage.citation_accuracy(j.select("wanted", F.col("text").alias("section")))


BM25 = """t AS (SELECT doc_id AS cid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents),
tf AS (SELECT cid, word, count(*) AS tf FROM t GROUP BY 1, 2),
dl AS (SELECT doc_id AS cid, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM documents),
sz AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
raw AS (SELECT word, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM df, sz),
idf AS (SELECT word, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
asked AS (SELECT qid, word, count(*) AS times FROM (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM benchmark) GROUP BY 1, 2),
sc AS (SELECT qid, cid, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN idf USING (word) JOIN tf USING (word) JOIN dl USING (cid), sz GROUP BY 1, 2),
lex AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) - 1 AS INTEGER) AS lex_rank FROM sc WHERE score > 0)"""


def _benchmark_queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _document_chunks(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("cid"), "text")


@query(f"WITH {BM25} SELECT qid, cid, round(score, 4) AS score, lex_rank FROM lex WHERE lex_rank < 8")
def bm25_topk(spark, sf):
    return retrieval.bm25(_benchmark_queries(spark, sf), _document_chunks(spark, sf), 8).withColumn("score", F.round("score", 4))


@query(f"""WITH {BM25}, e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT b.item_id AS qid, d.doc_id AS cid, round(list_cosine_similarity(x.v, y.v), 6) AS sim FROM benchmark b JOIN e x ON x.vec_id = b.item_id, documents d JOIN e y ON y.vec_id = d.doc_id),
dn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, cid) - 1 AS dense_rank FROM p),
f AS (SELECT dn.qid, dn.cid, sim, dense_rank, round(1.0 / (60 + dense_rank + 1) + coalesce(1.0 / (60 + l.lex_rank + 1), 0), 8) AS fused FROM dn LEFT JOIN (SELECT * FROM lex WHERE lex_rank < 8) l ON l.qid = dn.qid AND l.cid = dn.cid WHERE dense_rank < 24 AND sim >= 0.1),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY fused DESC, dense_rank) - 1 AS INTEGER) AS rank FROM f)
SELECT qid, cid, sim, fused, rank FROM r WHERE rank < 8""")
def hybrid_rrf(spark, sf):
    v = _vectors(spark, sf)
    q = _benchmark_queries(spark, sf).join(v.select(F.col("vec_id").alias("qid"), F.col("v").alias("qvec")), "qid")
    chunks = _document_chunks(spark, sf)
    c = chunks.select("cid").join(v.select(F.col("vec_id").alias("cid"), F.col("v").alias("cvec")), "cid").where("cvec is not null")
    near = retrieval.dense(q.select("qid", "qvec"), c, 24)
    return retrieval.fuse(near, retrieval.bm25(_benchmark_queries(spark, sf), chunks, 8), 8, 0.1)


NORMAL = "trim(regexp_replace({}, '[\\s\\x{{A0}}]+', ' ', 'g'))"


def _quotes(spark, sf) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("quote")), table(spark, sf, "documents").select(F.col("doc_id").alias("sid"), "text")


@query(f"SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(lower({NORMAL.format('d.text')}), lower({NORMAL.format('b.text')}))")
def verbatim_hits(spark, sf):
    return verbatim.verbatim_pairs(*_quotes(spark, sf)).select(F.col("sid").alias("doc_id"), F.col("qid").alias("item_id"))


@query(f"SELECT doc_id, item_id, strpos(d.text, b.text) - 1 AS \"start\", strpos(d.text, b.text) - 1 + length(b.text) AS \"end\" FROM documents d, benchmark b WHERE contains(lower({NORMAL.format('d.text')}), lower({NORMAL.format('b.text')}))")
def verbatim_spans(spark, sf):
    s = verbatim.verbatim_spans(*_quotes(spark, sf))
    return s.select(F.col("sid").alias("doc_id"), F.col("qid").alias("item_id"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


@query("""WITH b AS (SELECT doc_id, trim(text, E' \\n\\t\\r') AS body FROM documents), c AS (SELECT *, left(body, 400) AS cut FROM b),
p AS (SELECT *, length(cut) - strpos(reverse(cut), ' .') - 1 AS last FROM c)
SELECT doc_id, CASE WHEN body = '' THEN NULL WHEN length(body) <= 400 THEN body WHEN strpos(reverse(cut), ' .') > 0 AND last > 100 THEN left(cut, last + 1) ELSE regexp_replace(cut, ' [^ ]*$', '') || chr(8230) END AS excerpt FROM p""")
def raw_excerpt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.raw_excerpt(F.col("text")).alias("excerpt"))


LINES = "l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents)"


def _lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", F.col("n").cast("bigint"))


@query(f"""WITH {LINES}, m AS (SELECT *, length(line) <= 60 AS nav FROM l),
b AS (SELECT *, coalesce(lag(nav) OVER w, false) OR coalesce(lead(nav) OVER w, false) AS beside FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY n))
SELECT doc_id, n, line FROM b WHERE NOT regexp_matches(line, '(?i)all rights reserved') AND NOT (nav AND beside)""")
def line_neighbour_filter(spark, sf):
    return ingest.without_navigation(_lines(spark, sf), F.length("line") <= 60, F.col("line").rlike("(?i)all rights reserved"))


@query(f"WITH {LINES} SELECT doc_id, n, coalesce(CAST(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS char_start, length(line) AS len FROM l")
def chunk_offsets(spark, sf):
    o = ingest.offsets(_lines(spark, sf).withColumnRenamed("line", "text"), "doc_id", "n")
    return o.select("doc_id", "n", F.col("char_start").cast("bigint").alias("char_start"), F.length("text").cast("bigint").alias("len"))


@query(f"""WITH RECURSIVE {LINES}, w AS (SELECT doc_id, n, CAST(len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words FROM l),
f AS (SELECT doc_id, n, words, words AS run, CAST(0 AS BIGINT) AS grp FROM w WHERE n = 0
UNION ALL SELECT w.doc_id, w.n, w.words, CASE WHEN f.run > 0 AND f.run + w.words > 350 THEN w.words ELSE f.run + w.words END, CASE WHEN f.run > 0 AND f.run + w.words > 350 THEN f.grp + 1 ELSE f.grp END FROM f JOIN w ON w.doc_id = f.doc_id AND w.n = f.n + 1)
SELECT doc_id, grp, count(*) AS lines, CAST(sum(words) AS BIGINT) AS words FROM f GROUP BY 1, 2""")
def greedy_chunks(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.transform(F.split("text", "\n"), text.word_count).alias("sizes"))
    return ingest.grouped_lines(lines, "doc_id", "sizes").groupBy("doc_id", "grp").agg(F.count("*").alias("lines"), F.sum("words").cast("bigint").alias("words"))


@query(SQL["greedy_chunks"])
def long_chunks(spark, sf):
    """As greedy_chunks, with every document's lines spread over tasks."""
    lines = _lines(spark, sf).select("doc_id", "n", text.word_count(F.col("line")).cast("bigint").alias("words"))
    return ingest.long_groups(lines, "doc_id").groupBy("doc_id", "grp").agg(F.count("*").alias("lines"), F.sum("words").cast("bigint").alias("words"))


def _events(spark, sf):
    e = table(spark, sf, "events").withColumn("classification", F.col("event_type"))
    return e, e.agg(F.max("ts").alias("as_of"))


EVENT_CLASSES = ["error", "purchase"]


@query("SELECT event_id, user_id, event_type FROM events, (SELECT max(ts) AS as_of FROM events) WHERE event_type IN ('error', 'purchase') AND ts >= as_of - INTERVAL 7 DAYS")
def gap_inputs_window(spark, sf):
    e, as_of = _events(spark, sf)
    return metrics.gap_inputs(e.crossJoin(F.broadcast(as_of)), F.col("as_of"), 7, EVENT_CLASSES).select("event_id", "user_id", "event_type")


@query("""WITH c AS (SELECT count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type NOT IN ('error', 'purchase')) AS unclassified
FROM events, (SELECT max(ts) AS as_of FROM events) WHERE ts >= as_of - INTERVAL 7 DAYS)
SELECT *, error + purchase AS total_classified, round(CAST(error AS DOUBLE) / nullif(error + purchase, 0), 4) AS error_rate FROM c""")
def standing_rates(spark, sf):
    e, as_of = _events(spark, sf)
    return metrics.coverage_metrics(e.crossJoin(F.broadcast(as_of)), F.col("as_of"), 7, EVENT_CLASSES, "error")


@query("""SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type NOT IN ('error', 'purchase')) AS unclassified,
round(CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / nullif(count(*) FILTER (WHERE event_type IN ('error', 'purchase')), 0), 4) AS rate FROM events GROUP BY 1""")
def daily_rates(spark, sf):
    return metrics.daily(_events(spark, sf)[0], EVENT_CLASSES, "error")


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'error') AS e, count(*) FILTER (WHERE event_type IN ('error', 'purchase')) AS t FROM events GROUP BY 1)
SELECT day, round(CAST(sum(e) OVER w AS DOUBLE) / nullif(sum(t) OVER w, 0), 4) AS rate FROM d WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)""")
def rolling_window_rate(spark, sf):
    d = metrics.daily(_events(spark, sf)[0], EVENT_CLASSES, "error")  # a row a day: the window below orders days, not events
    w = Window.orderBy(F.datediff("day", F.lit("1970-01-01"))).rangeBetween(-6, 0)
    return d.select("day", F.round(F.try_divide(F.sum("error").over(w), F.sum(F.col("error") + F.col("purchase")).over(w)), 4).alias("rate"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT s, 0 FROM (VALUES ('pending'), ('accepted'), ('modified'), ('rejected')) v(s)")
def decision_histogram(spark, sf):
    return metrics.decision_histogram(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status")))


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS amendments, count(*) FILTER (WHERE o_orderstatus <> 'F') AS coverage_notices, round(CAST(count(*) FILTER (WHERE o_orderstatus <> 'F') AS DOUBLE) / count(*), 4) AS unanchored_rejection_rate, CAST(0 AS BIGINT) AS pending, CAST(0 AS BIGINT) AS accepted, CAST(0 AS BIGINT) AS modified, CAST(0 AS BIGINT) AS rejected FROM orders")
def proposal_rates(spark, sf):
    o = table(spark, sf, "orders")
    return metrics.proposal_metrics(o.select(F.when(F.col("o_orderstatus") == "F", "amendment").otherwise("coverage_notice").alias("kind"), F.col("o_orderstatus").alias("status")))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def _facts(spark, sf):
    d = table(spark, sf, "documents")
    has = lambda w: F.lower("text").contains(w)
    return d.select(F.col("doc_id").alias("rid"), has(" the ").alias("specific_examples_present"), has("token").alias("witnesses_mentioned"), has("@").alias("prior_reporting_mentioned"), has("license").alias("impact_described"), has("http").alias("retaliation_mentioned"))


RULES = """f AS (SELECT doc_id AS rid, unnest([1, 2, 3, 4, 5]) AS priority, unnest(['no_specific_example', 'no_witnesses_mentioned', 'no_prior_reporting', 'no_impact_described', 'no_retaliation_context']) AS gap_id,
unnest([contains(lower(text), ' the '), contains(lower(text), 'token'), contains(lower(text), '@'), contains(lower(text), 'license'), contains(lower(text), 'http')]) AS flag, text FROM documents)"""


@query(f"WITH {RULES}, r AS (SELECT rid, gap_id, row_number() OVER (PARTITION BY rid ORDER BY priority) AS rank FROM f WHERE NOT flag) SELECT rid, CAST(rank AS INTEGER) AS rank, gap_id FROM r WHERE rank <= 2")
def gap_rules_top2(spark, sf):
    return rules.top_gaps(_facts(spark, sf), rules.default_rules(spark)).select("rid", "rank", "gap_id")


@query(f"""WITH {RULES}, r AS (SELECT rid, gap_id, row_number() OVER (PARTITION BY rid ORDER BY priority) AS rank FROM f WHERE NOT flag AND NOT (gap_id = 'no_specific_example' AND length(trim(text)) >= 60) AND NOT (gap_id = 'no_prior_reporting' AND rid % 2 = 0))
SELECT rid, CAST(rank AS INTEGER) AS rank, gap_id FROM r WHERE rank <= 2""")
def rule_suppression(spark, sf):
    forms = table(spark, sf, "documents").select(F.col("doc_id").alias("rid"), F.when(F.col("doc_id") % 2 == 0, "Yes").otherwise("no").alias("management_aware"), F.col("text").alias("sequence_of_events"))
    return rules.top_gaps(_facts(spark, sf), rules.default_rules(spark), forms).select("rid", "rank", "gap_id")


@query("SELECT doc_id, CASE WHEN lower(lang) = lower(source) THEN lang ELSE lang || ',' || source END AS merged FROM documents")
def merge_dedupe(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(records.merge_unique(F.array("lang", F.upper("lang")), F.array("source", F.initcap("lang"))), ",").alias("merged"))


SPENT = "m AS (SELECT *, sum(length(text) // 4 + 20) OVER w AS spent, row_number() OVER w AS back FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))"


@query(f"WITH {SPENT} SELECT conv_id, turn, CAST(spent AS BIGINT) AS spent FROM m WHERE spent <= 400 AND back <= 20")
def history_budget(spark, sf):
    return sessions.history(table(spark, sf, "conversations"), context=1012).select("conv_id", "turn", "spent")


@query("""WITH m AS (SELECT conv_id, turn, role || ': ' || left(text, 80) || '...' AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
s AS (SELECT *, sum(length(line)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS spent FROM m WHERE back <= 4)
SELECT conv_id, coalesce(string_agg(line, ' | ' ORDER BY turn) FILTER (WHERE spent <= 200), '(none)') AS recent FROM s GROUP BY 1""")
def recent_digest(spark, sf):
    return sessions.digest(table(spark, sf, "conversations"))


@query("WITH m AS (SELECT *, sum(length(text) // 4 + 20) OVER w AS spent, row_number() OVER w AS back FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) SELECT conv_id, 'System: Be brief.' || chr(10) || chr(10) || string_agg(upper(left(role, 1)) || substr(role, 2) || ': ' || text || chr(10) || chr(10), '' ORDER BY turn) || 'Assistant: ' AS prompt FROM m WHERE spent <= 7578 AND back <= 20 GROUP BY 1")
def conversation_prompt(spark, sf):
    return sessions.prompt(table(spark, sf, "conversations"), "Be brief.")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 3")
def message_cap(spark, sf):
    return sessions.last_rows(table(spark, sf, "conversations"), ["conv_id"], [F.desc("turn")], 3).select("conv_id", "turn")


def _members(spark, sf):
    return _vectors(spark, sf).select(F.col("vec_id").alias("id"), F.col("v").alias("vec"))


@query(f"""WITH RECURSIVE {VECTORS}, p AS (SELECT a.vec_id AS i, b.vec_id AS j FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.40),
r AS (SELECT vec_id AS id, vec_id AS low FROM v UNION SELECT p.j, r.low FROM r JOIN p ON p.i = r.id) SELECT id, min(low) AS component FROM r GROUP BY id""")
def cluster_components(spark, sf):
    return clustering.linked_components(_members(spark, sf), 0.40)


@query()
def cluster_summary(spark, sf):
    v = _members(spark, sf)
    labelled = clustering.cluster(v, 0.40).join(v, "id").join(_vectors(spark, sf).select(F.col("vec_id").alias("id"), F.when(F.col("label") % 2 == 0, "legal_only").otherwise("uncovered").alias("classification")), "id")
    return clustering.summarise(labelled.withColumn("ts", F.expr("timestamp_seconds(id)")), 2, 0.40)


@query(f"WITH {VECTORS} SELECT a.label, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS intra_sim FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label")
def pairwise_intra_sim(spark, sf):
    r = clustering.intra_similarity(_vectors(spark, sf).select("label", F.col("vec_id").alias("id"), F.col("v").alias("vec")), "label")
    return r.select("label", F.round("intra_sim", 6).alias("intra_sim"))


@query(f"WITH {VECTORS}, c AS (SELECT label, unnest(range(len(v))) AS pos, unnest(v) AS x FROM v) SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS x FROM c GROUP BY 1, 2")
def centroids(spark, sf):
    return clustering.centroids(_vectors(spark, sf).select("label", F.col("v").alias("vec")), "label").select("label", F.posexplode("centroid").alias("pos", "x"))


@query("""WITH k AS (SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS key FROM events WHERE event_type = 'error' GROUP BY 1),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id % 2 = 0 ORDER BY key) AS r FROM k)
SELECT key AS member_key, CASE WHEN user_id % 2 = 0 THEN 'old_' || CAST(user_id AS VARCHAR) ELSE 'cc_' || lpad(CAST(r + 6 AS VARCHAR), CAST(greatest(4, length(CAST(r + 6 AS VARCHAR))) AS INTEGER), '0') END AS cluster_id, CASE WHEN user_id % 2 = 0 THEN 'dismissed' ELSE 'open' END AS status FROM n""")
def stable_ids(spark, sf):
    k = table(spark, sf, "events").where("event_type = 'error'").groupBy("user_id").agg(F.collect_list("event_id").alias("member_ids"))
    stored = k.where("user_id % 2 = 0").select("member_ids", F.concat(F.lit("old_"), F.col("user_id").cast("string")).alias("cluster_id"), F.lit("dismissed").alias("status"))
    return clustering.stable_ids(k.select("member_ids"), stored, 7).select(text.member_key(F.col("member_ids")).alias("member_key"), "cluster_id", "status")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM events) WHERE b <= 50")
def fifo_cap(spark, sf):
    return sessions.last_rows(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id")
def newest_first(spark, sf):
    e = table(spark, sf, "events").withColumnsRenamed({"event_id": "proposal_id", "ts": "created_at"})
    return proposals.listed(e).select(F.col("proposal_id").alias("event_id"), F.col("created_at").alias("ts"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F')")
def anti_open_proposals(spark, sf):
    p = table(spark, sf, "orders").select(F.col("o_custkey").alias("cluster_id"), F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("pending").alias("status"))
    return clustering.without_open_proposal(table(spark, sf, "customer").select(F.col("c_custkey").alias("cluster_id")), p).select(F.col("cluster_id").alias("c_custkey"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name || ' ' || chr(8212) || ' Page ' || p_size WHEN p_size % 3 = 1 THEN p_name || ' ' || chr(8212) || ' ' || p_brand ELSE p_name END AS section FROM part")
def section_label(spark, sf):
    p = table(spark, sf, "part")
    page, article = F.when(F.col("p_size") % 3 == 0, F.col("p_size")), F.when(F.col("p_size") % 3 != 2, F.col("p_brand"))
    return p.select("p_partkey", text.section_label(F.col("p_name"), page, article).alias("section"))


@query("SELECT c_custkey, CAST(unnest([1, 3]) AS INTEGER) AS idx, unnest([c_name, c_mktsegment]) AS first FROM customer")
def persons_unpivot(spark, sf):
    c = table(spark, sf, "customer")
    values = {"person_1_first": F.col("c_name"), "person_3_first": F.col("c_mktsegment")}
    form = {f"person_{i}_{k}": values.get(f"person_{i}_{k}", F.lit(None).cast("string")) for i in range(1, 11) for k in ("first", "last", "title")}
    return c.select("c_custkey", F.explode(records.persons_of(form)).alias("p")).select("c_custkey", "p.idx", "p.first")


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_tokens, length(text) // 4 AS est_tokens, trim(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM documents")
def text_functions(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.size(text.tokenize(F.col("text"))).cast("bigint").alias("n_tokens"), text.estimated_tokens(F.col("text")).cast("bigint").alias("est_tokens"), text.slugify(F.col("source")).alias("slug"))


HEADER = "trim(line) <> '' AND length(trim(line)) <= 120 AND len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '')) <= 12 AND NOT regexp_matches(trim(line), '^\\d+$') AND (regexp_matches(trim(line), '(?i)^(section\\s+)?\\d+(\\.\\d+)*[.:\\s]') OR regexp_matches(trim(line), '^[A-Z][A-Z\\s\\-&,/]{2,}$') OR lower(trim(line)) = 'cold widget')"


@query(f"""WITH {LINES}, p AS (SELECT p_partkey, unnest(['t', 'n', 's', 'z']) AS form, unnest([p_type, p_name, 'Section ' || p_size || '.1: ' || p_name, CAST(p_size AS VARCHAR)]) AS line FROM part),
a AS (SELECT 'document' AS kind, doc_id AS id, CAST(n AS VARCHAR) AS n, line FROM l UNION ALL SELECT 'part', p_partkey, form, line FROM p) SELECT kind, id, n FROM a WHERE {HEADER}""")
def header_lines(spark, sf):
    p = table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    forms = {"t": F.col("p_type"), "n": F.col("p_name"), "s": F.concat(F.lit("Section "), size, F.lit(".1: "), F.col("p_name")), "z": size}
    parts = p.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.explode(F.array(*[F.struct(F.lit(k).alias("n"), v.alias("line")) for k, v in forms.items()])).alias("x")).select("kind", "id", "x.n", "x.line")
    lines = _lines(spark, sf).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("n").cast("string").alias("n"), "line")
    return lines.union(parts).where(text.likely_header(F.col("line"), ["cold widget"])).select("kind", "id", "n")


@query("SELECT count(*) AS n_chunks, count(DISTINCT source) AS n_sections, min(n_chars) AS min_words, max(n_chars) AS max_words, CAST(sum(n_chars) // count(*) AS BIGINT) AS avg_words FROM documents")
def chunk_stats(spark, sf):
    return metrics.chunk_stats(table(spark, sf, "documents").select(F.col("source").alias("section_title"), F.col("n_chars").alias("words")))


@query("SELECT conv_id, turn, CASE WHEN length(trim(text)) = 0 THEN 'empty' WHEN length(trim(text)) > 200 THEN 'too long' END AS refused FROM conversations")
def message_validation(spark, sf):
    return sessions.valid_messages(table(spark, sf, "conversations"), 200).select("conv_id", "turn", "refused")


@query("SELECT conv_id AS run_id, CASE WHEN bool_or(role = 'system') THEN 'fail' WHEN bool_or(role = 'assistant') THEN 'partial' ELSE 'pass' END AS overall FROM conversations GROUP BY 1")
def overall_status(spark, sf):
    status = F.when(F.col("role") == "system", "fail").when(F.col("role") == "assistant", "skip").otherwise("pass")
    return metrics.overall_status(table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), status.alias("status"), F.array().cast("array<string>").alias("violations")))


@query("SELECT event_type, user_id % 3 AS u, count(*) AS n FROM events GROUP BY 1, 2")
def class_histogram(spark, sf):
    h = records.histogram(table(spark, sf, "events").withColumn("u", F.col("user_id") % 3), ["event_type"], "u")
    return h.select("event_type", F.explode("counts").alias("u", "n"))


@query()
def page_articles(spark, sf):
    return ingest.statute_chunks(ingest.page_blocks(table(spark, sf, "pages")))


@query()
def section_chunks(spark, sf):
    p = _lines(spark, sf).select("doc_id", F.lit(1).cast("bigint").alias("page"), "n", F.col("line").alias("text"))
    return ingest.section_chunks(p, ["introduction"])


@query()
def diff_spans(spark, sf):
    text_batches(spark)
    pairs = proposals.neighbours(table(spark, sf, "documents").select("doc_id", "source", "text"))
    return pairs.select("doc_id", F.round("ratio", 6).alias("ratio"), "n_spans")
