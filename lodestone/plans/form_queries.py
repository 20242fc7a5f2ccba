"""Registered queries over forms, runs and state, with their SQL; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import forms
from lodestone.operators import analysis, coverage, ingest, retrieval
from lodestone.plans import catalog
from lodestone.plans.catalog import query
from lodestone.plans.session import table
from lodestone.plans.shared import materialise

# The form's fields that the customer table stands in for; all others are blank.
FORM = {"general_nature": "c_mktsegment", "where_occurred": "c_name", "when_occurred": "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'day ' || c_custkey END", "has_supporting_materials": "CASE WHEN c_custkey % 2 = 0 THEN 'no' ELSE 'yes' END", "evidence_description": "CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE 'files' END", "person_1_first": "CASE WHEN c_custkey % 2 = 0 THEN c_name END", "person_1_title": "CASE WHEN c_custkey % 4 < 2 THEN 'clerk' END", "how_aware": "CASE WHEN c_nationkey = 3 THEN 'heard' END"}


def _reports(spark, sf):
    """Customers as reports: rid and form (a map of strings with every key of the forms)."""
    keys = sorted({k for _, k in [*forms.BLOCKS, *forms.LINES, *forms.TOLD]} | {"full_details_q1", "how_aware_other"} | {f"person_{i}_{k}" for i in range(1, 11) for k in ("first", "last", "title")})
    pairs = ", ".join(f"'{k}', CAST({FORM.get(k, 'NULL')} AS STRING)" for k in keys)
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("rid"), F.expr(f"map({pairs})").alias("form"))


COLUMNS = ", ".join(f"{v} AS {k}" for k, v in FORM.items())


@query(f"""WITH f AS (SELECT c_custkey AS rid, {COLUMNS} FROM customer),
p AS (SELECT *, coalesce(person_1_first, '') AS nm, coalesce(person_1_title, '') AS ti FROM f)
SELECT rid, concat_ws(chr(10) || chr(10), '[CHRONOLOGY]' || chr(10) || general_nature, CASE WHEN trim(evidence_description) <> '' THEN '[EVIDENCE_DESCRIPTION]' || chr(10) || trim(evidence_description) END, '[HOW_AWARE]' || chr(10) || how_aware,
'[STRUCTURED]' || chr(10) || concat_ws(chr(10), CASE WHEN when_occurred <> '' THEN '- When: ' || when_occurred END, '- Where: ' || where_occurred, '- Supporting materials: ' || has_supporting_materials,
CASE WHEN nm <> '' OR ti <> '' THEN '- Person 1:' || CASE WHEN nm <> '' THEN ' ' || nm ELSE '' END || CASE WHEN ti = '' THEN '' WHEN nm <> '' THEN ', ' || ti ELSE ' ' || ti END END)) AS sections FROM p""")
def labelled_sections(spark, sf):
    return _reports(spark, sf).select("rid", forms.labelled_sections(F.lit(None).cast("string"), F.col("form")).alias("sections"))


@query("SELECT c_custkey AS rid, 'Chronological incident account: ' || c_mktsegment || '. Location: ' || c_name || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '. When: day ' || c_custkey END || CASE WHEN c_nationkey = 3 THEN '. How became aware: heard' ELSE '' END AS told FROM customer")
def analysis_text(spark, sf):
    return _reports(spark, sf).select("rid", forms.analysis_text(F.col("form")).alias("told"))


CATALOGUE = [(1, "general_nature", "Nature", None, None), (2, "when_occurred", "When", None, None), (3, "evidence_description", "Evidence", "has_supporting_materials", "no"), (4, "country", "Country", None, None)]
LABELS = [("general_nature", "BUILDING", "Building trade"), ("general_nature", "HOUSEHOLD", "Home")]


def _catalogue(spark):
    return spark.createDataFrame(CATALOGUE, "pos int, key string, label string, hide_key string, hide_value string")


@query("""WITH e AS (SELECT c_custkey AS rid, unnest([1, 2, 3, 4]) AS pos, unnest(['Nature', 'When', 'Evidence', 'Country']) AS label,
unnest([CASE c_mktsegment WHEN 'BUILDING' THEN 'Building trade' WHEN 'HOUSEHOLD' THEN 'Home' ELSE c_mktsegment END, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'day ' || c_custkey END, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'files' END, '']) AS v FROM customer)
SELECT rid, CAST(pos AS INTEGER) AS pos, label, CASE WHEN v = '' THEN 'Not provided' ELSE v END AS display FROM e WHERE NOT (pos = 3 AND rid % 2 = 0)""")
def displayed_fields(spark, sf):
    labels = spark.createDataFrame(LABELS, "key string, value string, label string")
    return forms.displayed_fields(_reports(spark, sf), _catalogue(spark), labels).select("rid", "pos", "label", "display")


@query("""SELECT c_custkey AS rid, concat_ws(',', 'general_nature', CASE WHEN c_custkey % 3 <> 0 THEN 'when_occurred' END, CASE WHEN c_custkey % 5 <> 0 THEN 'evidence_description' END) AS filled,
concat_ws(',', CASE WHEN c_custkey % 3 = 0 THEN 'when_occurred' END, CASE WHEN c_custkey % 5 = 0 THEN 'evidence_description' END, 'country') AS unfilled FROM customer""")
def filled_fields(spark, sf):
    return forms.filled_and_unfilled(_reports(spark, sf), _catalogue(spark)).select("rid", F.array_join("filled", ",").alias("filled"), F.array_join("unfilled", ",").alias("unfilled"))


@query("SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'Anonymous' WHEN user_id % 5 = 1 THEN 'Blank Name' ELSE event_type END AS reporter, strftime(ts, '%Y-%m-%d %H:%M UTC') AS shown, 'report-id' || event_id || '-' || strftime(ts, '%Y%m%dT%H%M%SZ') || '.pdf' AS file FROM events")
def feed_rows(spark, sf):
    e = table(spark, sf, "events")
    name = F.when(F.col("user_id") % 5 > 1, F.col("event_type"))
    return e.select("event_id", forms.reporter(F.when(F.col("user_id") % 5 == 0, "yes"), name, F.lit(" ")).alias("reporter"), forms.utc_minute(F.col("ts")).alias("shown"), forms.report_file_name(F.col("event_id"), F.col("ts")).alias("file"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name || ': Not present' WHEN 1 THEN p_name || ': None provided' WHEN 2 THEN p_name || ': Below ' || p_size || ' characters' ELSE 'other' END AS criteria, CASE WHEN p_size % 2 = 0 THEN p_brand || ', ' || p_type ELSE 'None' END AS listed FROM part")
def criteria_text(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ["boolean_false", "empty_array", "length_threshold", "other"])), (F.col("p_size") % 4 + 1).cast("int"))
    items = F.when(F.col("p_size") % 2 == 0, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "part").select("p_partkey", forms.criteria_text(kind, F.col("p_name"), F.col("p_size")).alias("criteria"), forms.list_or_none(items).alias("listed"))


@query("SELECT p_partkey AS value, p_name AS label FROM part WHERE contains(lower(p_name), 'widget')")
def option_search(spark, sf):
    options = table(spark, sf, "part").select(F.col("p_partkey").alias("value"), F.col("p_name").alias("label"))
    return forms.matching_options(options, F.lit(" WIDGET "))


@query("""SELECT doc_id, coalesce(source, '') AS summary, coalesce(lang, '') AS people, n_chars > 1000 AS evidence_described, CASE WHEN doc_id % 2 = 0 THEN n_chars > 500 END AS witnesses_mentioned, CAST(n_chars AS INTEGER) AS length_character_count FROM documents""")
def stored_extractions(spark, sf):
    """Stored JSON is written from the documents' columns and read back with defaults."""
    flag = lambda c: F.when(c, "true").otherwise("false")
    d = table(spark, sf, "documents")
    text = F.concat(F.lit('{"summary": "'), "source", F.lit('", "people_mentioned": ["'), "lang", F.lit('"], "evidence_described": '), flag(F.col("n_chars") > 1000), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(', "witnesses_mentioned": '), flag(F.col("n_chars") > 500))).otherwise(""), F.lit(', "length_character_count": '), F.col("n_chars").cast("string"), F.lit("}"))
    x = d.select("doc_id", forms.stored_extraction(text).alias("x"))
    return x.select("doc_id", "x.summary", F.array_join("x.people_mentioned", ",").alias("people"), "x.evidence_described", "x.witnesses_mentioned", "x.length_character_count")


@query("SELECT doc_id, source AS summary, n_chars > 1000 AS evidence_described, n_chars > 500 AS witnesses_mentioned, CAST(length(text) AS INTEGER) AS measured, doc_id % 7 = 0 AS used_defaults FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, '', false, false, CAST(length(text) AS INTEGER), true FROM documents WHERE doc_id % 7 = 0")
def one_shot_extractions(spark, sf):
    """Replies with prose around one object for both passes; every seventh has no object and gets the safe defaults."""
    flag = lambda c: F.when(c, "true").otherwise("false")
    reply = F.concat(F.lit('Here: {"summary": "'), "source", F.lit('", "evidence_described": '), flag(F.col("n_chars") > 1000), F.lit(', "witnesses_mentioned": '), flag(F.col("n_chars") > 500), F.lit("} done"))
    x = table(spark, sf, "documents").select("doc_id", forms.public_slice(forms.one_shot(F.when(F.col("doc_id") % 7 == 0, "no object").otherwise(reply), F.col("text"))).alias("x"))
    return x.select("doc_id", "x.summary", "x.evidence_described", "x.witnesses_mentioned", F.col("x.length_character_count").alias("measured"), "x.used_defaults")


@query("SELECT count(*) FILTER (WHERE event_type IN ('error', 'purchase')) AS inputs_considered FROM events")
def inputs_considered(spark, sf):
    return analysis.inputs_considered(table(spark, sf, "events").withColumn("classification", F.col("event_type")), catalog.EVENT_CLASSES)


def _run(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    clusters = c.select(F.col("c_custkey").alias("cluster_id"), (F.col("c_acctbal") > 0).alias("is_candidate"))
    proposals = o.select(F.col("o_custkey").alias("cluster_id"), F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("pending").alias("status"))
    drafts = c.where("c_nationkey <> 3").select(F.col("c_custkey").alias("cluster_id"), F.when(F.col("c_mktsegment") == "BUILDING", "amendment").otherwise("coverage_notice").alias("kind"))
    return analysis.analysis_outcomes(clusters, proposals, drafts)


OUTCOMES = "r AS (SELECT c_custkey AS cluster_id, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F') THEN 'skipped' WHEN c_nationkey = 3 THEN 'failed' WHEN c_mktsegment = 'BUILDING' THEN 'amendment' ELSE 'coverage_notice' END AS outcome FROM customer WHERE c_acctbal > 0)"


@query(f"WITH {OUTCOMES} SELECT * FROM r")
def analysis_outcomes(spark, sf):
    return _run(spark, sf)


@query(f"WITH {OUTCOMES} SELECT " + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {n}" for o, n in (("amendment", "proposals_created"), ("coverage_notice", "notices_created"), ("skipped", "skipped_existing"), ("failed", "generation_failures"))) + " FROM r")
def analysis_counters(spark, sf):
    return analysis.analysis_counters(_run(spark, sf))


@query("""SELECT event_id, EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND CAST(b.ts AS DATE) = CAST(a.ts AS DATE) AND b.event_type = 'error' AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id))) AS exhausted FROM events a""")
def exhausted_today(spark, sf):
    return analysis.exhausted_today(table(spark, sf, "events"), "user_id", F.col("event_type") == "error").select("event_id", "exhausted")


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'empty' WHEN p_brand <> 'Brand#13' THEN 'other model' WHEN p_size > 25 THEN 'other dimensions' END AS problem FROM part")
def index_problems(spark, sf):
    dims = F.when(F.col("p_size") > 25, 768).otherwise(3072)
    return table(spark, sf, "part").select("p_partkey", analysis.index_problem(F.col("p_brand"), dims, F.col("p_size") % 5, "Brand#13", 3072).alias("problem"))


@query("SELECT c_custkey AS id, coalesce(o.v, c_name) AS v FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS v FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def cache_upsert(spark, sf):
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderpriority").alias("v"))
    return analysis.upsert(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("v")), new, "id")


@query(f"""WITH {catalog.EXPECTED}, {catalog.GRID}, k AS (SELECT * FROM e WHERE qid % 150 <> 0)
SELECT tau, round(avg(CAST(hit AS DOUBLE)), 6) AS accuracy, CAST(sum(hit) AS BIGINT) AS correct, count(*) AS total, (SELECT count(*) FROM e WHERE qid % 150 = 0) AS excluded FROM (SELECT tau, CAST(({catalog.CLASS.format('tau', 'tau')}) = expected AS INTEGER) AS hit FROM k, g) GROUP BY tau""")
def calibration_run(spark, sf):
    """The sweep with outages: queries whose id 150 divides count as degraded."""
    return analysis.calibrate(catalog._records(spark, sf).withColumn("degraded", F.col("qid") % 150 == 0), coverage.grid(spark, 20, 40, 2))


EXCERPT = """b AS (SELECT doc_id, text, trim(text, E' \\n\\t\\r') AS body, left(trim(text, E' \\n\\t\\r'), 400) AS cut FROM documents), x AS (SELECT *, length(cut) - strpos(reverse(cut), ' .') - 1 AS last FROM b),
ex AS (SELECT doc_id, text, CASE WHEN body = '' THEN NULL WHEN length(body) <= 400 THEN body WHEN strpos(reverse(cut), ' .') > 0 AND last > 100 THEN left(cut, last + 1) ELSE regexp_replace(cut, ' [^ ]*$', '') || chr(8230) END AS excerpt FROM x)"""


@query(f"""WITH {catalog.BM25}, {EXCERPT}, top AS (SELECT l.qid, l.cid, lex_rank, b.text AS asked FROM lex l JOIN benchmark b ON b.item_id = l.qid WHERE lex_rank < 3),
s AS (SELECT qid, cid, row_number() OVER (PARTITION BY qid ORDER BY 10 - lex_rank DESC, lex_rank) AS r, contains(lower({catalog.NORMAL.format('ex.text')}), lower({catalog.NORMAL.format('asked')})) AS has, asked, excerpt FROM top JOIN ex ON ex.doc_id = cid),
u AS (SELECT *, CASE WHEN has THEN asked ELSE excerpt END AS q FROM s), f AS (SELECT * FROM u WHERE q IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY r) = 1)
SELECT item_id AS qid, f.q AS quote, CAST(f.cid AS VARCHAR) AS section, CASE WHEN f.q IS NULL THEN 'policy_unavailable' END AS error FROM benchmark LEFT JOIN f ON f.qid = item_id""")
def policy_quotes(spark, sf):
    """Passages ask the documents: three lexical candidates, scored by rank; the second reader proposes the passage itself."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    hits = materialise(retrieval.bm25(q.withColumnRenamed("query", "text"), catalog._document_chunks(spark, sf), 3), "hits")  # read three times below
    c = hits.join(catalog._document_chunks(spark, sf), "cid").select("qid", F.col("lex_rank").alias("idx"), "text", F.col("cid").cast("string").alias("section"), F.col("score").alias("similarity"))
    answers = c.groupBy("qid").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("idx").alias("index"), (10 - F.col("idx")).cast("double").alias("score"))).alias("scores"))).alias("raw"))
    extracted = c.select("qid", "idx").join(q.withColumnRenamed("query", "extracted"), "qid")
    return analysis.policy_quotes(q, c, answers, extracted).select("qid", "quote", "section", "error")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus || ' | ' || o_orderpriority AS line, o_orderstatus || ' ' || o_orderpriority AS words FROM orders),
t AS (SELECT o_custkey AS page, string_agg(line, chr(10) ORDER BY o_orderkey) AS text, sum(len(list_filter(string_split(words, ' '), lambda x: x <> '')) + 1) AS n FROM o GROUP BY 1)
SELECT c_nationkey AS doc, c_custkey AS page, CAST(0 AS INTEGER) AS place, 'text' AS kind, c_name || ' of ' || c_mktsegment AS text FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_nationkey, c_custkey, 1, 'table', t.text FROM t JOIN customer ON c_custkey = t.page WHERE t.n >= 10""")
def page_texts(spark, sf):
    """Customers as pages, every third without text, and their orders as a table of two cells a row."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    pages = c.select(F.col("c_nationkey").alias("doc"), F.col("c_custkey").alias("page"), F.when(F.col("c_custkey") % 3 == 0, " (cid:7) ").otherwise(F.concat("c_name", F.lit("(cid:12)of  "), "c_mktsegment")).alias("text"))
    rows = o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("cells")))), lambda r: r["cells"]).alias("rows"))
    tables = rows.join(c, rows.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("doc"), F.col("c_custkey").alias("page"), F.lit(1).alias("idx"), "rows")
    return ingest.page_texts(pages, tables)
