"""Registered queries over proposals, pipeline runs, schema sentences and cached vectors, with their SQL; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import records
from lodestone.operators import clustering, proposals, rules
from lodestone.plans.catalog import query
from lodestone.plans.session import table


@query("""WITH k AS (SELECT o_orderkey AS proposal_id, o_orderkey % 4 AS a, o_orderkey % 5 <> 0 AS decided, o_orderkey % 3 <> 0 AS said, o_orderkey % 7 <> 0 AS why FROM orders)
SELECT proposal_id, CASE WHEN NOT decided THEN 'pending' WHEN a = 0 THEN 'accepted' WHEN a = 1 AND said THEN 'modified' WHEN a = 2 AND why THEN 'rejected' ELSE 'pending' END AS status,
CASE WHEN NOT decided THEN NULL WHEN a = 0 THEN 'accept' WHEN a = 1 AND said THEN 'modify' WHEN a = 2 AND why THEN 'reject' END AS action FROM k""")
def reviewed_proposals(spark, sf):
    """[G8, K9, F13] decisions on pending proposals; a change without a text, a rejection without a reason and unknown actions are refused."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("proposal_id"))
    action = F.element_at(F.array(*map(F.lit, ["accept", "modify", "reject", "postpone"])), (F.col("proposal_id") % 4 + 1).cast("int"))
    text, reason = F.when(F.col("proposal_id") % 3 != 0, "new wording").otherwise(" "), F.when(F.col("proposal_id") % 7 != 0, "too broad")
    decisions = o.where("proposal_id % 5 <> 0").select("proposal_id", action.alias("action"), text.alias("text"), reason.alias("reason"))
    done = proposals.apply_decisions(o.withColumn("status", F.lit("pending")), decisions)
    return done.select("proposal_id", "status", "reviewer_decision.action")


@query("""WITH k AS (SELECT o_orderkey AS proposal_id, o_orderkey % 4 AS a, o_orderkey % 3 <> 0 AS said, o_orderkey % 7 <> 0 AS why FROM orders)
SELECT proposal_id, CASE WHEN a = 3 THEN 'unknown action' WHEN a = 1 AND NOT said THEN 'text is needed' WHEN a = 2 AND NOT why THEN 'reason is needed' END AS refused FROM k""")
def refused_decisions(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("proposal_id"))
    action = F.element_at(F.array(*map(F.lit, ["accept", "modify", "reject", "postpone"])), (F.col("proposal_id") % 4 + 1).cast("int"))
    decisions = o.select("proposal_id", action.alias("action"), F.when(F.col("proposal_id") % 3 != 0, "new wording").alias("text"), F.when(F.col("proposal_id") % 7 != 0, "too broad").otherwise("").alias("reason"))
    return proposals.refusals(decisions).select("proposal_id", "refused")


#: What each step of a run has to meet; roles stand for steps.
EXPECTED = [("user", True, 60, 3, 1, True, "long"), ("assistant", True, 40, 4, None, False, None), ("system", False, None, None, None, None, "short")]


@query("""WITH r AS (SELECT conv_id AS run_id, role AS step, sum(length(text)) > 100 AS passed, sum(length(text)) AS len, count(*) AS gaps, max(CASE WHEN length(text) % 2 = 0 THEN text ELSE '' END) AS quote, CASE WHEN sum(length(text)) > 300 THEN 'long' ELSE 'short' END AS cls FROM conversations GROUP BY 1, 2),
e(step, should, min_length, max_gaps, min_gaps, must, want) AS (VALUES ('user', true, 60, 3, 1, true, 'long'), ('assistant', true, 40, 4, NULL, false, NULL), ('system', false, NULL, NULL, NULL, NULL, 'short'))
SELECT run_id, r.step, concat_ws(',', CASE WHEN should <> passed THEN 'pass' END, CASE WHEN len < min_length THEN 'min_length' END, CASE WHEN gaps > max_gaps THEN 'max_gaps' END, CASE WHEN gaps < min_gaps THEN 'min_gaps' END,
CASE WHEN must AND coalesce(quote, '') = '' THEN 'quote' END, CASE WHEN want <> cls THEN 'classification' END) AS violations FROM r LEFT JOIN e ON e.step = r.step""")
def pipeline_violations(spark, sf):
    """[E11] the expectations that each step of a run breaks."""
    size = F.sum(F.length("text"))
    quote = F.max(F.when(F.length("text") % 2 == 0, F.col("text")).otherwise(""))
    runs = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("run_id"), F.col("role").alias("step")).agg((size > 100).alias("passed"), size.alias("length"), F.count("*").alias("gaps"), quote.alias("quote"), F.when(size > 300, "long").otherwise("short").alias("classification"))
    limits = spark.createDataFrame(EXPECTED, "step string, should_pass boolean, min_length int, max_gaps int, min_gaps int, must_have_quote boolean, expected_classification string")
    return rules.check_expectations(runs, limits).select("run_id", "step", F.array_join("violations", ",").alias("violations"))


@query("""WITH c AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'unspecified' WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE c_mktsegment || ', other' END AS kinds FROM customer)
SELECT c_custkey AS rid, 'Allegation types: ' || kinds || '. Summary: ' || CASE WHEN c_custkey % 4 = 0 THEN 'none' ELSE c_name END || '. Evidence described: ' || CASE WHEN c_nationkey % 2 = 0 THEN 'yes' ELSE 'no' END
|| '. Retaliation mentioned: ' || CASE WHEN c_nationkey % 5 = 0 THEN 'yes' ELSE 'no' END || '. Impact described: ' || CASE WHEN c_acctbal > 0 THEN 'yes' ELSE 'no' END || '.' || CASE WHEN c_custkey % 2 = 0 THEN ' Coverage: legal_only.' ELSE '' END AS said FROM c""")
def schema_sentences(spark, sf):
    """[P2] a sentence of each customer's extracted fields, for embedding."""
    key = F.col("c_custkey")
    kinds = F.when(key % 3 == 0, F.array().cast("array<string>")).when(key % 3 == 1, F.array("c_mktsegment")).otherwise(F.array("c_mktsegment", F.lit("other")))
    flags = [(F.col("c_nationkey") % 2 == 0).alias("evidence_described"), (F.col("c_nationkey") % 5 == 0).alias("retaliation_mentioned"), (F.col("c_acctbal") > 0).alias("impact_described")]
    extraction = F.struct(kinds.alias("allegation_type"), F.when(key % 4 == 0, "").otherwise(F.col("c_name")).alias("summary"), *flags)
    c = table(spark, sf, "customer").withColumn("x", extraction)
    return c.select(key.alias("rid"), records.schema_text(F.col("x"), F.when(key % 2 == 0, "legal_only").otherwise(" ")).alias("said"))


@query("""WITH c AS (SELECT doc_id AS id, sha256(text || CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE '' END) AS hash FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id AS id, sha256(text) AS hash FROM documents d WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.id = d.doc_id AND c.hash = sha256(d.text))""")
def stale_vectors(spark, sf):
    """[G1, J7] texts that a cache of vectors does not hold as they are now."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    then = F.when(F.col("id") % 10 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    return clustering.stale(d, d.where("id % 2 = 0").select("id", F.sha2(then, 256).alias("hash"))).select("id", "hash")
