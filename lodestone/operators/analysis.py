"""Runs that chain the operators: quote queries, calibration, gap analysis, index checks and day-scoped state [R9, E10, G7, A5, S9, K12, D3, ST7]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import joined_nonblank, trimmed
from lodestone.operators import coverage
from lodestone.operators.metrics import GAP_CLASSES
from lodestone.operators.rerank import first_usable, rerank, select_quote

# Form keys that make a query, in order.
QUERY_KEYS = ["full_details_q1", "full_details_q2", "general_nature", "where_occurred"]


def query_text(form, sentence) -> Column:
    """[R9] the constructed sentence, else the form's telling fields in one line; null without any."""
    given = trimmed(sentence)
    return F.nullif(F.when(given != "", given).otherwise(joined_nonblank([form[k] for k in QUERY_KEYS], " ")), F.lit(""))


def policy_quotes(asked: DataFrame, candidates: DataFrame, answers: DataFrame, extracted: DataFrame | None = None, least: float = 3.0) -> DataFrame:
    """[R9, R4, R5, T8] qid, quote, section, similarity, score, error of each query: the best-ranked candidate that gives a quote.

    ``asked``: qid, query; ``candidates``: qid, idx, text, section, similarity; ``answers``: qid, raw (a scorer's reply, null
    for an outage); ``extracted``: qid, idx, extracted (a second reader's quotes). A query without text has the error
    no_query_text; an outage or no candidate of ``least`` has policy_unavailable.
    """
    ranked = rerank(candidates.select("qid", "idx", "text", "similarity"), answers, least).where("status = 'ok'")
    ranked = ranked.join(extracted, ["qid", "idx"], "left") if extracted is not None else ranked.withColumn("extracted", F.lit(None).cast("string"))
    ranked = ranked.withColumn("quote", select_quote(F.col("text"), F.col("quote"), F.col("extracted")))
    best = first_usable(ranked.join(candidates.select("qid", "idx", "section"), ["qid", "idx"]).select("qid", "rank", "quote", "section", "similarity", "score"))
    error = F.when(trimmed(F.col("query")) == "", "no_query_text").when(F.col("quote").isNull(), "policy_unavailable")
    shown = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    return asked.join(best, "qid", "left").withColumn("error", error).select("qid", *[shown(c) for c in ("quote", "section", "similarity", "score")], "error")


def calibrate(records: DataFrame, taus: DataFrame) -> DataFrame:
    """[E10, A10] the threshold sweep over the records that were not degraded, with the number ``excluded``. ``records``:
    expected, policy, legal, degraded (null counts as false)."""
    degraded = F.coalesce("degraded", F.lit(False))
    excluded = records.agg(F.count_if(degraded).alias("excluded"))
    return coverage.sweep(records.where(~degraded), taus).crossJoin(F.broadcast(excluded))


def inputs_considered(rows: DataFrame, classes: list[str] = GAP_CLASSES) -> DataFrame:
    """[A5] one row: rows of the gap classes over all time."""
    return rows.agg(F.count_if(F.col("classification").isin(classes)).alias("inputs_considered"))


def analysis_outcomes(clusters: DataFrame, proposals: DataFrame, drafts: DataFrame) -> DataFrame:
    """[G7] cluster_id and outcome of each candidate: skipped (it has a proposal that is not rejected), failed (no draft came,
    so nothing is recorded), amendment or coverage_notice. ``clusters``: cluster_id, is_candidate; ``proposals``: cluster_id,
    status; ``drafts``: cluster_id, kind."""
    held = proposals.where("status <> 'rejected'").select("cluster_id", F.lit(True).alias("open")).distinct()
    each = clusters.where("is_candidate").select("cluster_id").join(held, "cluster_id", "left").join(drafts.select("cluster_id", "kind"), "cluster_id", "left")
    return each.select("cluster_id", F.when(F.col("open"), "skipped").otherwise(F.coalesce("kind", F.lit("failed"))).alias("outcome"))


def analysis_counters(outcomes: DataFrame) -> DataFrame:
    """[G7] the run's four counters in one row."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return outcomes.agg(n("amendment").alias("proposals_created"), n("coverage_notice").alias("notices_created"), n("skipped").alias("skipped_existing"), n("failed").alias("generation_failures"))


def index_problem(model, dims, rows, wanted_model: str, wanted_dims: int) -> Column:
    """[S9] why an index cannot be asked; null where it can. An index that names no model or length is trusted."""
    return F.when(F.coalesce(rows, F.lit(0)) == 0, "empty").when(model != wanted_model, "other model").when(dims != wanted_dims, "other dimensions")


def upsert(cache: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """[K12] the cache with ``new`` rows in place of those of their keys; ``new`` has one row a key."""
    return cache.join(new.select(key), key, "left_anti").unionByName(new)


def exhausted_today(events: DataFrame, key: str, failed: Column) -> DataFrame:
    """[D3, ST7] adds ``exhausted``: whether the key has failed before on the same UTC day; a new day starts afresh.
    ``events``: ts, event_id and the key."""
    w = Window.partitionBy(key, F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("exhausted", F.coalesce(F.bool_or(F.coalesce(failed, F.lit(False))).over(w), F.lit(False)))
