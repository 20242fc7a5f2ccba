"""Re-ranking, quotes and pinned excerpts [R4-R6, R9, J2, J3, J11, T3, T8]. Scorers and extractors are columns or functions of the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import ELLIPSIS, is_verbatim, raw_excerpt, strip_fence, strip_section_prefix, verbatim_span

ANSWER = "struct<scores:array<struct<index:int,score:double>>,best_quote:struct<index:int,text:string>,interpretation:string>"


def parse_answer(raw) -> F.Column:
    """[N4] scores, best_quote and interpretation of a scorer's answer: an object, a bare array of scores, a quote as a string, fenced or not. Null where unreadable."""
    text = strip_fence(raw)
    array = F.from_json(F.when(text.startswith("["), text), "array<struct<index:int,score:double>>")
    scores = F.coalesce(array, F.from_json(F.get_json_object(text, "$.scores"), "array<struct<index:int,score:double>>"))
    quote = F.get_json_object(text, "$.best_quote")
    index = F.when(quote.startswith("{"), F.get_json_object(quote, "$.index").cast("int"))
    words = F.when(quote.startswith("{"), F.get_json_object(quote, "$.text")).otherwise(quote)
    return F.when(scores.isNotNull(), F.struct(scores.alias("scores"), F.when(words.isNotNull(), F.struct(index.alias("index"), words.alias("text"))).alias("best_quote"), F.get_json_object(text, "$.interpretation").alias("interpretation")))


def rerank(candidates: DataFrame, answers: DataFrame, least: float = 3.0) -> DataFrame:
    """[R4] ``candidates``: qid, idx, text, similarity; ``answers``: qid, raw. Adds score, status (ok, no_match, unavailable) and the order.

    A candidate without a score counts 0, scores of unknown indexes are ignored, candidates below ``least`` go. A quote
    belongs to the candidate it names, or else to the only one that holds it word for word.
    """
    parsed = answers.select("qid", parse_answer(F.col("raw")).alias("a"))
    scores = parsed.select("qid", F.explode("a.scores").alias("s")).groupBy("qid", F.col("s.index").alias("idx")).agg(F.max("s.score").alias("score"))
    scored = candidates.join(parsed, "qid", "left").join(scores, ["qid", "idx"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    kept = scored.where(F.col("a").isNotNull() & (F.col("score") >= least))
    owners = F.count(F.when(is_verbatim(F.col("a.best_quote.text"), F.col("text")), 1)).over(Window.partitionBy("qid"))
    owns = F.when(F.col("a.best_quote.index").isNotNull(), F.col("a.best_quote.index") == F.col("idx")).otherwise(is_verbatim(F.col("a.best_quote.text"), F.col("text")) & (owners == 1))
    hits = kept.withColumn("quote", F.when(owns, F.col("a.best_quote.text"))).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "idx")) - 1)
    hits = hits.select("qid", "idx", "text", "similarity", "score", "rank", "quote", F.lit("ok").alias("status"))
    missed = parsed.join(hits.select("qid").distinct(), "qid", "left_anti").select("qid", F.when(F.col("a").isNull(), "unavailable").otherwise("no_match").alias("status"))
    return hits.unionByName(missed, allowMissingColumns=True)


def select_quote(text, inline, extracted):
    """[R5] the inline quote, else the extracted one, if word for word in the text; else a raw excerpt; null for an empty body."""
    body = strip_section_prefix(text)
    return F.coalesce(F.when(is_verbatim(inline, body), inline), F.when(is_verbatim(extracted, body), extracted), raw_excerpt(text))


def quote_span(quote, text, chunk_start):
    """[X7] place of a quote in the canonical document; null for chunks without a pinned place."""
    rel = verbatim_span(F.rtrim(quote, F.lit(ELLIPSIS)), strip_section_prefix(text))
    return F.when((chunk_start >= 0) & rel.isNotNull(), F.struct((chunk_start + rel["start"]).alias("start"), (chunk_start + rel["end"]).alias("end")))


def first_usable(hits: DataFrame, key: str = "qid") -> DataFrame:
    """[T8] of each key the row of lowest rank that has a quote."""
    row = F.struct(*[c for c in hits.columns if c != key])
    return hits.where("quote is not null").groupBy(key).agg(F.min_by(row, "rank").alias("_row")).select(key, "_row.*")


def validate_pins(excerpts: DataFrame, canonical: DataFrame) -> DataFrame:
    """[R6, J11] drops excerpts whose quote and canonical slice do not hold each other; without canonical text or a span they pass.
    ``excerpts``: corpus, document_id, quote, span; ``canonical``: corpus, document_id, canonical_text."""
    joined = excerpts.join(canonical, ["corpus", "document_id"], "left")
    piece = F.substring("canonical_text", F.col("span.start") + 1, F.col("span.end") - F.col("span.start"))
    fine = F.col("canonical_text").isNull() | F.col("span").isNull() | is_verbatim(F.col("quote"), piece) | is_verbatim(piece, F.col("quote"))
    return joined.where(fine).drop("canonical_text")
