"""Standing metrics and windowed inputs [F1, A1-A6, A14-A18, D1-D3, ST5]."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.coverage import CLASSES

GAP_CLASSES = ["legal_only", "uncovered"]
STATUSES = ["pending", "accepted", "modified", "rejected"]


def parse_ts(c):
    """[D1] an ISO-8601 string as a timestamp, naive ones in UTC; null where unreadable."""
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))


def in_window(ts, as_of, days: int):
    """[D2] at or after ``as_of`` less ``days``; no upper bound; null is outside."""
    if not 1 <= days <= 3650:
        raise ValueError("a window has 1 to 3650 days")
    return F.coalesce(ts >= as_of - F.make_dt_interval(F.lit(days)), F.lit(False))


def gap_inputs(rows: DataFrame, as_of, days: int = 90, classes: list[str] = GAP_CLASSES) -> DataFrame:
    """rows of the gap classes inside the window. ``rows``: classification, ts."""
    return rows.where(F.col("classification").isin(classes) & in_window(F.col("ts"), as_of, days))


def class_counts(rows: DataFrame, classes: list[str] = CLASSES) -> list:
    known = [F.count_if(F.col("classification") == c).alias(c) for c in classes]
    return [*known, F.count_if(~F.coalesce(F.col("classification").isin(classes), F.lit(False))).alias("unclassified")]


def coverage_metrics(rows: DataFrame, as_of, days: int = 90, classes: list[str] = CLASSES, rate_of: str = "legal_only") -> DataFrame:
    """[A1, A2] one row: a count for every class and the rest, the classified total, and a class's rate (null without any)."""
    counted = rows.where(in_window(F.col("ts"), as_of, days)).agg(*class_counts(rows, classes))
    total = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    return counted.withColumn("total_classified", total).withColumn(f"{rate_of}_rate", F.round(F.try_divide(F.col(rate_of), F.col("total_classified")), 4))


def proposal_metrics(proposals: DataFrame) -> DataFrame:
    """[A3, A4] one row: counts by kind, rate of notices, and decisions with every known status. ``proposals``: kind, status."""
    a, n = F.count_if(F.col("kind") == "amendment"), F.count_if(F.col("kind") == "coverage_notice")
    return proposals.agg(a.alias("amendments"), n.alias("coverage_notices"), F.round(F.try_divide(n, a + n), 4).alias("unanchored_rejection_rate"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def decision_histogram(proposals: DataFrame) -> DataFrame:
    """[A4] status and n, known ones at 0 too, and any other that occurs."""
    seeds = proposals.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counts = proposals.groupBy("status").agg(F.count("*").alias("n"))
    return seeds.join(counts, "status", "full_outer").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def daily(rows: DataFrame, classes: list[str], rate_of: str) -> DataFrame:
    """[ST5] day, counts and rate."""
    counted = rows.groupBy(F.to_date("ts").alias("day")).agg(*class_counts(rows, classes))
    total = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    return counted.withColumn("rate", F.round(F.try_divide(F.col(rate_of), total), 4))


def next_id(rows: DataFrame, column: str = "id") -> DataFrame:
    """[A14]"""
    return rows.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next_id"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """[A15] ``chunks``: section_title, words."""
    return chunks.agg(F.count("*").alias("n_chunks"), F.count_distinct("section_title").alias("n_sections"), F.min("words").alias("min_words"), F.max("words").alias("max_words"), F.expr("sum(words) div count(*)").alias("avg_words"))


def overall_status(steps: DataFrame) -> DataFrame:
    """[A16, A17] run_id and overall: fail with any failure or violation, else partial with any skip, else pass. ``steps``: run_id, status, violations."""
    failed = F.bool_or((F.col("status") == "fail") | (F.size("violations") > 0))
    return steps.groupBy("run_id").agg(F.when(failed, "fail").when(F.bool_or(F.col("status") == "skip"), "partial").otherwise("pass").alias("overall"))


def narrative_length(*columns):
    """[A18]"""
    return sum((F.length(F.trim(F.coalesce(c, F.lit("")))) for c in columns[1:]), F.length(F.trim(F.coalesce(columns[0], F.lit("")))))
