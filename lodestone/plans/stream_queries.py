"""Registered queries that run a stream over a table's files to their end, with the SQL of the batch; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.catalog import EVENT_CLASSES, query
from lodestone.plans.shared import is_folder
from lodestone.streaming import live


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The files of a table that is a folder, or a file beside other tables."""
    path = f"{sf}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _events(spark, sf):
    return _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT event_id, EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND CAST(b.ts AS DATE) = CAST(a.ts AS DATE) AND b.event_type = 'error' AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id))) AS exhausted FROM events a""")
def exhausted_stream(spark, sf):
    e = _events(spark, sf).select(F.col("user_id").cast("bigint").alias("key"), "event_id", "ts", (F.col("event_type") == "error").alias("failed"))
    return live.finished(live.exhaustion_state(e), "exhausted", "append").select("event_id", "exhausted")


@query("""WITH s AS (SELECT CAST(unnest(generate_series(min(CAST(ts AS DATE)) - 6, max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS DATE) AS start FROM events)
SELECT start, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type NOT IN ('error', 'purchase')) AS unclassified
FROM s JOIN events ON ts >= start AND ts < start + INTERVAL 7 DAYS GROUP BY 1""")
def sliding_stream(spark, sf):
    e = _events(spark, sf).select("ts", F.col("event_type").alias("classification"))
    found = live.finished(live.sliding_counts(e, EVENT_CLASSES, "7 days"), "sliding")
    return live.latest(found, "start").withColumn("start", F.to_date("start"))


@query("""WITH m AS (SELECT conv_id, turn, role, role || '_chars' AS field, length(text) AS size, role = 'assistant' AS needs, coalesce(sum(CASE WHEN length(text) % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS changes, length(text) % 3 = 0 AS changed FROM conversations),
b AS (SELECT *, max(CASE WHEN needs THEN changes END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM m),
f AS (SELECT conv_id, field || '=' || arg_max(size, turn) AS said FROM m WHERE changed GROUP BY conv_id, field),
r AS (SELECT conv_id, string_agg(said, ',' ORDER BY said) AS report FROM f GROUP BY 1)
SELECT b.conv_id, count(*) AS n_messages, coalesce(any_value(report), '') AS report, count(*) FILTER (WHERE needs AND (known IS NULL OR changes > known)) AS built FROM b LEFT JOIN r ON r.conv_id = b.conv_id GROUP BY 1""")
def session_stream(spark, sf):
    size = F.length("text").cast("string")
    m = _stream(spark, sf, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text", F.when(F.length("text") % 3 == 0, F.create_map(F.concat("role", F.lit("_chars")), size)).alias("updates"))
    return live.latest(live.finished(live.session_reports(m), "sessions"), "conv_id").select("conv_id", "n_messages", "report", "built")
