"""The corpus pipeline: documents to packed token sequences by five of the operators in lodestone.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, langid, near_dedup, packing, secrets
from lodestone.plans.session import table
from lodestone.plans.shared import materialise

KEY, PLACE = "_lodestone_row_key", "_lodestone_place"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network recognises; texts without a letter and uncertain ones go."""
    return langid.keep_identified(docs, langid.train(docs))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts the document with the largest id stays, once even where its row repeats; of rows that share id and
    text but not the other columns, the first by those columns."""
    groups = exact_dedup.exact_groups(docs)
    key = lambda sha: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), sha)
    dropped = groups.where("not kept").select(key(F.col("text_sha256")).alias(KEY))
    keyed = docs.withColumn(KEY, key(F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)))
    others = F.to_json(F.struct(F.lit(1).alias("_"), *[c for c in docs.columns if c not in ("doc_id", "text")]))
    place = F.row_number().over(Window.partitionBy(KEY).orderBy(others))
    return keyed.join(dropped, KEY, "left_anti").withColumn(PLACE, place).where(F.col(PLACE) == 1).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; rows are known by their id and text."""
    key = lambda text: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text)
    dropped = near_dedup.near_groups(docs).where("not kept").select(key(F.col("text_key")).alias(KEY)).distinct()
    keyed = docs.withColumn(KEY, key(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))))
    return keyed.join(dropped, KEY, "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of at most 1024 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), lean=True)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup_stage), ("near_dedup", near_dedup_stage), ("secret_scan", secret_scan), ("packing", pack)]
#: A trained network and signatures decide, which SQL cannot express; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each over what its predecessor wrote."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
