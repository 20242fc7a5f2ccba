"""Forms, runs and day-scoped state on small fixtures."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.functions import forms
from lodestone.operators import analysis
from lodestone.sources import store
from lodestone.streaming import live


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def form_of(**values):
    keys = {k for _, k in [*forms.BLOCKS, *forms.LINES, *forms.TOLD]} | {"full_details_q1", "full_details_q2", "how_aware_other"} | {f"person_{i}_{k}" for i in range(1, 11) for k in ("first", "last", "title")}
    return F.create_map(*[F.lit(x) if x is not None else F.lit(None).cast("string") for k in sorted(keys) for x in (k, values.get(k))])


def test_labelled_sections_in_order(spark):
    form = form_of(general_nature=" c ", sequence_of_events="s", how_aware="h", how_aware_other="o", country="X", person_2_first="Ann", person_2_last="Li", person_2_title="Dr", person_3_title="Clerk", persons_concealing=" ")
    want = "[NARRATIVE]\nn\n\n[CHRONOLOGY]\nc\n\n[SEQUENCE]\ns\n\n[HOW_AWARE]\nh\no\n\n[STRUCTURED]\n- Country: X\n- Person 2: Ann Li, Dr\n- Person 3: Clerk"
    assert one(spark, forms.labelled_sections(F.lit(" n "), form)) == want
    assert one(spark, forms.labelled_sections(F.lit(None).cast("string"), form_of())) == ""


def test_analysis_and_query_text(spark):
    assert one(spark, forms.analysis_text(form_of())) == "No incident details provided."
    assert one(spark, forms.analysis_text(form_of(full_details_q1=" q ", general_nature="g"))) == "q"
    assert one(spark, analysis.query_text(form_of(general_nature="g", where_occurred=" w "), F.lit(" "))) == "g w"
    assert one(spark, analysis.query_text(form_of(), F.lit(None).cast("string"))) is None
    assert one(spark, analysis.query_text(form_of(general_nature="g"), F.lit(" said "))) == "said"


def test_stored_and_one_shot_extractions(spark):
    got = one(spark, forms.stored_extraction(F.lit('{"summary": "S", "people_mentioned": ["A"], "impact_described": 0, "length_character_count": 7}')))
    assert (got.summary, got.people_mentioned, got.dates_mentioned, got.impact_described, got.witnesses_mentioned, got.length_character_count) == ("S", ["A"], [], False, None, 7)
    assert one(spark, forms.stored_extraction(F.lit("[1]"))) is None and one(spark, forms.stored_extraction(F.lit(None).cast("string"))) is None
    got = one(spark, forms.public_slice(forms.one_shot(F.lit("none"), F.lit("abcd"))))
    assert got.used_defaults and got.length_character_count == 4 and got.summary == ""


def test_options_and_persons(spark):
    options = spark.createDataFrame([(1, "a", "Alpha"), (2, "b", "a"), (3, "c", "Beta")], "pos int, value string, label string")
    assert [r.value for r in forms.matching_options(options, F.lit("BET")).collect()] == ["c"] and forms.matching_options(options, F.lit(" ")).count() == 3
    values = spark.createDataFrame([("a",), ("Beta",), ("z",)], "value string")
    assert {r.value: r.option and r.option.value for r in forms.option_of(options, values).collect()} == {"a": "a", "Beta": "c", "z": None}
    assert one(spark, forms.without_secrets(F.create_map(F.lit("k"), F.lit("v"), F.lit("key"), F.lit("s")), ["key"], {"d": "x", "k": "no"})) == {"k": "v", "d": "x"}
    assert one(spark, forms.reporter(F.lit("yes"), F.lit("A"), F.lit(None).cast("string"))) == "Anonymous" and one(spark, forms.reporter(F.lit(None).cast("string"), F.lit(" "), F.lit(None).cast("string"))) == "Blank Name"


def test_policy_quotes_fall_through(spark):
    asked = spark.createDataFrame([(1, "q"), (2, " "), (3, "q"), (4, "q"), (5, "q")], "qid int, query string")
    text = "[Title]\nThe clause says that gifts are banned."
    c = spark.createDataFrame([(q, i, text if i else "[T]\n\n", f"s{i}", 0.5) for q in (1, 3, 4, 5) for i in (0, 1)], "qid int, idx int, text string, section string, similarity double")
    answers = spark.createDataFrame([(1, '{"scores": [{"index": 0, "score": 9}, {"index": 1, "score": 8}]}'), (3, None), (4, '{"scores": [{"index": 1, "score": 1}]}'), (5, '{"scores": [{"index": 1, "score": 8}], "best_quote": {"index": 1, "text": "gifts are allowed"}}')], "qid int, raw string")
    extracted = spark.createDataFrame([(1, 1, "gifts are banned")], "qid int, idx int, extracted string")
    got = {r.qid: (r.quote, r.section, r.error) for r in analysis.policy_quotes(asked, c, answers, extracted).collect()}
    assert got[1] == ("gifts are banned", "s1", None) and got[2] == (None, None, "no_query_text")
    assert got[3] == got[4] == (None, None, "policy_unavailable") and got[5][0].startswith("The clause") and got[5][2] is None


def test_store_that_may_be_lost(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), "id bigint, v string")
    assert s.read_or_empty()[0].count() == 0 and s.read_or_empty()[1] == 1
    s.create(spark.createDataFrame([("a",), ("b",)], "v string"), ["v"])
    assert s.read_or_empty()[0].count() == 2 and s.read_or_empty()[1] == 3
    for p in (tmp_path / "s").glob("pointer-*"):
        p.write_text("{broken")
    for p in (tmp_path / "s").glob(".pointer-*.crc"):
        p.unlink()
    assert s.read_or_empty()[0].count() == 0 and s.read_or_empty()[1] == 1
    with pytest.raises(Exception):
        s.read().count()


def test_exhaustion_in_a_stream_equals_the_batch_form(spark, tmp_path):
    start = datetime(2024, 1, 1, 20)
    rows = [(i, f"k{i % 3}", start + timedelta(hours=i // 2), i % 7 == 0) for i in range(40)]
    schema = "event_id bigint, key string, ts timestamp, failed boolean"
    for i in range(4):
        spark.createDataFrame(rows[10 * i : 10 * i + 10], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = live.exhaustion_state(stream).writeStream.format("memory").queryName("exhaustion").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    want = analysis.exhausted_today(spark.createDataFrame(rows, schema), "key", F.col("failed"))
    assert {(r.event_id, r.exhausted) for r in spark.table("exhaustion").collect()} == {(r.event_id, r.exhausted) for r in want.collect()}


def test_embedding_batches_try_again(spark):
    def embed(texts):
        assert len(texts) <= 25
        embed.calls = getattr(embed, "calls", 0) + 1
        if embed.calls == 1:
            raise OSError("busy")
        return [[float(len(t))] for t in texts]

    got = live.embedded(spark.range(60).select(F.col("id").cast("string").alias("text")).coalesce(1), embed).collect()
    assert len(got) == 60 and all(r.vec == [float(len(r.text))] for r in got)
