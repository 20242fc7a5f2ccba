"""Text, vector and record functions on the literal cases of the survey."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import records, text, vector


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<double>' if isinstance(v, list) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(("quote", "source", "span"), [("beta gamma", "Alpha  beta\n gamma delta.", (7, 18)), ("HELLO there", "hello  there friend", (0, 12)), ("it's", "so it’s fine", (3, 7)), ("alpha delta", "alpha beta delta", None), ("", "x", None), ("a.b(c)", "see a.b(c) now", (4, 10)), ("x", "", None)])
def test_verbatim(spark, quote, source, span):
    got = one(spark, text.verbatim_span(F.col("q"), F.col("s")), q=quote, s=source)
    assert (None if got is None else tuple(got)) == span
    assert one(spark, text.is_verbatim(F.col("q"), F.col("s")), q=quote, s=source) == (span is not None)


def test_excerpt(spark):
    body = "This sentence is repeated for the test. " * 20
    got = one(spark, text.raw_excerpt(F.col("t")), t=f"[Title]\n\n{body}")
    assert len(got) <= 400 and got.endswith(".") and body.startswith(got)
    assert one(spark, text.raw_excerpt(F.col("t")), t="[Title]\n\n") is None
    assert one(spark, text.raw_excerpt(F.col("t")), t="word " * 200).endswith("word…")


def test_small_text_functions(spark):
    assert one(spark, text.tokenize(F.col("t")), t="Être A-1 b") == ["tre", "a", "1", "b"]
    assert one(spark, text.normalize(F.col("t")), t=" a \t b “c” — ") == 'a b "c" -'
    assert one(spark, text.slugify(F.col("t")), t="  No Example! ") == "no_example"
    assert one(spark, text.chapter_number(F.col("t")), t="Section 4.2.1: x") == "4.2.1"
    assert one(spark, text.strip_glyphs(F.col("t")), t="a(cid:12)  b") == "a b"
    assert one(spark, text.retry_delay(F.col("t")), t="quota; retry in 12.5s") == 13.5 and one(spark, text.retry_delay(F.col("t")), t="x") == 30.0
    assert one(spark, text.strip_fence(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, text.response_type(F.col("t"), ["policy_quote", "chat"], "chat"), t=" Policy-Quote ") == "policy_quote"
    assert one(spark, text.truncate_to_words(F.col("t"), 2), t="a  b c") == "a b" and one(spark, text.first_line(F.col("t")), t="\nx\ny") == "x"
    assert [one(spark, text.substantive(F.col("t")), t=t) for t in ("N/A", " unknown", "x", "yes", None)] == [False, False, False, True, False]
    assert one(spark, text.section_label(F.lit("T"), F.lit(3), F.lit("A")), t="") == "T — Page 3"
    assert one(spark, text.section_label(F.lit(""), F.lit(None).cast("int"), F.lit("A")), t="") == "A"


def test_vectors(spark):
    a, b = [3.0, 4.0], [6.0, 8.0]
    assert one(spark, vector.cosine(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(1.0)
    assert one(spark, vector.cosine(F.col("a"), F.col("b")), a=a, b=[0.0, 0.0]) == 0.0 and one(spark, vector.cosine(F.col("a"), F.col("b")), a=a, b=[1.0]) == 0.0
    assert one(spark, vector.unit(F.col("a")), a=a) == pytest.approx([0.6, 0.8]) and one(spark, vector.unit(F.col("a")), a=[0.0]) == [0.0]
    assert one(spark, vector.similarity_of_distance(F.lit(None).cast("double")), a=a) == 0.0


JSONS = [('{"a": 1}', {"a": 1}), ('{not json} but {"real": true}', {"real": True}), ('[1, 2]', None), ('x {"a": {"b": "}"}} tail {', {"a": {"b": "}"}}), ("", None), (None, None)]


@pytest.mark.parametrize(("raw", "want"), JSONS)
def test_first_object(spark, raw, want):
    got = one(spark, records.extract_json(F.col("t")), t=raw)
    assert (json.loads(got) if got else None) == want


FORM = {"when_occurred": "May 2024", "where_occurred": "Plant 7", "person_1_first": "Ann", "person_1_last": "Li", "person_2_first": " ", "management_aware": "Yes", "sequence_of_events": "x" * 60, "country": "plant 7", "has_supporting_materials": "yes", "evidence_description": "short"}


def merged(spark, strict, inferred, form=FORM):
    df = spark.createDataFrame([(strict, inferred, form)], "s string, i string, form map<string,string>")
    p = df.select(records.normalise_pass(records.extract_json("s"), False).alias("s"), records.normalise_pass(records.extract_json("i"), True).alias("i"), "form")
    e = p.select(records.merge_passes(F.col("s"), F.col("i"), F.lit(5)).alias("e"), "form")
    return e.select("e", records.augment(F.col("e"), F.col("form")).alias("a"), records.breakdown(F.col("e"), F.col("form")).alias("b")).first()


def test_passes_merge_and_augment(spark):
    r = merged(spark, '{"summary": "S", "people_mentioned": ["ann li", ""], "evidence_described": "false?"}', '{"timeline_clear": true, "witnesses_mentioned": false}')
    assert r.e.evidence_described and r.e.timeline_clear and not r.e._used_defaults and r.e.people_mentioned == ["ann li"]
    assert r.a.people_mentioned == ["ann li"] and r.a.locations_mentioned == ["Plant 7"] and r.a.specific_examples_present and r.a.prior_reporting_mentioned
    assert r.a.summary == "S Structured form context: When: May 2024; Where: Plant 7." and not r.a.witnesses_mentioned
    assert r.b.from_answers.evidence_described is False


def test_failed_passes_fall_back(spark):
    r = merged(spark, "nothing", "nothing")
    assert r.e._used_defaults and r.a.summary == "When: May 2024. Where: Plant 7."
    assert not merged(spark, "nothing", "{}").e._used_defaults


def test_persons_round_trip(spark):
    df = spark.createDataFrame([(FORM,)], "form map<string,string>")
    p = df.select(records.persons_of(F.col("form")).alias("p"))
    assert [tuple(x) for x in p.first().p] == [(1, "Ann", "Li", "")]
    back = p.select(records.form_of_persons(F.col("p")).alias("m")).first().m
    assert back["person_1_first"] == "Ann" and back["person_10_title"] == "" and len(back) == 30


def test_lists_and_maps(spark):
    arrays = spark.createDataFrame([(["Straße", " a "], ["A", "strasse", "", None, "B"])], "a array<string>, b array<string>")
    assert arrays.select(records.merge_unique(F.col("a"), F.col("b")).alias("x")).first().x in (["Straße", "a", "B"], ["Straße", "a", "strasse", "B"])
    m = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"})], "x map<string,string>, y map<string,string>")
    assert m.select(records.overlay(F.col("x"), F.col("y")).alias("z")).first().z == {"a": "1", "b": "3"}
    assert one(spark, records.whitelisted_fields(F.col("t"), ["a", "b"]), t='ok {"data": {"a": "x", "b": "", "c": "y"}} bye') == {"a": "x"}


def test_schema_text_has_no_prose(spark):
    e = spark.createDataFrame([(["fraud"], "sum", True, False, None)], "allegation_type array<string>, summary string, evidence_described boolean, retaliation_mentioned boolean, impact_described boolean")
    got = e.select(records.schema_text(F.struct("*"), F.lit("uncovered")).alias("x")).first().x
    assert got == "Allegation types: fraud. Summary: sum. Evidence described: yes. Retaliation mentioned: no. Impact described: no. Coverage: uncovered."
