"""Record functions: lists, JSON from model answers, merges of extraction passes and forms."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import capped, has_value, substantive, trimmed

# The extraction's fields by pass and type.
LISTS = ["dates_mentioned", "people_mentioned", "locations_mentioned", "allegation_type"]
STRICT_FLAGS = ["evidence_described"]
INFERRED_FLAGS = ["specific_examples_present", "witnesses_mentioned", "impact_described", "retaliation_mentioned", "prior_reporting_mentioned", "timeline_clear"]
PLACES = ["where_occurred", "incident_location", "country"]
LONG_SEQUENCE, LONG_EVIDENCE, LONG_SUMMARY = 60, 20, 1200


def merge_unique(a, b) -> Column:
    """[C3] a then b, trimmed, without blanks; of spellings that differ in case only, the first. Case folds by lower after upper."""
    items = F.filter(F.transform(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))), trimmed), lambda x: x != "")
    key = lambda x: F.lower(F.upper(x))
    return F.aggregate(items, F.array().cast("array<string>"), lambda kept, x: F.when(F.exists(kept, lambda k: key(k) == key(x)), kept).otherwise(F.concat(kept, F.array(x))))


def people(form) -> Column:
    """[C4] full names of the form's ten persons."""
    names = [F.trim(F.concat(trimmed(form[f"person_{i}_first"]), F.lit(" "), trimmed(form[f"person_{i}_last"]))) for i in range(1, 11)]
    return F.filter(F.array(*names), lambda x: x != "")


def locations(form) -> Column:
    return F.filter(F.array(*[trimmed(form[k]) for k in PLACES]), lambda x: x != "")


def persons_of(form) -> Column:
    """[P6] array of idx, first, last, title of the persons with any value."""
    rows = [F.struct(F.lit(i).alias("idx"), *[trimmed(form[f"person_{i}_{k}"]).alias(k) for k in ("first", "last", "title")]) for i in range(1, 11)]
    return F.filter(F.array(*rows), lambda p: (p["first"] != "") | (p["last"] != "") | (p["title"] != ""))


def form_of_persons(persons) -> Column:
    """[P6] the inverse: a map of the thirty columns; blank beyond the list."""
    pairs = []
    for i in range(1, 11):
        p = F.try_element_at(persons, F.lit(i))
        for k in ("first", "last", "title"):
            pairs += [F.lit(f"person_{i}_{k}"), F.coalesce(p[k], F.lit(""))]
    return F.create_map(*pairs)


def histogram(df: DataFrame, group: list[str], value: str, name: str = "counts") -> DataFrame:
    """[C5, A6] a map of value to count for each group."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias(name))


def overlay(base, new) -> Column:
    """[C6] keys of ``new`` win."""
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def first_object(text: str | None) -> str | None:
    """The first complete JSON object in a text, whatever surrounds it."""
    decoder, at = json.JSONDecoder(), (text or "").find("{")
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
            if isinstance(found, dict):
                return json.dumps(found, ensure_ascii=False)
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return None


@F.pandas_udf(T.StringType())
def extract_json(raw: pd.Series) -> pd.Series:
    """[N1] no built-in function skips the prose around an object, so this is an Arrow-batched function."""
    return raw.map(first_object, na_action="ignore")


def _truthy(v) -> Column:
    return F.coalesce(~v.isin("", "false", "0", "0.0", "null", "[]", "{}"), F.lit(False))


def normalise_pass(json_text, inferred: bool) -> Column:
    """[N3] a struct with a typed default for every key; ``ok`` is false where there was no object."""
    get = lambda k: F.get_json_object(json_text, f"$.{k}")
    strings = lambda k: F.filter(F.coalesce(F.from_json(get(k), "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull() & _truthy(x))
    flags = INFERRED_FLAGS if inferred else STRICT_FLAGS
    fields = [_truthy(get(k)).alias(k) for k in flags]
    if not inferred:
        fields += [trimmed(get("summary")).alias("summary"), *[strings(k).alias(k) for k in LISTS]]
    return F.struct(json_text.isNotNull().alias("ok"), *fields)


def merge_passes(strict, inferred, length) -> Column:
    """[E5] each field from the pass that owns it; defaults are marked only where both passes failed."""
    return F.struct(
        strict["summary"].alias("summary"), *[strict[k].alias(k) for k in [*LISTS, *STRICT_FLAGS]], *[inferred[k].alias(k) for k in INFERRED_FLAGS],
        length.alias("length_character_count"), (~strict["ok"] & ~inferred["ok"]).alias("_used_defaults"),
    )


def _when(form) -> Column:
    return trimmed(form["when_occurred"])


def _where(form) -> Column:
    return F.when(has_value(form["where_occurred"]), trimmed(form["where_occurred"])).otherwise(trimmed(form["incident_location"]))


def algorithmic(form) -> Column:
    """[P10] what the form alone tells."""
    seq = F.length(trimmed(form["sequence_of_events"])) >= LONG_SEQUENCE
    when = _when(form)
    return F.struct(
        F.when(substantive(when), F.array(when)).otherwise(F.array().cast("array<string>")).alias("dates_mentioned"), people(form).alias("people_mentioned"), locations(form).alias("locations_mentioned"),
        seq.alias("specific_examples_present"), ((F.lower(trimmed(form["has_supporting_materials"])) == "yes") & (F.length(trimmed(form["evidence_description"])) >= LONG_EVIDENCE)).alias("evidence_described"),
        (substantive(when) | substantive(form["duration"]) | seq).alias("timeline_clear"), (F.lower(trimmed(form["management_aware"])) == "yes").alias("prior_reporting_mentioned"),
    )


def fallback_summary(form) -> Column:
    """[X11] nature, when, where and how of the form as one paragraph."""
    nature, how, other = trimmed(form["general_nature"]), trimmed(form["how_aware"]), trimmed(form["how_aware_other"])
    aware = F.when(other != "", F.trim(F.concat(how, F.lit(" "), other))).otherwise(how)
    parts = F.array(
        F.when(substantive(nature), nature), F.when(substantive(_when(form)), F.concat(F.lit("When: "), _when(form), F.lit("."))), F.when(substantive(_where(form)), F.concat(F.lit("Where: "), _where(form), F.lit("."))),
        F.when((substantive(how) | substantive(other)) & substantive(aware), F.concat(F.lit("How the reporter became aware: "), aware, F.lit("."))),
    )
    return capped(F.array_join(F.array_compact(parts), " "), LONG_SUMMARY)


def with_context(summary, form) -> Column:
    """[X12] when and where appended to a summary that does not mention them."""
    low = F.lower(summary)
    missing = lambda name, v: F.when(substantive(v) & ~low.contains(F.lower(v)), F.concat(F.lit(f"{name}: "), v))
    bits = F.array_compact(F.array(missing("When", _when(form)), missing("Where", _where(form))))
    added = F.trim(F.concat(F.rtrim(summary), F.lit(" Structured form context: "), F.array_join(bits, "; "), F.lit(".")))
    return F.when(F.size(bits) == 0, summary).otherwise(capped(added, LONG_SUMMARY))


def augment(extraction, form) -> Column:
    """[E6] the extraction with what the form adds. Witnesses, impact and retaliation are never inferred from a form."""
    facts = algorithmic(form)
    raw = trimmed(extraction["summary"])
    fallback = fallback_summary(form)
    summary = F.when(extraction["_used_defaults"] | (raw == ""), F.when(fallback != "", fallback).otherwise(raw)).otherwise(with_context(raw, form))
    either = ["specific_examples_present", "evidence_described", "timeline_clear", "prior_reporting_mentioned"]
    return F.struct(
        summary.alias("summary"), *[merge_unique(extraction[k], facts[k]).alias(k) for k in LISTS[:3]], *[(extraction[k] | facts[k]).alias(k) for k in either],
        *[extraction[k].alias(k) for k in ("witnesses_mentioned", "impact_described", "retaliation_mentioned", "allegation_type", "length_character_count", "_used_defaults")],
    )


def breakdown(extraction, form) -> Column:
    """[P11]"""
    return F.struct(algorithmic(form).alias("from_answers"), extraction.alias("from_model"))


def schema_text(extraction, classification) -> Column:
    """[P2] a sentence from extracted fields only, never from prose."""
    yes = lambda k: F.when(extraction[k], "yes").otherwise("no")
    types = F.coalesce(F.nullif(F.array_join(extraction["allegation_type"], ", "), F.lit("")), F.lit("unspecified"))
    parts = [F.concat(F.lit("Allegation types: "), types, F.lit(".")), F.concat(F.lit("Summary: "), F.coalesce(F.nullif(extraction["summary"], F.lit("")), F.lit("none")), F.lit("."))]
    parts += [F.concat(F.lit(f"{name}: "), yes(k), F.lit(".")) for name, k in (("Evidence described", "evidence_described"), ("Retaliation mentioned", "retaliation_mentioned"), ("Impact described", "impact_described"))]
    return F.concat_ws(" ", *parts, F.when(has_value(classification), F.concat(F.lit("Coverage: "), classification, F.lit("."))))


def whitelisted_fields(text, known: list[str]) -> Column:
    """[N2] the first flat or once nested object of a reply, unwrapped from ``data``, with known non-empty keys as strings."""
    obj = F.regexp_extract(text, r"(\{(?:[^{}]|\{[^{}]*\})*\})", 1)
    inner = F.coalesce(F.get_json_object(obj, "$.data"), obj)
    return F.map_filter(F.from_json(inner, "map<string,string>"), lambda k, v: k.isin(known) & F.coalesce(~v.isin("", "null", "false", "0"), F.lit(False)))


def follow_ups(items) -> Column:
    """[N6] entries with an id or a question."""
    t = F.transform(items, lambda x: F.struct(trimmed(x["gap_id"]).alias("gap_id"), trimmed(x["question_text"]).alias("question_text")))
    return F.filter(t, lambda x: (x["gap_id"] != "") | (x["question_text"] != ""))
