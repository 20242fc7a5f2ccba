"""Report forms as columns: labelled blocks, field catalogues, display values and stored extractions [P7-P9, P12, P15, P17, P19-P21, F7, F12, N5, T10, D5]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.records import INFERRED_FLAGS, LISTS, STRICT_FLAGS, extract_json, merge_passes, normalise_pass
from lodestone.functions.text import has_value, joined_nonblank, trimmed

# The labelled blocks with their form keys, in order; the structured lines; the display texts.
BLOCKS = [("CHRONOLOGY", "general_nature"), ("SEQUENCE", "sequence_of_events"), ("EVIDENCE_DESCRIPTION", "evidence_description"), ("FOLLOW_UP_1", "full_details_q2"), ("FOLLOW_UP_2", "full_details_gap2"), ("CONCEALMENT", "persons_concealing")]
LINES = [("When", "when_occurred"), ("Where", "where_occurred"), ("Duration", "duration"), ("Country", "country"), ("Incident location", "incident_location"), ("Organization tier", "organization_tier"), ("Supervisor involved", "supervisor_involved"), ("Supervisor who", "supervisor_who"), ("Management aware", "management_aware"), ("Supporting materials", "has_supporting_materials"), ("Wish anonymous", "wish_anonymous")]
TOLD = [("Chronological incident account", "general_nature"), ("Location", "where_occurred"), ("When", "when_occurred"), ("How became aware", "how_aware")]
NOT_PROVIDED, NO_DETAILS, NONE, NAMELESS = "Not provided", "No incident details provided.", "None", "Blank Name"


def _block(title: str, body: Column) -> Column:
    return F.when(body != "", F.concat(F.lit(f"[{title}]\n"), body))


def _person(form, i: int) -> Column:
    first, last, title = (trimmed(form[f"person_{i}_{k}"]) for k in ("first", "last", "title"))
    name = F.trim(F.concat(first, F.lit(" "), last))
    line = F.concat(F.lit(f"- Person {i}:"), F.when(name != "", F.concat(F.lit(" "), name)).otherwise(""), F.when(title == "", "").when(name != "", F.concat(F.lit(", "), title)).otherwise(F.concat(F.lit(" "), title)))
    return F.when((name != "") | (title != ""), line)


def labelled_sections(narrative, form) -> Column:
    """[P17] the narrative and the form as nine labelled blocks in their order; blank ones are left out."""
    aware = joined_nonblank([form["how_aware"], form["how_aware_other"]], "\n")
    lines = [F.when(trimmed(form[k]) != "", F.concat(F.lit(f"- {name}: "), trimmed(form[k]))) for name, k in LINES]
    structured = F.concat_ws("\n", *lines, *[_person(form, i) for i in range(1, 11)])
    return F.concat_ws("\n\n", _block("NARRATIVE", trimmed(narrative)), *[_block(t, trimmed(form[k])) for t, k in BLOCKS], _block("HOW_AWARE", aware), _block("STRUCTURED", structured))


def analysis_text(form) -> Column:
    """[P19] the narrative, else the labelled parts that are given, else a fixed text."""
    parts = F.concat_ws(". ", *[F.when(F.coalesce(form[k], F.lit("")) != "", F.concat(F.lit(f"{name}: "), form[k])) for name, k in TOLD])
    return F.when(has_value(form["full_details_q1"]), trimmed(form["full_details_q1"])).when(parts != "", parts).otherwise(NO_DETAILS)


def displayed_fields(reports: DataFrame, catalogue: DataFrame, labels: DataFrame) -> DataFrame:
    """[P7] rid, pos, key, label, display of the fields to show. ``reports``: rid, form (map); ``catalogue``: pos, key, label,
    hide_key, hide_value (null where always shown); ``labels``: key, value, label of enumerated values. Both are settings of
    a few rows. A value without a label shows itself, an empty one a placeholder."""
    each = reports.crossJoin(F.broadcast(catalogue)).where(F.coalesce(F.col("form")[F.col("hide_key")] != F.col("hide_value"), F.lit(True)))
    each = each.withColumn("value", trimmed(F.col("form")[F.col("key")]))
    named = each.join(F.broadcast(labels.withColumnRenamed("label", "said")), ["key", "value"], "left")
    shown = F.when(F.col("value") == "", NOT_PROVIDED).otherwise(F.coalesce("said", "value"))
    return named.select("rid", "pos", "key", "label", shown.alias("display"))


def filled_and_unfilled(reports: DataFrame, catalogue: DataFrame) -> DataFrame:
    """rid, filled and unfilled: keys of the catalogue in its order, by whether the form has a value."""
    each = reports.crossJoin(F.broadcast(catalogue.select("pos", "key"))).withColumn("has", has_value(F.col("form")[F.col("key")]))
    keys = lambda has: F.transform(F.array_sort(F.collect_list(F.when(F.col("has") == has, F.struct("pos", "key")))), lambda x: x["key"])
    return each.groupBy("rid").agg(keys(True).alias("filled"), keys(False).alias("unfilled"))


def matching_options(options: DataFrame, typed) -> DataFrame:
    """options (value, label) whose label holds what was typed, whatever the case; blank matches all."""
    return options.where(F.lower("label").contains(F.lower(F.trim(typed))))


def option_of(options: DataFrame, values: DataFrame) -> DataFrame:
    """each ``value`` with the first option (pos) that has it as value or as label; null without one."""
    named = options.select("pos", F.struct("value", "label").alias("option"), F.explode(F.array_distinct(F.array("value", "label"))).alias("_as"))
    first = named.groupBy("_as").agg(F.min_by("option", "pos").alias("option"))
    return values.join(first.withColumnRenamed("_as", "value"), "value", "left")


def reporter(anonymous, first, last) -> Column:
    """[P8] anonymity before a name before a mark for neither."""
    name = F.trim(F.concat(trimmed(first), F.lit(" "), trimmed(last)))
    return F.when(anonymous == "yes", "Anonymous").when(name != "", name).otherwise(NAMELESS)


def utc_minute(ts) -> Column:
    """[P8, D5]"""
    return F.date_format(ts, "yyyy-MM-dd HH:mm 'UTC'")


def report_file_name(rid, ts, prefix: str = "report") -> Column:
    """[P15] ``prefix`` names the kind of report."""
    return F.format_string(f"{prefix.replace('%', '%%')}-id%d-%s.pdf", rid, F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'"))


def without_secrets(settings, hidden: list[str], defaults: dict[str, str]) -> Column:
    """[P12] a map of settings less the hidden keys, with defaults for absent ones."""
    shown = F.map_filter(settings, lambda k, v: ~k.isin(hidden))
    more = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    return F.map_concat(F.map_filter(more, lambda k, v: ~F.map_contains_key(shown, k)), shown)


def public_slice(extraction) -> Column:
    """[P9] the extraction with every null made its default and the marker of defaults under its public name."""
    strings = lambda k: F.coalesce(extraction[k], F.array().cast("array<string>")).alias(k)
    flag = lambda k, name=None: F.coalesce(extraction[k], F.lit(False)).alias(name or k)
    return F.struct(trimmed(extraction["summary"]).alias("summary"), *[strings(k) for k in LISTS], *[flag(k) for k in [*STRICT_FLAGS, *INFERRED_FLAGS]], F.coalesce(extraction["length_character_count"], F.lit(0)).alias("length_character_count"), flag("_used_defaults", "used_defaults"))


def stored_extraction(stored) -> Column:
    """[P20] stored JSON with a typed value for every key; optional flags stay null where absent. Null where it is no object."""
    get = lambda k: F.get_json_object(stored, f"$.{k}")
    strings = lambda k: F.coalesce(F.from_json(get(k), "array<string>"), F.array().cast("array<string>")).alias(k)
    truthy = lambda v: ~v.isin("", "false", "0", "null")
    sure = [F.coalesce(truthy(get(k)), F.lit(False)).alias(k) for k in ("specific_examples_present", "evidence_described", "timeline_clear")]
    maybe = [truthy(get(k)).alias(k) for k in INFERRED_FLAGS if k not in ("specific_examples_present", "timeline_clear")]
    length = F.coalesce(get("length_character_count").try_cast("int"), F.lit(0)).alias("length_character_count")
    return F.when(F.trim(stored).startswith("{") & F.from_json(stored, "map<string,string>").isNotNull(), F.struct(F.coalesce(get("summary"), F.lit("")).alias("summary"), *[strings(k) for k in LISTS], *sure, *maybe, length))


def one_shot(raw, measured) -> Column:
    """[N5] a reply that holds both passes in one object, read like two; safe defaults where it holds none."""
    found = extract_json(raw)
    return merge_passes(normalise_pass(found, False), normalise_pass(found, True), F.length(measured))


def list_or_none(items) -> Column:
    """[P21]"""
    return F.when(F.size(items) > 0, F.array_join(items, ", ")).otherwise(NONE)


def criteria_text(kind, label, threshold) -> Column:
    """[P21] a rule's condition in words."""
    return F.when(kind == "boolean_false", F.concat(label, F.lit(": Not present"))).when(kind == "empty_array", F.concat(label, F.lit(": None provided"))).when(kind == "length_threshold", F.concat(label, F.lit(": Below "), threshold.cast("string"), F.lit(" characters"))).otherwise(kind)


def first_persons(persons, n: int = 3) -> Column:
    """[T10] the first rows of the persons that are not blank."""
    return F.slice(persons, 1, n)
