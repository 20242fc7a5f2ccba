"""Gap rules over extractions [E1-E4, E11, F11, F16, S6, T6, U1, W5, J4]."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Default rules as id, label, priority, criteria type and field; field types; which criteria suit a type.
DEFAULT_RULES = [
    ("no_specific_example", "No Specific Example", 1, "boolean_false", "specific_examples_present"), ("no_witnesses_mentioned", "No Witnesses Mentioned", 2, "boolean_false", "witnesses_mentioned"),
    ("no_prior_reporting", "No Prior Reporting Mentioned", 3, "boolean_false", "prior_reporting_mentioned"), ("no_impact_described", "No Impact Described", 4, "boolean_false", "impact_described"),
    ("no_retaliation_context", "No Retaliation Context", 5, "boolean_false", "retaliation_mentioned"),
]
FIELD_TYPES = {"summary": "string", "dates_mentioned": "array", "people_mentioned": "array", "locations_mentioned": "array", "allegation_type": "array", "specific_examples_present": "boolean", "evidence_described": "boolean", "timeline_clear": "boolean", "witnesses_mentioned": "boolean", "prior_reporting_mentioned": "boolean", "impact_described": "boolean", "retaliation_mentioned": "boolean", "length_character_count": "number"}
SUITS = {"boolean_false": "boolean", "empty_array": "array", "length_threshold": "number"}
RULE = "id string, label string, priority int, active boolean, type string, field string, threshold double, template string"


def default_rules(spark) -> DataFrame:
    return spark.createDataFrame([(i, label, p, True, t, f, None, f"Could you tell us more? ({label})") for i, label, p, t, f in DEFAULT_RULES], RULE)


def facts(extractions: DataFrame, key: str = "rid") -> DataFrame:
    """key, field, flag, items, number of every field that rules can read. ``extractions``: key and the fields."""
    rows = []
    for name, kind in FIELD_TYPES.items():
        if name in extractions.columns:
            c = F.col(name)
            rows.append(F.struct(F.lit(name).alias("field"), (F.coalesce(c, F.lit(False)) if kind == "boolean" else F.lit(None).cast("boolean")).alias("flag"), (F.coalesce(F.size(c), F.lit(0)) if kind == "array" else F.lit(None).cast("int")).alias("items"), (F.coalesce(c, F.lit(0)).cast("double") if kind == "number" else F.lit(None).cast("double")).alias("number")))
    return extractions.select(key, F.explode(F.array(*rows)).alias("f")).select(key, "f.*")


def evaluate(extractions: DataFrame, rules: DataFrame, key: str = "rid") -> DataFrame:
    """[E1] key and the active rules whose gap is present. An unknown field counts as false or empty, an unknown type never holds. Rules are a setting of a few rows."""
    active = rules.where("coalesce(active, true)")
    every = extractions.select(key).crossJoin(F.broadcast(active))
    met = every.join(facts(extractions, key), [key, "field"], "left")
    t = F.col("type")
    gap = F.when(t == "boolean_false", ~F.coalesce("flag", F.lit(False))).when(t == "empty_array", F.coalesce("items", F.lit(0)) == 0).when((t == "length_threshold") & F.col("threshold").isNotNull(), F.floor(F.coalesce("number", F.lit(0.0))) < F.floor("threshold")).otherwise(False)
    return met.where(gap).select(key, F.col("id").alias("gap_id"), F.coalesce("priority", F.lit(999)).alias("priority"), "template")


def suppressed(forms: DataFrame, key: str = "rid") -> DataFrame:
    """[E2, U1] key and gap_id that the form answers already. ``forms``: management_aware, sequence_of_events."""
    prior = F.when(F.lower(F.trim("management_aware")) == "yes", F.lit("no_prior_reporting"))
    example = F.when(F.length(F.trim("sequence_of_events")) >= 60, F.lit("no_specific_example"))
    return forms.select(key, F.explode(F.array_compact(F.array(prior, example))).alias("gap_id"))


def top_gaps(extractions: DataFrame, rules: DataFrame, forms: DataFrame | None = None, most: int = 2, key: str = "rid") -> DataFrame:
    """[E3, E4, W5, X20] the first gaps by priority after suppression, with their questions. Extractions marked as defaults have none."""
    usable = extractions.where("not coalesce(_used_defaults, false)") if "_used_defaults" in extractions.columns else extractions
    found = evaluate(usable, rules, key)
    if forms is not None:
        found = found.join(suppressed(forms, key), [key, "gap_id"], "left_anti")
    w = Window.partitionBy(key).orderBy("priority", "gap_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(key, "rank", "gap_id", F.left("template", F.lit(300)).alias("question_text"))


def violations(rules: DataFrame) -> DataFrame:
    """id and problem of rules that break a constraint."""
    same = Window.partitionBy("id")
    rank = Window.partitionBy("priority")
    kind = F.create_map(*[F.lit(x) for kv in FIELD_TYPES.items() for x in kv])[F.col("field")]
    suits = F.create_map(*[F.lit(x) for kv in SUITS.items() for x in kv])[F.col("type")]
    checks = F.array(
        F.when(F.trim(F.coalesce("id", F.lit(""))) == "", "id is empty"), F.when(F.count("*").over(same) > 1, "id repeats"), F.when(F.coalesce(F.col("priority") < 1, F.lit(True)), "priority is below 1"),
        F.when(F.count("*").over(rank) > 1, "priority repeats"), F.when(suits.isNull(), "type is unknown"), F.when(kind.isNull(), "field is unknown"),
        F.when(suits.isNotNull() & kind.isNotNull() & (suits != kind), "type does not suit the field"), F.when((F.col("type") == "length_threshold") & F.col("threshold").isNull(), "threshold is missing"), F.when(F.trim(F.coalesce("template", F.lit(""))) == "", "template is empty"),
    )
    return rules.withColumn("_problems", F.array_compact(checks)).select("id", F.explode("_problems").alias("problem"))


def usable_rules(rules: DataFrame) -> DataFrame:
    """[S6] valid rules by priority; the defaults where none is valid."""
    bad = violations(rules).select("id").distinct()
    good = rules.join(bad, "id", "left_anti")
    return (default_rules(rules.sparkSession) if good.isEmpty() else good).orderBy(F.coalesce("priority", F.lit(999)), "id")


def template_hints(c):
    """[F16]"""
    return F.array_compact(F.array(F.when(F.length(c) < 20, "short"), F.when(F.length(c) > 300, "long"), F.when(~c.contains("?"), "no question mark"), F.when(~F.lower(c).contains("already"), "no way to say it was answered")))


def check_expectations(results: DataFrame, expectations: DataFrame) -> DataFrame:
    """[E11] run_id, step, violations. ``results``: run_id, step, passed, length, gaps, quote, classification; ``expectations``: step and limits."""
    e = results.join(F.broadcast(expectations), "step", "left")
    checks = F.array(
        F.when(F.col("should_pass") != F.col("passed"), "pass"), F.when(F.col("length") < F.col("min_length"), "min_length"), F.when(F.col("gaps") > F.col("max_gaps"), "max_gaps"), F.when(F.col("gaps") < F.col("min_gaps"), "min_gaps"),
        F.when(F.col("must_have_quote") & (F.coalesce("quote", F.lit("")) == ""), "quote"), F.when(F.col("expected_classification") != F.col("classification"), "classification"),
    )
    return e.select("run_id", "step", F.array_compact(checks).alias("violations"))
