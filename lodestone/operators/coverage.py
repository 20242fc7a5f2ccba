"""Dual-corpus coverage and its calibration [R7, R8, J8, J12, J13, A10-A13, E10]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLASSES = ["covered", "legal_only", "policy_only", "uncovered"]
SUMS = ["right", "judged", "total"]
CORNERS = "array<struct<a: int, b: int, right: bigint, judged: bigint, total: bigint>>"


def classify(policy, legal, tau_policy=0.65, tau_legal=0.60):
    """[R7] a threshold is met at its own value; a missing score never meets it."""
    p = F.coalesce(policy >= tau_policy, F.lit(False)) & ~F.coalesce(F.isnan(policy), F.lit(False))
    q = F.coalesce(legal >= tau_legal, F.lit(False)) & ~F.coalesce(F.isnan(legal), F.lit(False))
    return F.when(p & q, "covered").when(q, "legal_only").when(p, "policy_only").otherwise("uncovered")


def notices(policy, legal, tau_policy=0.65, tau_legal=0.60):
    """[R8] one notice for each missed corpus, policy first; silence is ascribed to the index."""
    say = lambda name, score, tau: F.when(~F.coalesce(score >= tau, F.lit(False)), F.lit(f"No passage in the indexed {name} corpus met the threshold."))
    return F.array_compact(F.array(say("policy", policy, tau_policy), say("legal", legal, tau_legal)))


def best_scores(hits: DataFrame) -> DataFrame:
    """[J8] qid, policy, legal: each corpus's best similarity in one pass. ``hits``: qid, corpus, sim."""
    return hits.groupBy("qid").agg(F.max(F.when(F.col("corpus") == "policy", F.col("sim"))).alias("policy"), F.max(F.when(F.col("corpus") == "legal", F.col("sim"))).alias("legal"))


def coverage(scores: DataFrame, tau_policy: float = 0.65, tau_legal: float = 0.60) -> DataFrame:
    p, q = F.col("policy"), F.col("legal")
    return scores.withColumn("classification", classify(p, q, tau_policy, tau_legal)).withColumn("absence_notices", notices(p, q, tau_policy, tau_legal))


def grid(spark, low: int = 30, high: int = 80, step: int = 5) -> DataFrame:
    """[J13] the thresholds to try, in hundredths."""
    return spark.range(low, high + 1, step).select((F.col("id") / 100.0).alias("tau"))


def grid_counts(records: DataFrame, taus: DataFrame) -> DataFrame:
    """[J13, A10, A11] tau_policy, tau_legal, correct, judged, total of every pair of thresholds. ``records``: expected, policy, legal.

    A record counts once, in the cell of how many thresholds each score meets, so what is shuffled is bounded by classes and
    cells, whatever the number of records. In the grid, the pairs at which a class is right form quadrants below a cell; the sum
    over all cells that dominate a pair, along one axis and then along the other, gives its number of right records. ``taus``
    are a setting of a few rows: null, NaN and repeated ones count once or not at all. Null and NaN scores meet none.
    ``judged`` leaves out records without an expected class; without records there are no rows.
    """
    steps = sorted({float(r.tau) for r in taus.select("tau").distinct().collect() if r.tau is not None and r.tau == r.tau})
    m, levels = len(steps), F.array(*map(F.lit, steps)).cast("array<double>")
    met = lambda c: F.when(F.col(c).isNull() | F.isnan(c), 0).otherwise(F.size(F.filter(levels, lambda t: t <= F.col(c))))
    held = records.select("expected", met("policy").alias("p"), met("legal").alias("q")).groupBy("expected", "p", "q").agg(F.count("*").alias("n"))
    p, q, n, every, none = F.col("p"), F.col("q"), F.col("n"), F.lit(m), F.lit(0).cast("bigint")
    at = lambda a, b, right, judged=none, total=none: F.struct(a.alias("a"), b.alias("b"), right.alias("right"), judged.alias("judged"), total.alias("total"))
    ruled = (
        F.when(F.col("expected") == "covered", F.array(at(p, q, n)))
        .when(F.col("expected") == "policy_only", F.array(at(p, every, n), at(p, q, -n)))
        .when(F.col("expected") == "legal_only", F.array(at(every, q, n), at(p, q, -n)))
        .when(F.col("expected") == "uncovered", F.array(at(every, every, n), at(p, every, -n), at(every, q, -n), at(p, q, n)))
    )
    whole = F.array(at(every, every, none, F.when(F.col("expected").isNull(), none).otherwise(n), n))
    corners = held.select(F.inline(F.concat(F.coalesce(ruled, F.array().cast(CORNERS)), whole)))
    places = records.sparkSession.range(1, m + 1).select(F.col("id").cast("int").alias("a"), F.explode(F.sequence(F.lit(1), every)).alias("b")) if m else records.sparkSession.createDataFrame([], "a int, b int")
    cells = corners.union(places.select("a", "b", none, none, none)).where("a > 0 and b > 0").groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in SUMS])
    for fixed, along in (("a", "b"), ("b", "a")):
        beyond = Window.partitionBy(fixed).orderBy(F.desc(along))
        cells = cells.select("a", "b", *[F.sum(c).over(beyond).alias(c) for c in SUMS])
    tau = lambda c: F.element_at(levels, F.col(c))
    return cells.where("total > 0").select(tau("a").alias("tau_policy"), tau("b").alias("tau_legal"), F.col("right").alias("correct"), "judged", "total")


def accuracy() -> Column:
    return F.round(F.col("correct") / F.nullif("judged", F.lit(0)), 6)


def sweep(records: DataFrame, taus: DataFrame) -> DataFrame:
    """[A10] tau, accuracy, correct, total at one threshold for both corpora. ``records``: expected, policy, legal; the grid is a few rows."""
    return grid_counts(records, taus).where("tau_policy = tau_legal").select(F.col("tau_policy").alias("tau"), accuracy().alias("accuracy"), "correct", "total")


def best_pair(records: DataFrame, taus: DataFrame) -> DataFrame:
    """[A11] the first best pair in grid order."""
    scored = grid_counts(records, taus).select("tau_policy", "tau_legal", accuracy().alias("accuracy"))
    return scored.orderBy(F.desc("accuracy"), "tau_policy", "tau_legal").limit(1)


def confusion(records: DataFrame, classes: list[str] = CLASSES) -> DataFrame:
    """[A12] expected by predicted, rows with data only. ``records``: expected, predicted."""
    counts = records.groupBy("expected").pivot("predicted", classes).count()
    return counts.select("expected", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in classes])


def citation_accuracy(records: DataFrame) -> DataFrame:
    """[A13, J12] over checks that name a section. ``records``: wanted (null without a check), section."""
    hit = F.lower("section").contains(F.lower("wanted"))
    return records.where("wanted is not null").agg(F.count_if(F.coalesce(hit, F.lit(False))).alias("correct"), F.count("*").alias("total"))
