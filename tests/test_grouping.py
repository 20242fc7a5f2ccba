"""Word budgets and running sums spread over tasks, against folds."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import ingest


def fold(sizes, most):
    out, run, grp = [], 0, 0
    for n in sizes:
        if run > 0 and run + n > most:
            run, grp = 0, grp + 1
        run += n
        out.append(grp)
    return out


CASES = [[], [0], [0, 0, 5], [9], [9, 0, 0, 1], [0, 9, 0, 9], [5, 5, 1], [5, 0, 5, 0, 0, 6], [3, 3, 3, 1, 0, 10, 2, 30, 0, 1], [10] * 7, [1] * 300]


def cases():
    r = random.Random(2)
    return CASES + [[r.choice([0, 0, 1, 2, 3, 7, 10, 11, 25]) for _ in range(r.randint(1, 60))] for _ in range(60)]


@pytest.mark.parametrize("long", [-1, 8, 10_000])
def test_groups_are_the_folds(spark, long):
    docs = spark.createDataFrame(list(enumerate(cases())), "doc bigint, sizes array<int>")
    got = {(r.doc, r.n): (r.words, r.grp) for r in ingest.grouped_lines(docs, "doc", "sizes", 10, long).collect()}
    assert got == {(d, i): (s[i], g) for d, s in enumerate(cases()) for i, g in enumerate(fold(s, 10))}


def test_many_lines_in_a_row_are_linear(spark):
    one = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda x: x % 40).alias("s"))
    groups = one.select(ingest.groups_of_words("s").alias("g")).first().g
    assert groups == fold([x % 40 for x in range(1, 60_001)], 350)


def test_sums_of_a_hot_key_are_spread(spark):
    rows = spark.range(1_000_000).select(F.lit("hot").alias("k"), F.col("id").alias("n"), (F.col("id") % 7).alias("v"))
    small = spark.createDataFrame([(None, 3, 5), (None, 9, 1), ("b", 0, 2)], "k string, n bigint, v bigint")
    got = ingest.segmented_sums(rows.union(small), "k", "n", "v", 10_000)
    assert got.where("k is null or k = 'b'").select("k", "n", "before").orderBy("k", "n").collect() == [(None, 3, 0), (None, 9, 5), ("b", 0, 0)]
    odd = got.where("k = 'hot'").where(F.col("before") != F.floor(F.col("n") / 7) * 21 + F.element_at(F.array(*[F.lit(x) for x in (0, 0, 1, 3, 6, 10, 15)]), (F.col("n") % 7 + 1).cast("int")))
    assert odd.count() == 0
    dealt = rows.withColumn("_b", F.floor(F.col("n") / 10_000)).repartition(16, "k", "_b").groupBy(F.spark_partition_id()).count()
    assert dealt.count() > 8
