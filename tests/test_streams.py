"""Streams run to their end: state that expires, restarts, and late rows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestone.operators import analysis, metrics
from lodestone.streaming import live

DAY = datetime(2024, 1, 1)


def files(spark, path, parts, schema):
    """One file a part, in this order."""
    import time

    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_state_of_past_days_goes(spark, tmp_path):
    schema = "key bigint, event_id bigint, ts timestamp, failed boolean"
    rows, n = [], 0
    for d in range(5):
        part = []
        for k in range(20):
            for h in (1, 2, 3):
                n += 1
                part.append((100 * d + k, n, DAY + timedelta(days=d, hours=h, minutes=k), n % 4 == 0))
        rows.append(part)
    rows.append([(999, n + 1, DAY + timedelta(days=9), True)])
    stream = files(spark, tmp_path / "in", rows, schema)
    check = str(tmp_path / "check")
    found = live.finished(live.exhaustion_state(stream), "x", "append", check, str(tmp_path / "out"))
    every = spark.createDataFrame([r for p in rows for r in p], schema)
    want = analysis.exhausted_today(every, "key", F.col("failed")).select("event_id", "exhausted")
    assert sorted(map(tuple, found.select("event_id", "exhausted").collect())) == sorted(map(tuple, want.collect()))
    kept = spark.read.format("statestore").load(check).select("key.key").collect()
    assert [r.key for r in kept] == [999]  # the 100 keys of past days are gone


def test_order_of_a_key_is_kept_over_arrow_batches(spark, tmp_path):
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    schema = "key bigint, event_id bigint, ts timestamp, failed boolean"
    rows = [(i % 3, i, DAY + timedelta(minutes=(i * 37) % 200), i % 50 == 0) for i in range(200)]
    turns = [(c, t, "assistant" if t % 3 == 0 else "user", "", {f"f{t % 5}": str(t)} if t % 4 == 0 else None) for t in range(60) for c in (1, 2)]
    told = "conv_id bigint, turn bigint, role string, text string, updates map<string,string>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "e"))
    spark.createDataFrame(sorted(turns, key=lambda m: (m[1] * 37 % 60, m[0])), told).coalesce(1).write.parquet(str(tmp_path / "m"))
    before = spark.conf.get(size)
    got = {}
    try:
        for n in ("7", "10000"):
            spark.conf.set(size, n)
            stream = live.exhaustion_state(spark.readStream.schema(schema).parquet(str(tmp_path / "e")))
            exhausted = sorted((r.event_id, r.exhausted) for r in live.finished(stream, "order", "append").collect())
            talk = live.session_reports(spark.readStream.schema(told).parquet(str(tmp_path / "m")))
            said = sorted((r.conv_id, r.n_messages, r.report, r.built) for r in live.latest(live.finished(talk, "talk"), "conv_id").collect())
            got[n] = exhausted, said
    finally:
        spark.conf.set(size, before)
    want = analysis.exhausted_today(spark.createDataFrame(rows, schema), "key", F.col("failed"))
    assert got["7"] == got["10000"]
    assert got["7"][0] == sorted((r.event_id, r.exhausted) for r in want.collect())


def test_sessions_go_on_after_a_restart(spark, tmp_path):
    schema = "conv_id bigint, turn bigint, role string, text string, updates map<string,string>"
    first = [[(1, 0, "user", "a", {"name": "x", "place": ""}), (1, 1, "assistant", "b", None), (2, 0, "user", "c", None)]]
    later = [[(1, 2, "assistant", "d", None), (1, 3, "user", None, {"name": "y", "what": "z"}), (1, 4, "assistant", "e", {})], [(2, 1, "assistant", "f", None), (2, 2, "reset", "", None), (2, 3, "user", "g", {"k": "v"})]]
    check, out = str(tmp_path / "check"), str(tmp_path / "out")
    live.finished(live.session_reports(files(spark, tmp_path / "in", first, schema)), "s", "update", check, out)
    found = live.finished(live.session_reports(files(spark, tmp_path / "in", later, schema)), "s", "update", check, out)
    got = {r.conv_id: tuple(r)[1:] for r in live.latest(found, "conv_id").collect()}
    assert got == {1: (5, "name=y,what=z", "name=y,what=z", 2), 2: (1, "k=v", "", 1)}
    assert found.select("batch").distinct().count() == 3


def test_late_rows_change_the_windows_they_lie_in(spark, tmp_path):
    schema = "ts timestamp, classification string"
    at = lambda d, h=0: DAY + timedelta(days=d, hours=h)
    parts = [[(at(0), "a"), (at(2), "b")], [(at(3), "a"), (at(2, 12), "a")], [(at(1, 20), "b")], [(at(20), "a")], [(at(21), "a")], [(at(0), "a")]]
    stream = files(spark, tmp_path / "in", parts, schema)
    found = live.finished(live.sliding_counts(stream, ["a", "b"], "3 days", "1 day", "2 days"), "w")
    got = {r.start: (r.a, r.b) for r in live.latest(found, "start").collect()}
    kept = [r for p in parts[:5] for r in p]  # the last row is later than the watermark and the end of all its windows
    for start, counts in got.items():
        inside = [c for t, c in kept if start <= t < start + timedelta(days=3)]
        assert counts == (inside.count("a"), inside.count("b"))
    assert len(got) == len({t.date() - timedelta(days=i) for t, _ in kept for i in range(3)})
    assert found.groupBy("start").count().agg(F.max("count")).first()[0] > 1
    batch = metrics.daily(spark.createDataFrame(kept, schema), ["a", "b"], "a")
    assert batch.count() == len({t.date() for t, _ in kept})
