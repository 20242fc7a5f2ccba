"""Structured Streaming forms of the standing metrics and of session state [ST2, ST5-ST8]."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from lodestone.operators.metrics import class_counts
from lodestone.plans.shared import exists, shared_dir


def in_order(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """All rows that a key has in one batch of the stream, sorted. Spark hands them over in pieces, cut where an Arrow batch was full
    and not where the order has a cut, so sorting each piece would mix them up."""
    return pd.concat(list(batches), ignore_index=True).sort_values(by, kind="stable")


def windowed_counts(events: DataFrame, classes: list[str], length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """[ST5] start and counts of each event-time window; events later than ``late`` are dropped. ``events``: ts (timestamp), classification."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length))
    return w.agg(*class_counts(events, classes)).select(F.col("window.start").alias("start"), *classes, "unclassified")


def session_state(messages: DataFrame, most: int = 50) -> DataFrame:
    """[ST2, W10] conv_id, n_messages, n_chars and last_role after each batch, kept per conversation; only bounded totals and the last ``most`` roles are state."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, chars, roles = state.get if state.exists else (0, 0, "")
        pdf = in_order(batches, ["turn"])
        n, chars = n + len(pdf), chars + int(pdf.text.fillna("").str.len().sum())
        roles = ",".join([*filter(None, roles.split(",")), *pdf.role.fillna("")][-most:])
        state.update((n, chars, roles))
        yield pd.DataFrame({"conv_id": [key[0]], "n_messages": [n], "n_chars": [chars], "last_role": [roles.split(",")[-1]]})

    return messages.groupBy("conv_id").applyInPandasWithState(step, "conv_id bigint, n_messages bigint, n_chars bigint, last_role string", "n bigint, chars bigint, roles string", "update", GroupStateTimeout.NoTimeout)


def exhaustion_state(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """[ST7, D3] event_id and whether its key has failed before on the same UTC day. ``events``: key, event_id, ts (timestamp), failed.

    State is the last day and whether it had a failure. It leaves when the watermark, ``late`` behind the newest event,
    passes the day's end, so state is kept for keys of days that are still open only. Events of a batch are taken in order
    of time; one from an earlier day than the state's counts as not exhausted and changes nothing.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        day, out = state.get if state.exists else ("", False)
        pdf, rows = in_order(batches, ["ts", "event_id"]), []
        for i, at, failed in zip(pdf.event_id.tolist(), pdf.ts.dt.strftime("%Y-%m-%d").tolist(), pdf.failed.fillna(False).astype(bool).tolist()):
            if at > day:
                day, out = at, False
            rows.append((i, out and at == day))
            out = out or failed and at == day
        yield pd.DataFrame(rows, columns=["event_id", "exhausted"])
        over = int(pd.Timestamp(day, tz="UTC").timestamp() * 1000) + 86_400_000
        if over > state.getCurrentWatermarkMs():
            state.update((day, bool(out)))
            state.setTimeoutTimestamp(over)
        elif state.exists:
            state.remove()

    return events.withWatermark("ts", late).groupBy("key").applyInPandasWithState(step, "event_id bigint, exhausted boolean", "day string, out boolean", "append", GroupStateTimeout.EventTimeTimeout)


class Sessions(StatefulProcessor):
    """Per conversation: its history as a list, its report as a map, and the prompt made of the report."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getListState("history", "turn bigint, role string, text string")
        self.report = handle.getMapState("report", "field string", "value string")
        self.prompt = handle.getValueState("prompt", "text string, built bigint, fresh boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        text, built, fresh = self.prompt.get() if self.prompt.exists() else ("", 0, False)
        for m in in_order(rows, ["turn"]).itertuples(index=False):
            if m.role == "reset":
                self.history.clear()
                self.report.clear()
                text, fresh = "", False
                continue
            self.history.appendValue((m.turn, m.role, m.text))
            updates = dict(m.updates) if m.updates is not None else {}
            for k, v in updates.items():
                if v:
                    self.report.updateValue((k,), (v,))
                    fresh = False
            if m.role == "assistant" and not fresh:
                text, built, fresh = self._said(), built + 1, True
        self.prompt.update((text, built, fresh))
        n = sum(1 for _ in self.history.get())
        yield pd.DataFrame({"conv_id": [key[0]], "n_messages": [n], "report": [self._said()], "prompt": [text], "built": [built]})

    def _said(self) -> str:
        return ",".join(sorted(f"{k[0]}={v[0]}" for k, v in self.report.iterator()))

    def close(self) -> None:
        pass


def session_reports(messages: DataFrame) -> DataFrame:
    """[ST2, ST3] conv_id, n_messages, report (its fields in order), prompt and how often it was built, after each batch of a
    conversation. ``messages``: conv_id, turn, role, text, updates (a map, or null).

    History is appended to, updates with a value replace fields of the report and drop the prompt, an assistant's turn needs
    the prompt and builds it from the report where it was dropped, and a turn of the role ``reset`` empties both. Turns
    of a batch are taken in order. State is a list, a map and a value of Spark's store, which a restart finds again.
    """
    out = "conv_id bigint, n_messages bigint, report string, prompt string, built bigint"
    return messages.groupBy("conv_id").transformWithStateInPandas(Sessions(), out, "Update", "None")


def sliding_counts(events: DataFrame, classes: list[str], length: str = "90 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """[ST5] start and counts of every sliding window of event time. Late rows inside the watermark change all windows they lie in,
    which are given out again in update mode; windows leave the state when it has passed their end. ``events``: ts (timestamp), classification."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length, step))
    return w.agg(*class_counts(events, classes)).select(F.col("window.start").alias("start"), *classes, "unclassified")


def finished(stream: DataFrame, name: str, mode: str = "update", checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """All that ``stream`` gives for the input there is, as a table with the column batch. A batch is a folder that a re-run writes
    again, so each result counts once. Folders are below the shared one unless they are given; a given ``checkpoint`` and
    ``path`` let a later call go on."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = path or f"{base}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint or f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    schema = StructType([*stream.schema, StructField("batch", IntegerType())])
    return spark.read.schema(schema).option("basePath", path).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def latest(results: DataFrame, key: str) -> DataFrame:
    """The last result of each key."""
    last = results.groupBy(key).agg(F.max("batch").alias("batch"))
    return results.join(last, [key, "batch"]).drop("batch")


def embedded(rows: DataFrame, embed, column: str = "text", size: int = 25, tries: int = 3) -> DataFrame:
    """[ST8] ``rows`` with ``vec``: ``embed`` takes up to ``size`` texts at a time and is asked again up to ``tries`` times."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def ask(texts: list) -> list:
        for left in range(tries - 1, -1, -1):
            try:
                return embed(texts)
            except Exception:
                if not left:
                    raise
        return []

    def run(batches):
        for pdf in batches:
            vecs: list = []
            for at in range(0, len(pdf), size):
                vecs += ask(pdf[column].iloc[at : at + size].tolist())
            yield pdf.assign(vec=vecs)

    return rows.mapInPandas(run, f"{schema}, vec array<double>")


def upsert_batches(stream: DataFrame, apply, checkpoint: str, available_now: bool = True):
    """[ST3, ST6] runs ``apply(batch, batch_id)`` on each micro-batch; an idempotent ``apply`` makes a re-run harmless."""
    w = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
