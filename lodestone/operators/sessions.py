"""Conversation history [W8-W10, P14, ST2 in batch]."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import estimated_tokens


def history(messages: DataFrame, system_tokens: int = 0, context: int = 8192, reserved: int = 512, most: int = 20) -> DataFrame:
    """[W8] the newest messages of each conversation that fit the budget. ``messages``: conv_id, turn, role, text.

    Costs are positive, so stopping at the first overflow is a bound on the running sum.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    # the last rows first, of which Spark keeps no more than ``most`` a task and key before it shuffles; then their sums
    last = messages.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= most)
    spent = F.sum(estimated_tokens(F.col("text")) + 20).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return last.withColumn("spent", spent).where(F.col("spent") <= context - system_tokens - reserved - 100)


def digest(messages: DataFrame, last: int = 4, chars: int = 80, most: int = 200) -> DataFrame:
    """[W9] conv_id and recent: the last messages, cut, while they fit; separators do not count."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    line = F.concat("role", F.lit(": "), F.left("text", F.lit(chars)), F.lit("..."))
    rows = messages.withColumn("line", line).withColumn("back", F.row_number().over(newest)).where(F.col("back") <= last)
    rows = rows.withColumn("spent", F.sum(F.length("line")).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    kept = F.filter(F.array_sort(F.collect_list(F.struct("turn", "spent", "line"))), lambda r: r["spent"] <= most)
    return rows.groupBy("conv_id").agg(kept.alias("kept")).select("conv_id", F.when(F.size("kept") == 0, "(none)").otherwise(F.array_join(F.transform("kept", lambda r: r["line"]), " | ")).alias("recent"))


def prompt(messages: DataFrame, system: str) -> DataFrame:
    """[P14] conv_id and prompt."""
    kept = history(messages, system_tokens=len(system) // 4)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["text"], F.lit("\n\n")))
    return kept.groupBy("conv_id").agg(F.concat(F.lit(f"System: {system}\n\n"), F.array_join(lines, ""), F.lit("Assistant: ")).alias("prompt"))


def last_rows(rows: DataFrame, key: list[str], order: list, most: int = 50) -> DataFrame:
    """[W7, W10, K10] the last ``most`` rows of each key."""
    return rows.withColumn("_back", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_back") <= most).drop("_back")


def valid_messages(messages: DataFrame, most: int = 5000) -> DataFrame:
    """adds the reason a message is refused; null where it is fine."""
    t = F.trim(F.coalesce("text", F.lit("")))
    return messages.withColumn("refused", F.when(t == "", "empty").when(F.length(t) > most, "too long"))
