"""Keyed stores as Parquet tables with a persistent counter [S1-S4, K1-K5, K7-K12, P1, C6].

A store is a folder of numbered pointers and of the tables they name. A write makes a new table, checks its count and then
creates the next pointer, a file that is never written again, so readers see the old table or the new one, whenever a
writer is lost; a pointer that was cut short is passed over. A writer whose store has moved on since it read, or that loses
the race for the next number, gets an error instead of undoing the other's work. Ids come from the counter and are never
given twice.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.numbering import numbered
from lodestone.plans.shared import materialise


class Store:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _files(self):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        at = hadoop.Path(self.path)
        return hadoop, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _pointers(self) -> list[int]:
        """Numbers of the pointers."""
        _, files, at = self._files()
        names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
        return sorted(int(n.split("-")[1]) for n in names if n.startswith("pointer-"))

    def _pointer(self) -> tuple[str, int, int] | None:
        """The newest whole pointer: version, next id and number; none for a store that was never written, or whose first
        writer was lost. One that was written and has no whole pointer is corrupt."""
        for n in reversed(self._pointers()):
            row = self.spark.read.json(f"{self.path}/pointer-{n}", schema="version string, next_id bigint", mode="PERMISSIVE").collect()
            if len(row) == 1 and row[0].version is not None and row[0].next_id is not None:
                return row[0].version, row[0].next_id, n
        if self._began():
            raise ValueError(f"{self.path} is corrupt")
        return None

    def _began(self) -> bool:
        """Whether a pointer was ever made: its first one leaves a mark beside it."""
        hadoop, files, _ = self._files()
        return files.exists(hadoop.Path(f"{self.path}/_began"))

    def _point(self, version: str, next_id: int, base: int) -> None:
        if (self._pointer() or (None, None, 0))[2] != base:
            raise ValueError(f"{self.path} was written by another writer")
        hadoop, files, _ = self._files()
        number = max(self._pointers(), default=0) + 1
        out = files.create(hadoop.Path(f"{self.path}/pointer-{number}"), False)  # raises if another writer was first
        out.write(bytearray(json.dumps({"version": version, "next_id": next_id}).encode()))
        out.close()
        files.create(hadoop.Path(f"{self.path}/_began"), True).close()

    @property
    def next_id(self) -> int:
        """[A14] the id that the next row gets; 1 for a new store."""
        found = self._pointer()
        return found[1] if found else 1

    def read(self) -> DataFrame:
        """[S2, S4] all rows; a store that was never written is empty, one that cannot be read is an error."""
        found = self._pointer()
        return self.spark.createDataFrame([], self.schema) if found is None else self.spark.read.schema(self.schema).parquet(f"{self.path}/{found[0]}")

    def read_or_empty(self) -> tuple[DataFrame, int]:
        """[S3] rows and the next id for stores that may be lost: missing, corrupt and misshapen ones are empty and begin at 1,
        and a counter that is behind the ids is moved past them."""
        try:
            found = self._pointer()
        except (PySparkException, ValueError):
            found = None
        if found is None:
            return self.spark.createDataFrame([], self.schema), 1
        rows = self.spark.read.schema(self.schema).options(ignoreCorruptFiles=True, ignoreMissingFiles=True).parquet(f"{self.path}/{found[0]}")
        last = rows.agg(F.max("id"), F.count("*")).first()
        return rows, max(found[1] or 1, (last[0] or 0) + 1, last[1] + 1)

    def replace(self, rows: DataFrame, next_id: int | None = None, expected: int | None = None, base: int | None = None) -> None:
        """[K4, K5] writes a version, checks its count and makes it current, if the store's pointer is still number ``base`` (without one,
        the number at the start of the call)."""
        found = self._pointer()
        base = (found[2] if found else 0) if base is None else base
        next_id = (found[1] if found else 1) if next_id is None else next_id
        version = f"v{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{version}")
        if expected is not None and (n := self.spark.read.parquet(f"{self.path}/{version}").count()) != expected:
            raise ValueError(f"{n} rows were written instead of {expected}")
        self._point(version, next_id, base)

    @property
    def number(self) -> int:
        """The number of the pointer; 0 for a new store."""
        found = self._pointer()
        return found[2] if found else 0

    def create(self, rows: DataFrame, order: list[str]) -> None:
        """[K1, K8, K15] appends rows with the next ids, in the given order. ``rows`` has all columns but id."""
        base = self.number
        old, first = self.read(), self.next_id
        new = materialise(numbered(rows, order), "new-rows")
        ids = new.withColumn("id", F.col("number") + F.lit(first))
        self.replace(old.unionByName(ids.select(*old.columns)), first + new.count(), base=base)

    def update(self, changes: DataFrame) -> DataFrame:
        """[K2, K9] rows with the non-null fields of ``changes`` (id and some columns); returns id and found of each change."""
        base = self.number
        old = self.read()
        fields = [c for c in changes.columns if c != "id"]
        joined = old.alias("o").join(changes.select("id", *[F.col(c).alias(f"_{c}") for c in fields]), "id", "left")
        new = joined.select(*[F.coalesce(f"_{c}", f"o.{c}").alias(c) if c in fields else F.col(c) for c in old.columns])
        found = changes.select("id").join(old.select("id", F.lit(True).alias("found")), "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))
        found = self.spark.createDataFrame(found.collect(), "id bigint, found boolean") if changes.count() <= 10_000 else found
        self.replace(new, base=base)
        return found

    def delete(self, ids: DataFrame) -> int:
        """[K3] removes rows and says how many; the ids are not given again."""
        base = self.number
        old = self.read()
        kept = old.join(ids.select("id"), "id", "left_anti")
        before, after = old.count(), kept.count()
        self.replace(kept, base=base)
        return before - after

    def clear(self) -> None:
        """[K11]"""
        self.replace(self.spark.createDataFrame([], self.schema))


def import_json(spark: SparkSession, path: str, items: str) -> tuple[DataFrame, int]:
    """[S1] rows and next id of a JSON file: an object with next_id and items, or a bare list. Blank is empty, corrupt raises.
    ``items`` is the rows' struct type."""
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect()).strip()
    if not text:
        return spark.createDataFrame([], spark.createDataFrame([], f"x {items}").select("x.*").schema), 1
    one = spark.createDataFrame([(text,)], "t string")
    kind = "array" if text.startswith("[") else "object"
    shape = f"array<{items}>" if kind == "array" else f"struct<next_id:bigint,items:array<{items}>>"
    parsed = one.select(F.from_json("t", shape, {"mode": "FAILFAST"}).alias("j"))
    rows = parsed.select(F.explode("j" if kind == "array" else "j.items").alias("x")).select("x.*")
    stored = None if kind == "array" else parsed.select("j.next_id").first()[0]
    return rows, stored or (rows.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0])


def submission_rows(raw: DataFrame) -> DataFrame:
    """[P1, S2] aliases resolved, null lists and maps empty; a row without id or timestamp is an error."""
    names = set(raw.columns)
    form = F.coalesce(*[F.col(c) for c in ("formData", "form_data") if c in names], F.create_map().cast("map<string,string>"))
    sure = raw.where(F.assert_true(F.col("id").isNotNull() & F.col("timestamp").isNotNull()).isNull())
    gaps = F.coalesce(F.col("gaps") if "gaps" in names else F.lit(None).cast("array<string>"), F.array().cast("array<string>"))
    return sure.select("id", "timestamp", form.alias("formData"), gaps.alias("gaps"))
