"""Storage that every executor can see.

Lineage is cut by writing a table below ``spark.checkpoint.dir``: a lost executor then costs a re-read, never a
recomputation or a lost block. Machine-local folders are used in local mode only.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows per Arrow batch for operators that hand whole texts to Python; bounds a worker's memory with long texts.
TEXT_BATCH_ROWS = 500


#: Temporary folders of local applications that have no spark.checkpoint.dir, by application id; that setting is fixed once a session runs.
LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode without one, a temporary folder of the application."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    name = spark.sparkContext.applicationId
    if name not in LOCAL:
        LOCAL[name] = tempfile.mkdtemp(prefix="lodestone-")
    return LOCAL[name]


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


#: Tables that ``materialise`` has written and nobody has released, with their sessions.
HELD: dict[str, SparkSession] = {}


@atexit.register
def _delete_late() -> None:
    for path, spark in HELD.items():
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # the gateway may be gone when Python exits; the folder then stays for the cluster's own cleaning
            pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and return the table as read back; deleted by ``release``, or when Python exits."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    HELD[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back._held_at = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialise``. Only for tables whose every reader has been written itself; other frames are left alone."""
    for t in tables:
        spark = HELD.pop(getattr(t, "_held_at", None), None)
        if spark is not None:
            delete(spark, t._held_at)


def text_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size for whole texts, unless it is lower already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
