"""Cutting lineage so that the loss of an executor never loses work.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``. Where the
session has no such setting (tests, local runs) a folder of our own is used and removed at exit.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, or one of our own in a local session without it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:  # a session may have been given the folder after its start
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = given.get() if given.isDefined() else None
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="kartei-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return "file://" + _OWN[0]


def materialise(df: DataFrame, *, partition_by: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and return a reader of that table.

    The result has a one-step lineage, true size statistics for the planner and column pruning.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kartei-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    _TABLES[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    table.kartei_path = path
    return table


_TABLES: dict[str, SparkSession] = {}


def _delete(path: str) -> None:
    spark = _TABLES.pop(path, None)
    if spark is None:
        return
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001 - the session may be gone already; the others are tried all the same
        pass


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``materialise`` that nothing reads any more: what was made of them has been written itself."""
    for table in tables:
        if table is not None and hasattr(table, "kartei_path"):
            _delete(table.kartei_path)


@contextmanager
def passing() -> Iterator[None]:
    """Tables written inside are deleted at the end, for work that is done again and again."""
    before = set(_TABLES)
    try:
        yield
    finally:
        for path in set(_TABLES) - before:
            _delete(path)


def release() -> None:
    """Delete the tables written so far (call after the results that read them were consumed)."""
    for path in list(_TABLES):
        _delete(path)


atexit.register(release)
