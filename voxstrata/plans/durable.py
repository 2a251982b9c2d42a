"""Lineage cuts that survive a lost executor.

A cut is a Parquet table in the shared folder that the session names in
``spark.checkpoint.dir``; only where that setting is missing and the master is
local (tests, a single machine) a temporary folder is used, elsewhere a missing
setting is an error, as executors don't share a driver's folders.  Tables are
removed when they are dropped explicitly or when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..model import InvalidState

_own_root: list[str] = []
_live: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise InvalidState(f"spark.checkpoint.dir must name a folder that the executors of {master} share")
    if not _own_root:
        _own_root.append("file://" + tempfile.mkdtemp(prefix="voxstrata-"))
    return _own_root[0]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class DurableTable:
    """A written table; ``df`` reads it, ``drop`` removes its files."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        self.path = f"{shared_root(self.spark)}/voxstrata/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        _live.add(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _live.discard(self.path)
        _delete(self.spark, self.path)


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again."""
    return DurableTable(df, tag).df


@atexit.register
def _drop_all() -> None:
    with contextlib.suppress(Exception):
        spark = SparkSession.getActiveSession() or SparkSession._instantiatedSession
        for path in list(_live) if spark is not None else ():
            with contextlib.suppress(Exception):
                _delete(spark, path)
    for root in _own_root:
        with contextlib.suppress(Exception):
            import shutil

            shutil.rmtree(root.removeprefix("file://"), ignore_errors=True)
