"""Intermediate tables in the cluster's shared folder.

A step that reads its input many times (folds, restarts, quantile passes)
writes it once as Parquet and reads it back: lineage is cut, a lost executor
costs a re-read instead of a recomputation, and later passes still get column
pruning and filter push-down.

``spark.checkpoint.dir`` names the folder.  Where it is unset, a folder below
the warehouse is used, which a cluster's executors share as well; it goes when
the interpreter ends.
"""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes: list[list[str]] = []


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by the session, or one below the warehouse."""
    context = spark.sparkContext
    root = spark.conf.get(_SETTING, None) or context.getCheckpointDir()
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        root = f"{warehouse.rstrip('/')}/checkpoints-{context.applicationId}"
        context.setCheckpointDir(root)
        where = urlparse(root)
        if where.scheme in ("", "file"):
            atexit.register(shutil.rmtree, where.path, ignore_errors=True)
    return root.rstrip("/")


def _session_folder(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/alertlift-staged/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """A new path below the session's part of the shared folder."""
    return f"{_session_folder(spark)}/{uuid.uuid4().hex}/{name}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as a plain scan."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staged_scope(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what was staged inside; stage a result outside before."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            _delete(spark, path.rpartition("/")[0])


def keep_staged(df: DataFrame) -> DataFrame:
    """Stage the result of a scope for the scope around it."""
    inner = _scopes.pop() if _scopes else None
    try:
        return stage(df)
    finally:
        if inner is not None:
            _scopes.append(inner)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table before its scope ends."""
    for folder in {f.rpartition("/")[0].rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each query that runs inside go when it is done, not when the driver happens to collect garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def drop_staged(spark: SparkSession) -> None:
    """Delete what this session staged; frames that read it become invalid."""
    _delete(spark, _session_folder(spark))
