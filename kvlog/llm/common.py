"""Inputs, shared storage and session settings for the corpus operators.

Conventions that every operator follows:

* ``text`` null counts as empty.
* ``doc_id`` null sorts before every other id (it is keyed as the least 64-bit
  integer) and is returned as null.
* Rows that repeat a ``doc_id`` stay separate rows of the result unless an
  operator's docstring says otherwise.
* Columns besides ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key of a null ``doc_id``.
NULL_KEY = -(2**63)

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package, compiled, to the Python workers; they need not have it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    at = tempfile.mkdtemp(prefix="kvlog-")  # the driver serves it to executors as they come
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    path = os.path.join(at, "kvlog-package.zip")
    with zipfile.PyZipFile(path, "w") as z:
        z.writepy(os.path.join(_ROOT, "kvlog"))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def keyed(docs: DataFrame) -> DataFrame:
    """``(k, text)``: the id as a non-null key, the text without nulls."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("k"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def doc_id(col: str = "k"):
    """The id of a key."""
    return F.when(F.col(col) != NULL_KEY, F.col(col)).alias("doc_id")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all nodes share.

    Where the setting is missing (tests, a single machine), one is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="kvlog-")
        found = _own[app]
    return found.rstrip("/")


@contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of each statement run inside are removed when it ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there.

    This cuts the lineage, so a lost executor never repeats what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kvlog_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables made by ``save`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_kvlog_path", None)
        if path is None:
            continue
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
