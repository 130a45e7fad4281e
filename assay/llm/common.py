"""What the operators of this package share: where intermediate tables go, and how."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_cleaned: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode a new one where it is unset."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="assay-"))


def _clean_at_exit(spark: SparkSession, folder: str) -> None:
    if folder in _cleaned:
        return
    _cleaned.add(folder)
    path, conf = spark._jvm.org.apache.hadoop.fs.Path(folder), spark.sparkContext._jsc.hadoopConfiguration()

    def clean() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            path.getFileSystem(conf).delete(path, True)

    atexit.register(clean)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again.

    This cuts the lineage: what comes after depends on files that outlive any
    executor, sees the written sizes as statistics, and never recomputes ``df``.
    The application's folder goes when the driver ends.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    _clean_at_exit(spark, folder)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table written by :func:`cut` that nothing will read again."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under names of our own, so that other columns cannot clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def whole_text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once: what a lambda's body names from outside is otherwise computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
