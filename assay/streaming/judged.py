"""Judgments in Structured Streaming.

The functions are ordinary columns, so a stream needs nothing special; these
helpers run one to the end of its input and keep what it pays for exactly once
per micro-batch: the sink's checkpoint decides which batches are run. Results,
checkpoint and state are in the folder that driver and executors share, never
in the driver's memory; they go when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream of the Parquet table ``name`` in ``folder``, which is a file or a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if status.isDirectory():
        return reader.parquet(f"{folder}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, or in local mode under the temp folder where that is unset."""
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base:
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}"
    folder = f"{base.rstrip('/')}/assay-stream-{uuid.uuid4().hex}"

    def clean() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            _delete(spark, folder)

    atexit.register(clean)
    return folder


_STATE = "spark.sql.streaming.stateStore.providerClass"
_ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that the stream gives for the input there is now, as a table of Parquet files.

    A micro-batch has a folder of its own, which replaces what a failed try of it
    has left; in mode ``complete`` the last one is the result. State is kept on
    the executors' disks.
    """
    spark = stream.sparkSession
    folder, done = _folder(spark), []

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/{batch}")
        if mode == "complete":
            for old in done:
                _delete(spark, old)
            done.clear()
        done.append(f"{folder}/rows/{batch}")

    writer = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    before = spark.conf.get(_STATE)
    spark.conf.set(_STATE, _ON_DISK)
    try:
        query = writer.start()
    finally:
        spark.conf.set(_STATE, before)
    query.awaitTermination()
    _delete(spark, f"{folder}/checkpoint")
    return spark.read.schema(stream.schema).parquet(*done) if done else spark.createDataFrame([], stream.schema)
