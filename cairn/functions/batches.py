"""Bounds of the Arrow batches in which contents reach Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch: contents are large, and JVM and Python hold some copies of a batch of each task.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Lower the session's Arrow batches to BATCH_BYTES where they are larger; a row is never split."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return spark
