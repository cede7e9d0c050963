"""Size of the record batches that pass between Spark and Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: A batch is in memory a few times over (Spark's buffers, Arrow's copies, what is made of it), for every running task.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on a batch to BATCH_BYTES; the default is eight times that."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
