"""The shared folder of a session, and tables materialised in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where a local session has none (tests, one machine) one is made and set."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="skillweave-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(at)
    return at


def materialise(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage by a reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows and bytes of an Arrow batch at most, where Python holds whole texts and what was found in them.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what the session hands Python at once; smaller bounds of the session stay.  Spark reads both when a plan runs."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
