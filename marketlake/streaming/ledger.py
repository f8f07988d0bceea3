"""Archive writes that may fail: a ledger of attempts beside the stream.

A batch first puts its rows in a folder of its own, then tries the write. Each attempt leaves one row in the status
table (completed, pending while attempts are left, failed after the last one); a write that fails
does not stop the stream, and ``retry`` takes the batches that are still pending. Everything
lies in folders named by batch and attempt, so a batch that Spark runs again overwrites what it left, and one that is
completed is not written twice. ``write(rows, batch)`` must itself be safe to repeat.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Attempts before a batch is given up.
ATTEMPTS = 5
STATUS = "status string, error string"
Write = Callable[[DataFrame, int], None]


def _begin(spark: SparkSession, path: str) -> None:
    """Partition folders for the readers, before there is any row."""
    spark.createDataFrame([], STATUS).write.mode("overwrite").parquet(f"{path}/status/batch=-1/attempt=0")


def attempts(spark: SparkSession, path: str) -> DataFrame:
    """(batch, attempt, status, error) of every attempt."""
    s = spark.read.schema(STATUS + ", batch long, attempt int").option("basePath", f"{path}/status").parquet(f"{path}/status")
    return s.select("batch", "attempt", "status", "error")


def status(spark: SparkSession, path: str) -> DataFrame:
    """(batch, attempts, status, error) as of each batch's last attempt."""
    a = attempts(spark, path)
    last = F.max_by(F.struct("status", "error"), "attempt").alias("_l")
    return a.groupBy("batch").agg(F.max("attempt").alias("attempts"), last).select("batch", "attempts", "_l.*")


def _attempt(spark: SparkSession, path: str, batch: int, number: int, write: Write, most: int) -> None:
    rows = spark.read.parquet(f"{path}/pending/batch={batch}")
    state, error = "completed", None
    try:
        write(rows, batch)
    except Exception as e:  # noqa: BLE001  whatever stops a write is recorded, and the batch stays
        state, error = ("failed" if number >= most else "pending"), f"{type(e).__name__}: {e}"[:500]
    spark.createDataFrame([(state, error)], STATUS).coalesce(1).write.mode("overwrite").parquet(f"{path}/status/batch={batch}/attempt={number}")


def recorded(spark: SparkSession, path: str, write: Write, most: int = ATTEMPTS) -> Write:
    """The function for ``foreachBatch``: one attempt for each batch, with its rows kept for more."""
    _begin(spark, path)

    def run(df: DataFrame, batch: int) -> None:
        s = df.sparkSession
        done = {r["batch"]: r for r in status(s, path).where(F.col("batch") == batch).collect()}  # one row
        if batch in done and done[batch]["status"] == "completed":
            return
        df.write.mode("overwrite").parquet(f"{path}/pending/batch={batch}")
        _attempt(s, path, batch, (done[batch]["attempts"] if batch in done else 0) + 1, write, most)

    return run


def retry(spark: SparkSession, path: str, write: Write, most: int = ATTEMPTS) -> int:
    """One more attempt for every pending batch; the number of those tried."""
    due = [(r["batch"], r["attempts"]) for r in status(spark, path).where("status = 'pending'").orderBy("batch").collect()]  # batches, not rows
    for batch, n in due:
        _attempt(spark, path, batch, n + 1, write, most)
    return len(due)
