"""The answer log and the event table as streams. An extension: batch runs don't need it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _timed(stream: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a timestamp with zone; one without is read in the session's."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def first_of_each(stream: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """The rows without repeats of a key within the watermark; state is dropped once the delay has passed."""
    return _timed(stream, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def counts_per_window(stream: DataFrame, ts: str, by: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Rows and sum of ``value`` per window and ``by``, final once the watermark has passed the window."""
    return _timed(stream, ts).withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def keep_latest(stream: DataFrame, key: str, order: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Writes the log to ``path``, one folder per micro-batch; a batch that is run again overwrites its own folder, so nothing is written twice."""

    def write(batch: DataFrame, epoch: int) -> None:
        from coursewright.operators.sync import last_per_key

        last_per_key(batch, key, order).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
