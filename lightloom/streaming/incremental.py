"""Results appended as files arrive: Structured Streaming over growing folders.

Each run takes what is new since the last one (the checkpoint remembers which files were done), so a job that was
stopped goes on where it was, and no file is done twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def new_files(spark: SparkSession, path: str, schema: StructType | str, format: str = "parquet", pattern: str | None = None, per_batch: int = 1000, **options) -> DataFrame:
    """A stream of the rows of files under ``path`` as they appear, at most ``per_batch`` files a batch."""
    reader = spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", per_batch).options(**options)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def drain(stream: DataFrame, sink: str, checkpoint: str, format: str = "parquet", mode: str = "append", **options) -> None:
    """Runs ``stream`` over all there is now, and appends its rows to ``sink``; returns when it is through."""
    query = stream.writeStream.format(format).outputMode(mode).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start(sink)
    query.awaitTermination()


def drain_by(stream: DataFrame, step: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, by: str | None = None) -> None:
    """As drain, with ``step`` over each batch as a plain DataFrame (joins, models, sorts); ``by`` splits the sink into a
    folder a value. A batch is written into its own folder, over what a run that broke off left there, so it counts once."""

    def write(batch: DataFrame, number: int) -> None:
        out = step(batch).write.mode("overwrite")
        (out.partitionBy(by) if by else out).parquet(f"{sink}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain_totals(stream: DataFrame, sink: str, checkpoint: str) -> str | None:
    """Runs an aggregated stream over all there is now; each batch writes the whole table of totals into its own folder.
    Returns the newest folder, or None if there was nothing to read."""
    written = []

    def write(batch: DataFrame, number: int) -> None:
        written.append(f"{sink}/batch={number}")
        batch.write.mode("overwrite").parquet(written[-1])

    stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return written[-1] if written else None


def windowed(stream: DataFrame, time: str, width: str, keys: list[str], value: str, late: str = "1 day", slide: str | None = None) -> DataFrame:
    """(keys, start, n, mean, low, high) of each window of event time; slide: windows that overlap.

    In append mode rows later than ``late`` behind the newest are dropped, and a window comes out once it is past that;
    drain_totals drops nothing. State holds sums a key and window, not rows.
    """
    plain = stream.schema[time].dataType.typeName() == "timestamp_ntz"  # watermarks need an instant: read as UTC, whatever the session's zone
    if plain:
        stream = stream.withColumn(time, F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, {EPOCH}, `{time}`))"))
    at = F.window(time, width, slide) if slide else F.window(time, width)
    out = stream.withWatermark(time, late).groupBy(at.alias("w"), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    start = F.expr(f"timestampadd(MICROSECOND, unix_micros(w.start), {EPOCH})") if plain else F.col("w.start")
    return out.select(*keys, start.alias("start"), "n", "mean", "low", "high")
