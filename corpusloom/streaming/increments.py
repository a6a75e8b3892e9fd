"""Structured Streaming over growing folders: what batch operators do, load by load."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.scratch import Scratch
from corpusloom.sources.sinks import append_missing


def append_new(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str, change: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Bring what is new in a folder of Parquet files to ``target``, each key once, and stop; a rerun takes up where the last ended."""
    rows = change(spark.readStream.schema(schema).parquet(source))
    return rows.writeStream.foreachBatch(lambda df, _: append_missing(spark, df, target, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, by: str, length: str, late: str) -> DataFrame:
    """Rows a window and value; what comes later than ``late`` after the newest event is dropped by the watermark."""
    t = F.col(at).cast("timestamp").alias("__t")
    return events.select(t, by).withWatermark("__t", late).groupBy(F.window("__t", length), by).agg(F.count(F.lit(1)).alias("rows")).select(F.col("window.start").alias("start"), by, "rows")


def counted_windows(spark: SparkSession, source: str, at: str, by: str, length: str) -> DataFrame:
    """``(start, by, rows)``: rows a window and value of all files below a folder (or of one), counted by a stream that stops when it has seen them.

    However late a row comes it is counted, so the state is a row a window and
    value; each batch replaces the table that is returned.  Null times are in no window.
    """
    schema = spark.read.parquet(source).schema
    scratch = Scratch(spark, "windows")
    folder, name = source.rstrip("/").rsplit("/", 1)
    fs, place = scratch._place(source)
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if fs.getFileStatus(place).isFile() else spark.readStream.schema(schema).parquet(source)
    t = F.col(at).cast("timestamp").alias("__t")
    counts = events.select(t, by).where("__t is not null").groupBy(F.window("__t", length), by).agg(F.count(F.lit(1)).alias("rows")).select(F.col("window.start").alias("start"), by, "rows")
    out = f"{scratch.root}/counts"
    counts.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{scratch.root}/state").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(counts.schema).parquet(out)
    return done.withColumn("start", F.col("start").cast(schema[at].dataType))
