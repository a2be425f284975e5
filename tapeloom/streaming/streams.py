"""Structured Streaming. SURVEY SR1-SR7, AG51, WN10; event-time windows are an extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapeloom.functions.names import name_key
from tapeloom.sources.readers import log_events
from tapeloom.sources.writers import signature


def annotate_stream(spark: SparkSession, source: str, schema: str, annotate: Callable[[DataFrame], DataFrame], out: str, config: dict, per_chunk: int = 1) -> StreamingQuery:
    """SR1, SR2, SK2: annotates files of new rows chunk by chunk and appends each finished chunk as JSON lines; a restart goes on after the last finished one.

    Output and checkpoint lie in a folder named by the configuration's signature, so other settings start anew. Repeated texts are annotated once (SR7).
    """
    sig = signature(config)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_chunk).parquet(source).dropDuplicates(["text"])
    return annotate(rows).writeStream.format("json").option("checkpointLocation", f"{out}/{sig}/_checkpoint").trigger(availableNow=True).start(f"{out}/{sig}/records")


def run_progress(records: DataFrame, pool: DataFrame) -> DataFrame:
    """AG51, SR3: annotated rows of a pool (one row: pool_size, elapsed seconds), shares of good rows and of those asked again, rows a second, and seconds left at this rate."""
    one = records.agg(F.count("*").alias("annotated"), F.round(F.avg(F.col("ok").cast("double")), 9).alias("ok_rate"), F.round(F.avg((F.col("n_rounds") > 1).cast("double")), 9).alias("retry_rate")).join(F.broadcast(pool))
    rate = F.try_divide(F.col("annotated"), F.col("elapsed"))
    return one.select("annotated", "pool_size", "ok_rate", "retry_rate", F.round(rate, 12).alias("rate_per_s"), F.round(F.try_divide(F.col("pool_size") - F.col("annotated"), rate), 3).alias("eta_s"))


def run_labels(records: DataFrame, by: list[str]) -> DataFrame:
    """AG51: labels given so far, by kind and the columns `by`."""
    return records.select(*by, F.explode("entities").alias("e")).groupBy(*by, F.upper(name_key(F.col("e.label"))).alias("label")).agg(F.count("*").alias("n"))


def last_values(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """WN10: the last n rows by the columns `by`; each task keeps no more before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """SR4: events of log files as they grow by new files."""
    return log_events(spark.readStream.text(folder))


def event_windows(events: DataFrame, width: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Extension: counts and sums of events by window and type, with a watermark; batch tables work as well."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    ts = ts.withWatermark("ts", late) if events.isStreaming else ts
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return ts.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Extension: sessions of users."""
    s = F.session_window(F.col("ts").cast("timestamp"), gap)
    return events.groupBy(s.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def first_texts(rows: DataFrame, late: str | None = None) -> DataFrame:
    """SR7: of rows with the same text only the first to arrive; with a watermark on ts the state is bounded."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["text"]) if late else rows.dropDuplicates(["text"])
