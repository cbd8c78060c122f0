"""Streaming forms of the monitors. Stateless parts are the batch functions; state has a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, FLAGS, Config
from ..operators import drift, qa, questions, score


def drops(spark: SparkSession, path: str, schema: str, kind: str = "json", per_trigger: int = 1000) -> DataFrame:
    """Files as they are dropped into a folder."""
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", per_trigger).load(path)


def qa_on_upload(stream: DataFrame, temperature: float = 1.0, cfg: Config = DEFAULT) -> DataFrame:
    """Predictions and flags of uploaded logits; stateless."""
    return qa.annotate(score.predict(stream, temperature=temperature, cfg=cfg), cfg)


def running_flag_counts(stream: DataFrame, flags=FLAGS) -> DataFrame:
    """Counts by batch so far; for update or complete mode."""
    return qa.flag_counts(stream, ["batch_id"], flags)


def drift_after_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], by: list[str], cfg: Config = DEFAULT, checkpoint: str | None = None) -> StreamingQuery:
    """A drift report of every micro-batch goes to the sink; sinks see a batch number and can drop repeats."""
    writer = stream.writeStream.foreachBatch(lambda df, n: sink(drift.report(df, by, cfg), n)).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def daily_drift(stream: DataFrame, late: str = "2 days", every: str = "1 day", cfg: Config = DEFAULT) -> DataFrame:
    """Class shares of event-time windows; a window closes when the watermark has passed it."""
    out = drift.class_shares(stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("window", F.window("ts", every)), ["window"], cfg)
    return out.select(F.col("window.start").alias("window_start"), *(c for c in out.columns if c != "window"))


def first_of_content(stream: DataFrame, digest: str = "md5", time: str = "ts", within: str = "1 day") -> DataFrame:
    """Rows whose digest was not seen within the watermark."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([digest])


def rolling_flagged(scans: DataFrame, length: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Flagged scans in sliding windows."""
    rows = scans.where(F.col("verdict") == "CANCER_FLAGGED").withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    out = rows.groupBy(F.window("timestamp", length, slide).alias("w")).agg(F.count(F.lit(1)).alias("flagged"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "flagged")


def dashboard(scans: DataFrame, name: str, every: str | None = "30 seconds") -> StreamingQuery:
    """Scan statistics kept up to date in a memory table; every None: once over what is there."""
    writer = questions.scan_stats(scans).writeStream.outputMode("complete").format("memory").queryName(name)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def alerts_of(reports: DataFrame) -> DataFrame:
    """Alert rows of drift reports that are not OK."""
    key = F.concat_ws("-", F.lit("drift"), F.col("batch_id").cast("string"))
    return reports.where(F.col("severity") != "OK").select(key.alias("id"), F.concat(F.lit("Drift "), "severity").alias("title"), F.concat_ws("; ", "flags").alias("body"), "severity", F.lit(False).alias("read"))
