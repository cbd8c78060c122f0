"""The scheduled monitors as event-time streams, and a sink whose rows do not depend on how input falls into turns.

Every week is a window of the records' own times. A week is given out once, when the watermark has passed its end; a row that comes
after that is dropped by the engine and counted in the query's progress (late_rows).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, Config
from ..operators import calibrate, drift, papers

WEEK = "7 days"


def windowed(stream: DataFrame, time: str, late: str, every: str = WEEK) -> DataFrame:
    """Adds the window of a row's time, under a watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).withColumn("window", F.window(time, every))


def _starts(out: DataFrame) -> DataFrame:
    return out.select(F.col("window.start").alias("week"), *(c for c in out.columns if c != "window"))


def weekly_calibration(stream: DataFrame, time: str = "ts", late: str = "2 days", every: str = WEEK, temperature: float | None = None, cfg: Config = DEFAULT, digits: int = 4) -> DataFrame:
    """The calibration report of each week: bins, ECE, over-confidence and the recommended temperature. One state row a week."""
    return _starts(calibrate.report_once(windowed(stream, time, late, every), ["window"], temperature, cfg, digits=digits))


def weekly_papers(*feeds: DataFrame, time: str = "ts", late: str = "2 days", every: str = WEEK, order: tuple[str, ...] = ()) -> DataFrame:
    """The papers of all feeds by week, each title once a week whichever feed brings it: the first feed's, then the first by order.

    Feeds share one watermark, that of the slowest. A state row for each title of an open week; which paper stays does not depend on
    the order in which they come. Ranks by papers.rank_within over what is written.
    """
    each = papers.union(*(f.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) for f in feeds))
    return _starts(papers.first_by_window(each.withColumn("window", F.window(time, every)), "window", "feed_no", *order))


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query has dropped because they came after the watermark."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def write_turn(df: DataFrame, turn: int, path: str, column: str = "turn") -> None:
    """The rows of one turn as the partition of that number, and no other: a turn that is run again after a failure replaces itself."""
    df.withColumn(column, F.lit(turn)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def drift_sums(records: DataFrame, by: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """What a drift report needs of some of a batch's records, so that parts can be added up: counts of classes and of low confidences,
    and the sums of the confidence and of its square."""
    conf = F.col("confidence_score") / 10
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_images"), *(F.count_if(F.col("pred_class") == c).alias(f"_{c}") for c in cfg.classes), F.count(conf).alias("_n"), F.coalesce(F.sum(conf), F.lit(0.0)).alias("_sum"),
        F.coalesce(F.sum(conf * conf), F.lit(0.0)).alias("_squares"), F.count_if(conf < cfg.floor).alias("_lows"),
    )


def drift_of_turns(sums: DataFrame, by: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """The drift report of all turns together, from their sums."""
    added = [c for c in sums.columns if c.startswith("_") or c == "n_images"]
    total = sums.groupBy(*by).agg(*(F.sum(c).alias(c) for c in added))
    mean, n = F.col("_sum") / F.col("_n"), F.greatest("_n", F.lit(1))
    spread = F.sqrt(F.greatest(F.col("_squares") / F.col("_n") - mean * mean, F.lit(0.0)))
    stats = total.withColumns({"_mean": F.coalesce(mean, F.lit(0.0)), "_std": F.coalesce(spread, F.lit(0.0)), "_low": F.col("_lows") / n})
    return drift.judged(stats, by, cfg)


def drift_by_turns(stream: DataFrame, path: str, by: list[str], cfg: Config = DEFAULT, checkpoint: str | None = None, then: Callable[[int], None] | None = None) -> StreamingQuery:
    """Adds the sums of each turn to the table at path, exactly once; drift_table() reads the reports. then(turn) runs after a turn."""

    def turn(df: DataFrame, n: int) -> None:
        write_turn(drift_sums(df, by, cfg), n, path)
        if then:
            then(n)

    writer = stream.writeStream.foreachBatch(turn).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def drift_table(spark: SparkSession, path: str, by: list[str], cfg: Config = DEFAULT) -> DataFrame:
    return drift_of_turns(spark.read.parquet(path).drop("turn"), by, cfg)
