"""Calibration: confidence against accuracy on labelled predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config

# The edges of ten equal bins as doubles; 0.3, 0.6 and 0.7 lie just below theirs.
EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)


def evaluable(records: DataFrame) -> DataFrame:
    """Records with label, prediction and score, as conf (0 to 1) and acc (0 or 1)."""
    rows = records.where((F.length("human_label") > 0) & (F.length("pred_class") > 0) & F.col("confidence_score").isNotNull())
    return rows.withColumns({"conf": F.col("confidence_score") / 10, "acc": (F.col("pred_class") == F.col("human_label")).cast("double")})


def bin_of(conf: Column, include_one: bool = False) -> Column:
    """Number of the bin [low, high); a confidence of 1 is in none unless include_one."""
    out = None
    for i, (low, high) in enumerate(zip(EDGES, EDGES[1:], strict=False)):
        inside = (conf >= low) & ((conf < high) | (F.lit(include_one and i == 9) & (conf == high)))
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out


def bins(records: DataFrame, by: list[str] | None = None, include_one: bool = False) -> DataFrame:
    """Reliability table: bin, n, mean confidence and accuracy.

    The generator of one row keeps the filter on bins, which uses the confidence twenty times, above what computes it.
    """
    rows = evaluable(records).withColumn("conf", F.explode(F.array("conf"))).withColumn("bin", bin_of(F.col("conf"), include_one)).where("bin IS NOT NULL")
    return rows.groupBy(*(by or []), "bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("conf"), 4).alias("mean_conf"), F.round(F.avg("acc"), 4).alias("mean_acc"))


def report(records: DataFrame, by: list[str] | None = None, temperature: float | None = None, cfg: Config = DEFAULT, include_one: bool = False) -> DataFrame:
    """ECE, over-confidence and the recommended temperature; status insufficient_data below ten records.

    Bins are summed first, so the second aggregate sees eleven rows of a group.
    """
    by = by or []
    rows = evaluable(records).withColumn("bin", bin_of(F.col("conf"), include_one))
    sums = rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("conf").alias("c"), F.sum("acc").alias("a"))
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("a") - F.col("c")))
    total = sums.groupBy(*by).agg(F.sum("n").alias("n_eval"), F.coalesce(F.sum(gap), F.lit(0.0)).alias("_gap"), F.sum("c").alias("_c"), F.sum("a").alias("_a"))
    return _judged(total, by, temperature, cfg)


def report_once(records: DataFrame, by: list[str], temperature: float | None = None, cfg: Config = DEFAULT, include_one: bool = False, digits: int = 4) -> DataFrame:
    """The rows of report by one aggregate, whose buffer holds the sums of all bins: for streams, which keep one state a group. digits: of
    its shares."""
    rows = evaluable(records).withColumn("bin", bin_of(F.col("conf"), include_one))
    surplus = [F.coalesce(F.sum(F.when(F.col("bin") == i, F.col("acc") - F.col("conf"))), F.lit(0.0)).alias(f"_b{i}") for i in range(len(EDGES) - 1)]
    total = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_eval"), *surplus, F.sum("conf").alias("_c"), F.sum("acc").alias("_a"))
    return _judged(total.withColumn("_gap", reduce(lambda x, y: x + y, (F.abs(f"_b{i}") for i in range(len(EDGES) - 1)))), by, temperature, cfg, digits)


def _judged(total: DataFrame, by: list[str], temperature: float | None, cfg: Config, digits: int = 4) -> DataFrame:
    """The report of n_eval, the summed gaps of the bins, and sums of confidence and accuracy."""
    t = cfg.temperature if temperature is None else temperature
    total = total.withColumns({"_ece": F.col("_gap") / F.col("n_eval"), "_conf": F.col("_c") / F.col("n_eval"), "_acc": F.col("_a") / F.col("n_eval")})
    over, enough = F.col("_conf") - F.col("_acc"), F.col("n_eval") >= 10
    value = lambda c: F.when(enough, c)
    new_t = F.when(over > cfg.over_step, F.round(F.lit(t * 1.1), 4)).when(over < -cfg.over_step, F.round(F.lit(t * 0.9), 4)).otherwise(F.lit(t))
    return total.select(
        *by, "n_eval", value(F.round("_ece", digits)).alias("ece"), value(F.round("_conf", digits)).alias("mean_conf"), value(F.round("_acc", digits)).alias("mean_acc"), value(F.round(over, digits)).alias("overconfidence"),
        value((F.col("_ece") > cfg.ece_limit) | (F.abs(over) > cfg.over_limit)).alias("needs_recal"), F.lit(t).alias("current_t"), value(new_t).alias("recommended_t"),
        value(F.when(over > cfg.over_step, "increase temperature").when(over < -cfg.over_step, "decrease temperature").otherwise("no recalibration needed")).alias("recommendation"),
        F.when(enough, "ok").otherwise("insufficient_data").alias("status"),
    )


def by_class(records: DataFrame, least: int = 3) -> DataFrame:
    """Confidence against accuracy of each predicted class with enough records."""
    rows = evaluable(records).groupBy("pred_class").agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("c"), F.avg("acc").alias("a"))
    return rows.where(F.col("n") >= least).select("pred_class", "n", F.round("c", 4).alias("mean_conf"), F.round("a", 4).alias("mean_acc"), F.round(F.col("c") - F.col("a"), 4).alias("overconfidence"))
