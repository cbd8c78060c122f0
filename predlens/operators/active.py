"""Active learning: the most uncertain predictions as a queue for annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def uncertainty(records: DataFrame, probs: str = "probs") -> DataFrame:
    """Scorable records with entropy, margin and uncertainty_score (4 digits); probs is an array or a map of them."""
    values = F.map_values(probs) if records.schema[probs].dataType.typeName() == "map" else F.col(probs)
    out = records.where(F.col(probs).isNotNull() & (F.coalesce(F.col("flag"), F.lit("")) != "ERROR"))
    out = out.withColumns({"_e": C.entropy(values), "_m": C.top_gap(values)})
    return out.withColumns({"entropy": F.round("_e", 4), "margin": F.round("_m", 4), "uncertainty_score": F.round(F.col("_e") * (1 - F.col("_m")), 4)}).drop("_e", "_m")


def queue(scored: DataFrame, n: int = 50) -> DataFrame:
    return scored.orderBy(F.desc("uncertainty_score"), "image_id").limit(n)


def breakdown(top: DataFrame) -> DataFrame:
    """Rows of the queue by predicted class."""
    return top.groupBy("pred_class").agg(F.count(F.lit(1)).alias("n"))


def summary(top: DataFrame) -> DataFrame:
    """One row: size of the queue, mean uncertainty and the estimated gain."""
    mean = F.coalesce(F.avg("uncertainty_score"), F.lit(0.0))
    return top.agg(F.count(F.lit(1)).alias("top_n"), F.round(mean, 4).alias("avg_uncertainty"), F.round(mean * 0.01, 4).alias("est_auc_gain"))
