"""Drift of batches of predictions against the training data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import columns as C

EPS = 1e-8


def class_shares(records: DataFrame, by: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """Share of every class among all records of a batch, error rows included in the number; n."""
    n = F.count(F.lit(1))
    shares = [(F.count_if(F.col("pred_class") == c) / n).alias(c) for c in cfg.classes]
    return records.groupBy(*by).agg(n.alias("n_images"), *shares)


def report(records: DataFrame, by: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """A row for each batch: KL divergence, confidence mean, deviation and shift, positive rate, flags and severity.

    One pass with partial aggregates; severity goes by the rounded divergence, the positive rate does not raise it.
    """
    n, conf = F.count(F.lit(1)), F.col("confidence_score") / 10
    counts = [F.count_if(F.col("pred_class") == c).alias(f"_{c}") for c in cfg.classes]
    stats = records.groupBy(*by).agg(
        n.alias("n_images"), *counts, F.coalesce(F.avg(conf), F.lit(0.0)).alias("_mean"), F.coalesce(F.stddev_pop(conf), F.lit(0.0)).alias("_std"),
        (F.count_if(conf < cfg.floor) / F.greatest(F.count(conf), F.lit(1))).alias("_low"),
    )
    return judged(stats, by, cfg)


def judged(stats: DataFrame, by: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """The report from n_images, counts of the classes, and mean, deviation and share of low values of the confidence."""
    share = {c: F.col(f"_{c}") / F.col("n_images") for c in cfg.classes}
    terms = [F.when(share[c] > 0, share[c] * F.log(share[c] / F.lit(max(cfg.train_shares.get(c, EPS), EPS)))).otherwise(0.0) for c in cfg.classes]
    mean, std = cfg.train_confidence
    out = stats.withColumns({"kl_divergence": F.round(reduce(lambda a, b: a + b, terms), 4), "_shift": F.abs(F.col("_mean") - mean) / max(std, 1e-6), "_rate": share[cfg.positive]})
    kl, shift, off = F.col("kl_divergence"), F.col("_shift"), F.abs(F.col("_rate") - cfg.train_shares[cfg.positive]) > cfg.rate_change
    flags = C.messages(
        (kl > cfg.kl_high, "HIGH_DISTRIBUTION_SHIFT"), ((kl > cfg.kl_medium) & (kl <= cfg.kl_high), "MODERATE_DISTRIBUTION_SHIFT"),
        (shift > cfg.shift, "CONFIDENCE_SHIFT"), (off, "MEL_RATE_ANOMALY"), (F.col("_low") > cfg.low_share, "HIGH_LOW_CONFIDENCE_RATE"),
    )
    by_shift = F.when(shift > cfg.shift, F.when(kl > cfg.kl_medium, "HIGH").otherwise("MEDIUM"))
    severity = F.coalesce(by_shift, F.when(kl > cfg.kl_high, "HIGH").when(kl > cfg.kl_medium, "MEDIUM").otherwise("OK"))
    return out.select(
        *by, "n_images", "kl_divergence", F.round("_mean", 4).alias("conf_mean"), F.round("_std", 4).alias("conf_std"), F.round("_shift", 2).alias("conf_shift_z"),
        F.round("_rate", 4).alias("mel_rate"), off.alias("mel_anomaly"), F.round("_low", 4).alias("low_conf_share"), flags.alias("flags"), severity.alias("severity"),
    )


def reference(records: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row that can stand for the training data: class shares, confidence mean and deviation."""
    conf = F.col("confidence_score") / 10
    return records.agg(*((F.count_if(F.col("pred_class") == c) / F.count(F.lit(1))).alias(c) for c in cfg.classes), F.avg(conf).alias("conf_mean"), F.stddev_pop(conf).alias("conf_std"))
