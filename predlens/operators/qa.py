"""Annotation QA: predictions against human labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, FLAGS, Config
from ..functions import columns as C
from .curate import last_wins


def human_labels(records: DataFrame, labels: DataFrame, image: str = "image", label: str = "dx", order: str | None = None) -> DataFrame:
    """Adds human_label: the label of the file's stem, else of its full name. Of several for one key the last by the order column
    counts; without one, rows of a file have no order, and it is the greatest label."""
    table = labels.select(F.col(image).alias("_key"), F.col(label).alias("_label"), F.col(order or label).alias("_n"))
    table = last_wins(table, "_key", "_label", "_n")
    out = records.join(table.toDF("_stem", "_a"), C.stem("path") == F.col("_stem"), "left").join(table.toDF("_name", "_b"), C.base_name("path") == F.col("_name"), "left")
    return out.withColumn("human_label", F.coalesce(F.nullif("_a", F.lit("")), F.col("_b"))).drop("_stem", "_a", "_name", "_b")


def annotate(records: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Adds flag to records with probs (array), pred_class and human_label; a row without probs is an error row."""
    return records.withColumn("flag", C.qa_flag("probs", "pred_class", "human_label", cfg))


def flag_counts(records: DataFrame, by: list[str], flags=FLAGS) -> DataFrame:
    """A column for each flag, zero where none, and total."""
    counts = [F.count_if(F.col("flag") == f).alias(f.lower()) for f in flags]
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *counts)


def conflicts(records: DataFrame) -> DataFrame:
    return records.where(F.col("flag") == "ANNOTATION_CONFLICT")


def lowest_confidence(records: DataFrame, n: int = 50) -> DataFrame:
    return records.where(F.col("confidence_score").isNotNull()).orderBy("confidence_score", "image_id").limit(n)


def triage_counts(scans: DataFrame, by: list[str]) -> DataFrame:
    """total, flagged and review; error rows, without a verdict, are in total only."""
    return scans.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("verdict") == "CANCER_FLAGGED").alias("flagged"), F.count_if(F.col("verdict") == "REVIEW_REQUIRED").alias("review"))


def messages(counts: DataFrame) -> DataFrame:
    """Adds the messages of a digest to flag counts."""
    n = lambda c: F.col(c).cast("string")
    rules = (
        (F.col("annotation_conflict") > 0, F.concat(n("annotation_conflict"), F.lit(" annotation conflict(s)"))),
        (F.col("ambiguous") > 0, F.concat(n("ambiguous"), F.lit(" ambiguous case(s)"))),
        (F.col("low_confidence") > 0, F.concat(n("low_confidence"), F.lit(" low-confidence prediction(s)"))),
        ((F.col("ok") > 0) & (F.col("annotation_conflict") == 0), F.concat(n("ok"), F.lit(" passed without issues"))),
    )
    return counts.withColumn("messages", C.messages(*rules))
