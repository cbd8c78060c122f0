"""Fairness: the positive class's AUC by subgroup, and gaps between subgroups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import columns as C
from ..functions import stats


def with_demographics(records: DataFrame, metadata: DataFrame, columns=("sex", "age", "site")) -> DataFrame:
    """records with the columns that the metadata has, by image id."""
    there = [c for c in columns if c in metadata.columns]
    return records.drop(*there).join(metadata.select("image_id", *there), "image_id", "left")


def by_axes(records: DataFrame, axes=("sex", "age", "site"), cfg: Config = DEFAULT, score: str = "mel_prob", label: str = "human_label") -> DataFrame:
    """axis, group, n, auc of each subgroup, all axes in one pass; numeric ages go to bands. Rows lacking label or score are left
    out, and of each axis those lacking the group."""

    def group(axis: str) -> Column:
        bands = axis == "age" and records.schema[axis].dataType.typeName() != "string"
        return (C.age_band(axis) if bands else F.col(axis)).cast("string")

    own = F.array(*(F.struct(F.lit(a).alias("axis"), group(a).alias("group")) for a in axes))
    rows = records.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(F.explode(own).alias("x"), score, label).where(F.col("x.group").isNotNull())
    return stats.auc(rows.select("x.*", score, label), ["axis", "group"], score, F.col(label) == cfg.positive).select("axis", "group", "n", "auc")


def by_axis(records: DataFrame, axis: str, cfg: Config = DEFAULT, score: str = "mel_prob", label: str = "human_label") -> DataFrame:
    """by_axes of one axis."""
    return by_axes(records, (axis,), cfg, score, label)


def axis_status(records: DataFrame, axes=("sex", "age", "site")) -> DataFrame:
    """Whether an axis can be judged: metadata_unavailable, labels_unavailable, no_data or ok."""
    spark, labelled = records.sparkSession, {"human_label", "mel_prob"} <= set(records.columns)
    known = [a for a in axes if a in records.columns]
    fixed = [(a, "metadata_unavailable" if a not in known else "labels_unavailable") for a in axes if a not in known or not labelled]
    parts = [spark.createDataFrame(fixed, "axis string, status string")] if fixed else []
    if labelled and known:
        counts = records.agg(*(F.count_if(F.col(a).isNotNull() & F.col("human_label").isNotNull() & F.col("mel_prob").isNotNull()).alias(a) for a in known))
        parts.append(counts.unpivot([], known, "axis", "n").select("axis", F.when(F.col("n") > 0, "ok").otherwise("no_data").alias("status")))
    return reduce(DataFrame.unionByName, parts)


def disparities(groups: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Axes whose largest gap between valid AUCs is over its threshold, with the worst group."""
    limit = F.coalesce(C.lookup("axis", cfg.gaps), F.lit(0.05))
    valid = groups.where(F.col("auc").isNotNull()).groupBy("axis").agg(
        F.count(F.lit(1)).alias("k"), (F.max("auc") - F.min("auc")).alias("_gap"), F.min(F.struct("auc", "group")).alias("_worst")
    )
    out = valid.where((F.col("k") >= 2) & (F.col("_gap") > limit))
    return out.select("axis", F.round("_gap", 4).alias("gap"), limit.alias("threshold"), F.col("_worst.group").alias("worst"), F.col("_worst.auc").alias("worst_auc"), F.when(F.col("_gap") > limit * 2, "HIGH").otherwise("MEDIUM").alias("severity"))
