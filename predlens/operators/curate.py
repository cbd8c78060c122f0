"""Dataset curation: labels from several sources to one table without duplicates, split by group."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schemas import IMAGE_RECORD


def normalise_names(df: DataFrame, ids: tuple[str, ...] = ("image_name", "image", "image_id"), renames: dict[str, str] | None = None) -> DataFrame:
    """Lower-case column names; the first of the id names that is there becomes image_id; renames apply where present."""
    out = df.toDF(*(c.lower() for c in df.columns))
    found = next((c for c in ids if c in out.columns), None)
    if found and found != "image_id":
        out = (out.drop("image_id") if "image_id" in out.columns else out).withColumnRenamed(found, "image_id")
    renames = {"age_approx": "age", "anatom_site_general_challenge": "site", "anatom_site_general": "site"} if renames is None else renames
    for old, new in renames.items():
        if old in out.columns and new not in out.columns:
            out = out.withColumnRenamed(old, new)
    return out


def align(df: DataFrame) -> DataFrame:
    """The columns of an image record in order; those that are missing are null."""
    fields = [f.split() for f in IMAGE_RECORD.split(", ")]
    return df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(kind).alias(n) for n, kind in fields))


def with_class(df: DataFrame, classes) -> DataFrame:
    """Drops rows without a label and adds the label's number."""
    return df.where(F.col("label").isNotNull()).withColumn("label_idx", C.class_index("label", classes))


def normalise_onehot(df: DataFrame, mapping: dict, dataset: str, source: str, classes, metadata: DataFrame | None = None, unknown: tuple[str, ...] = ("UNK",)) -> DataFrame:
    """Image records from one 0/1 column a class; rows whose maximum is 0 have no label and go.

    Metadata joins by image; a missing lesion id is replaced by the image, so unknown patients stay apart.
    """
    names = [c for c in df.columns if c not in ("image", *unknown)]
    out = df.withColumn("label", C.remap(C.onehot_label(names), mapping))
    if metadata is not None:
        out = out.join(metadata.select(*(c for c in metadata.columns if c == "image" or c not in out.columns)), "image", "left")
    patient = C.patient_key("lesion_id", "image") if "lesion_id" in out.columns else F.col("image")
    out = out.withColumns({"image_id": F.col("image"), "image_path": F.concat("image", F.lit(".jpg")), "patient_id": patient, "dataset": F.lit(dataset), "source": F.lit(source)})
    return align(with_class(normalise_names(out.drop("image")), classes))


def normalise_binary(df: DataFrame, mapping: dict, dataset: str, source: str, classes) -> DataFrame:
    """Image records from a diagnosis with a 0/1 target to fall back on."""
    out = df.withColumns({
        "label": C.diagnosis_label("diagnosis", "target", mapping),
        "patient_id": F.coalesce("patient_id", "image_name"),
        "image_path": F.concat("image_name", F.lit(".jpg")),
        "dataset": F.lit(dataset),
        "source": F.lit(source),
    })
    return align(with_class(normalise_names(out), classes))


def with_file(records: DataFrame, files: DataFrame, key: str = "image_id") -> DataFrame:
    """Rows whose image is among the listed files: one semi join in place of a look at the disk for each row."""
    stems = files.select(C.stem("path").alias("_stem"))
    return records.join(stems, records[key] == F.col("_stem"), "left_semi")


def merge(frames: list[DataFrame]) -> DataFrame:
    """Union by name; the place in the list is the priority of a row."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (f.withColumn("priority", F.lit(i)) for i, f in enumerate(frames)))


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order: an aggregate with partial results, so a key of very many rows is no task."""
    rest = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(first.alias("_row")).select(key, *(F.col("_row")[c].alias(c) for c in rest)).select(*df.columns)


def last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def group_split(df: DataFrame, key: str, share: float = 0.2, seed: int = 42, exact: bool = False) -> DataFrame:
    """Adds split: `val` for a share of the groups, else `train`; a group is never in both.

    By a hash of the key alone, without a shuffle. exact: ceil(share * groups) groups, those whose keys have the smallest md5 with the seed,
    found by a histogram of hash buckets and a cut within one of them.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    if not exact:
        return df.withColumn("split", F.when(F.pmod(F.xxhash64(name, F.lit(seed)), F.lit(10_000)) < int(share * 10_000), "val").otherwise("train"))
    h = F.substring(F.md5(F.concat(name, F.lit(f"|{seed}"))), 1, 15)
    groups = df.select(F.col(key).alias("_k"), h.alias("_h")).distinct().withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    sizes = groups.groupBy("_b").count().orderBy("_b").collect()  # at most 65536 buckets
    left, cut = math.ceil(share * sum(r[1] for r in sizes)), 0
    for cut, n in sizes:
        if n >= left:
            break
        left -= n
    inside = groups.where(F.col("_b") == cut).withColumn("_n", F.row_number().over(W.partitionBy("_b").orderBy("_h", "_k")))
    chosen = groups.where(F.col("_b") < cut).select("_k").unionByName(inside.where(F.col("_n") <= left).select("_k")) if sizes else groups.select("_k")
    chosen = chosen.withColumn("_val", F.lit(True))
    return df.join(chosen, df[key].eqNullSafe(chosen["_k"]), "left").withColumn("split", F.when(F.col("_val"), "val").otherwise("train")).drop("_k", "_val")


def leaks(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Number of groups in more than one split: one row."""
    sides = df.groupBy(key).agg((F.min(split) != F.max(split)).alias("both"))
    return sides.agg(F.count_if("both").alias("leaking_groups"))


def distribution(df: DataFrame, label: str = "label", split: str | None = None) -> DataFrame:
    """Rows of each label and, with a split, of each split; null in split: all."""
    if split is None:
        return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return df.groupingSets([[F.col(label), F.col(split)], [F.col(label)]], label, split).agg(F.count(F.lit(1)).alias("n"))


def distributions(df: DataFrame, axes: list[str], sets: list[list[str]] | None = None, **measures: Column) -> DataFrame:
    """axes, level, n and measures over several groupings in one aggregate: each of the sets, or all subsets of the axes.

    level tells the grouping: the sum of 2**i for each axis i, counted from the last, that is summed over; so a null value of an axis
    is told from "all".
    """
    every = [[c for i, c in enumerate(axes) if not m >> (len(axes) - 1 - i) & 1] for m in range(2 ** len(axes))]
    grouped = df.groupingSets([[F.col(c) for c in s] for s in (every if sets is None else sets)], *axes)
    return grouped.agg(F.grouping_id(*axes).alias("level"), F.count(F.lit(1)).alias("n"), *(m.alias(k) for k, m in measures.items())).select(*axes, "level", "n", *measures)


def zero_filled(df: DataFrame, by: list[str], label: str, classes) -> DataFrame:
    """Counts of every class for each `by`, also of classes that don't occur."""
    counts = df.groupBy(*by).pivot(label, list(classes)).agg(F.count(F.lit(1)))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias(label), F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias("n")) for c in classes)))
    return counts.select(*by, pairs.alias("_p")).select(*by, f"_p.{label}", "_p.n")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Inverse frequencies of the labels, the rarest with 1.0."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(label, "n", F.round(F.min("n").over(W.partitionBy()) / F.col("n"), 4).alias("weight"))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Percent of rows that have a value, a row for each column."""
    row = df.agg(*(F.round(F.avg(F.col(c).isNotNull().cast("double")) * 100, 2).alias(c) for c in columns))
    return row.unpivot([], columns, "column", "percent")
