"""Ingest checks of image files, and the same checks on any content column. Nothing is deleted: the result is a plan."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..config import DEFAULT, Config
from ..functions import columns as C
from ..sources.io import IMAGE_SUFFIXES, decoded_images, image_files, listed, shared_dir, store_of

#: Folders that Spark's sources list and read at once, and what opening a file counts as, in bytes: small files then share a task.
FOLDERS_AT_ONCE, OPEN_COST = 64, 1 << 16
#: Folders that a task lists and reads by itself, and files whose facts it gives back at once.
FOLDERS_A_TASK, FILES_A_BATCH = 4, 1000
FACTS = "path string, md5 string, height int, width int, saturation double, brightness double"
#: How the files begin that Java's ImageIO, by which Spark's image source decodes, may take for images: JPEG, PNG, GIF, BMP, TIFF, WBMP.
HEADS = (b"\xff\xd8", b"\x89PNG", b"GIF8", b"BM", b"II", b"MM", b"\0")


def _means(px: np.ndarray) -> tuple[float, float]:
    """Mean saturation and value (0 to 255) of rows of one or more channels."""
    channels = [np.ascontiguousarray(c) for c in px[:, :3].T]  # by channel: along rows of three it is much slower
    top, low = reduce(np.maximum, channels), reduce(np.minimum, channels)
    return float((np.divide(top - low, np.maximum(top, 1), dtype=np.float64) * 255).mean()), float(top.mean(dtype=np.float64))


@F.pandas_udf(StructType([StructField("saturation", DoubleType()), StructField("brightness", DoubleType())]))
def pixel_means(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Mean saturation and value (0 to 255) of pixel bytes with 3 or 4 interleaved channels, blue first; grey has saturation 0."""
    for data, channels in batches:
        out = [(None, None) if raw is None or not c or c < 1 else _means(np.frombuffer(raw, np.uint8).reshape(-1, c)) for raw, c in zip(data, channels, strict=True)]
        yield pd.DataFrame(out, columns=["saturation", "brightness"], dtype="float64")


def plain_bitmap(raw: bytes) -> np.ndarray | None:
    """Height x width x 3 bytes, blue first, of a whole bitmap with 24 bits a pixel, uncompressed and the lowest row first; None for all else."""
    if len(raw) < 54 or not raw.startswith(b"BM"):
        return None
    size, _, begin, head, width, height, planes, bits, packed, count = struct.unpack_from("<IIIIiiHHII", raw, 2)
    row = (3 * width + 3) // 4 * 4
    if min(width, height) < 1 or (begin, head, planes, bits, packed) != (54, 40, 1, 24, 0) or count != row * height or not size == len(raw) == 54 + count:
        return None
    return np.frombuffer(raw, np.uint8, count, 54).reshape(height, row)[::-1, : 3 * width].reshape(height, width, 3)


def duplicates(files: DataFrame, digest: str = "md5", path: str = "path") -> DataFrame:
    """Adds duplicate_of: the first path of the same digest, null for that path itself and without a digest.

    First paths come from partial minima; only digests that occur twice are joined back.
    """
    groups = files.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(path).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    out = files.join(groups, digest, "left")
    return out.withColumn("duplicate_of", F.when(F.col("_first") != F.col(path), F.col("_first"))).drop("_first")


def rename_plan(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds clean_name (lower case, no blanks) and rename_to: null unless the name changes and the target is free.

    Of several files that would get one name the first by path does.
    """
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    out = files.withColumn("clean_name", C.clean_name(C.base_name(path))).withColumn("_target", F.concat(folder, "clean_name"))
    wanted = out.where(F.col("_target") != F.col(path)).groupBy("_target").agg(F.min(path).alias("_by"))
    free = wanted.join(files.select(F.col(path).alias("_target")), "_target", "left_anti")
    out = out.join(free.toDF("_free", "_by"), (F.col("_target") == F.col("_free")) & (F.col(path) == F.col("_by")), "left")
    return out.withColumn("rename_to", F.when(F.col("_by").isNotNull(), F.col("_target"))).drop("_target", "_free", "_by")


def issues(files: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Adds issues and action to files with height, width, duplicate_of, saturation, brightness and rename_to.

    A corrupt file (height -1 or null) has that issue alone.
    """
    bad = F.coalesce(F.col("height") < 0, F.lit(True))
    least, most = F.least("height", "width"), F.greatest("height", "width")
    found = C.messages(
        (least < cfg.min_side, "too_small"), (most > cfg.max_side, "too_large"), (F.col("duplicate_of").isNotNull(), F.concat(F.lit("duplicate_of:"), F.col("duplicate_of"))),
        (F.col("saturation") < cfg.grey, "ood:near_grayscale"), (F.col("brightness") < cfg.black, "ood:near_black"), (F.col("brightness") > cfg.white, "ood:near_white"),
        (F.col("rename_to").isNotNull(), "renamed"),
    )
    out = files.withColumn("issues", F.when(bad, F.array(F.lit("corrupt"))).otherwise(found))
    action = F.when(F.size("issues") == 0, "clean").when(bad, "remove").when(F.col("duplicate_of").isNotNull(), "remove_duplicate").otherwise("flag")
    return out.withColumn("action", action)


def report(checked: DataFrame) -> DataFrame:
    """One row: files by issue, clean, issue_count (too large and renamed don't count) and ready (all but corrupt and duplicates)."""
    has = lambda p: F.count_if(F.exists("issues", lambda x: x.startswith(p)))
    kinds = {"corrupt": "corrupt", "duplicates": "duplicate_of", "too_small": "too_small", "too_large": "too_large", "ood_flagged": "ood:", "renamed": "renamed"}
    out = checked.agg(F.count(F.lit(1)).alias("total"), *(has(p).alias(k) for k, p in kinds.items()), F.count_if(F.size("issues") == 0).alias("clean_count"))
    return out.withColumns({
        "issue_count": F.col("corrupt") + F.col("duplicates") + F.col("too_small") + F.col("ood_flagged"),
        "ready_count": F.col("total") - F.col("corrupt") - F.col("duplicates"),
    })


def facts(files: DataFrame, images: DataFrame) -> DataFrame:
    """path, md5, height, width, saturation and brightness of each file: all that the checks need of its bytes and pixels. A file that can't
    be decoded has no md5."""
    seen = images.withColumn("_m", pixel_means("data", "channels")).select("path", "height", "width", "_m.saturation", "_m.brightness")
    rows = files.select("path", F.md5("content").alias("md5")).join(seen, "path", "left")
    return rows.withColumn("md5", F.when(F.col("height") >= 0, F.col("md5")))


def scan(files: DataFrame, images: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """All checks of image files: path, issues, action, rename_to. files as of io.image_files, images as decoded.

    Bytes and pixels are read once, for a narrow table of facts in the shared folder; looking for copies and free names reads that.
    """
    rows, path = facts(files, images), shared_dir(files.sparkSession)
    rows.write.parquet(path)
    return checked(files.sparkSession.read.schema(rows.schema).parquet(path), cfg)


def checked(rows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The checks, by a table of facts."""
    return issues(rename_plan(duplicates(rows)), cfg).select("path", "height", "width", "issues", "action", "rename_to")


def read_folder(folder: str) -> Iterator[tuple]:
    """path and the other facts of each image file that Spark's sources would list in a folder, which are not empty; a last row of nulls, if
    one is of a format that isn't decoded here."""
    store, base = store_of(folder)
    for file in store.get_file_info(fs.FileSelector(base, recursive=True)):
        name = file.path.removeprefix(base).lstrip("/")
        if not file.is_file or not file.size or not name.lower().endswith(IMAGE_SUFFIXES) or not listed(name):
            continue
        with store.open_input_file(file.path) as f:
            raw = f.read()
        path = f"{folder}/{name}"
        if (px := plain_bitmap(raw)) is not None:
            yield path, hashlib.md5(raw).hexdigest(), *px.shape[:2], *_means(px.reshape(-1, 3))
        elif raw.startswith(HEADS):
            yield (None,) * 6
            return
        else:
            yield path, None, -1, -1, None, None


def _read_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["folder", *(c.split()[0] for c in FACTS.split(", "))]
    types = [pa.string()] * 3 + [pa.int32()] * 2 + [pa.float64()] * 2
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            rows = ((folder, *r) for r in read_folder(folder))
            while some := list(islice(rows, FILES_A_BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)


def facts_of_folders(spark: SparkSession, folders: list[str], at_once: int = FOLDERS_AT_ONCE) -> DataFrame:
    """The table of facts of all image files in these folders, none of which holds another, however many there are in all.

    A task lists some folders and reads each file once: plain bitmaps are decoded there, and what begins like no image is corrupt. Folders
    with other formats, or in a store that Arrow doesn't know, go through Spark's sources, some at a time, as the driver lists their files.
    The image source takes about 5 ms of a core for a file, however small, since it generates code for each.
    """
    folders = [re.sub("^(file:)?/+", "file:/", f.rstrip("/")) for f in folders]  # as paths are shown
    try:
        for folder in folders[:1]:
            store_of(folder)
    except (pa.ArrowInvalid, OSError):
        return _facts_by_sources(spark, folders, at_once)
    path, schema = shared_dir(spark), f"folder string, {FACTS}"
    given = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(len(folders) // FOLDERS_A_TASK + 1)
    given.mapInArrow(_read_folders, schema).write.parquet(path)
    found = spark.read.schema(schema).parquet(path)
    others = found.where("path IS NULL").select("folder").distinct()
    rest = sorted(r[0] for r in others.collect())
    if not rest:
        return found.drop("folder")
    return found.join(others, "folder", "left_anti").drop("folder").unionByName(_facts_by_sources(spark, rest, at_once))


def _facts_by_sources(spark: SparkSession, folders: list[str], at_once: int) -> DataFrame:
    path, key = shared_dir(spark), "spark.sql.files.openCostInBytes"
    spark.createDataFrame([], FACTS).write.parquet(path)
    before = spark.conf.get(key)
    spark.conf.set(key, str(OPEN_COST))
    try:
        for i in range(0, len(folders), at_once):
            some = folders[i : i + at_once]
            rows = facts(image_files(spark, some), decoded_images(spark, some))
            rows.write.mode("append").parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(FACTS).parquet(path)


def ready(records: DataFrame, checked: DataFrame, path: str = "path") -> DataFrame:
    """Records whose file the plan would not remove."""
    gone = checked.where(F.col("action").isin("remove", "remove_duplicate")).select(F.col("path").alias(path))
    return records.join(gone, path, "left_anti")
