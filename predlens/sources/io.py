"""Sources and sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas

IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png")
PAPER_XML = (
    "MedlineCitation struct<PMID:string, Article:struct<ArticleTitle:string, Abstract:struct<AbstractText:string>, "
    "Journal:struct<Title:string, JournalIssue:struct<PubDate:struct<Year:string>>>>>"
)
ENTRY_XML = "title string, summary string, id string, published string"


def labels_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All CSV files below a folder, with a header row and the given schema."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path, header=True)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Where it is unset, a temporary one of a local session;
    on a cluster that would lose data, so it is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="predlens-")
    return f"{base.rstrip('/')}/predlens-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Through the file system of the path, so remote stores work."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def claim(spark: SparkSession, path: str) -> bool:
    """Makes an empty file; False if it is there already. One step of the file system, so of several callers one gets True."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(p)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that no pending plan reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def optional_csv(spark: SparkSession, path: str | None, schema: str) -> DataFrame | None:
    return spark.read.schema(schema).csv(path, header=True) if path and exists(spark, path) else None


def versioned_csv(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first of the paths that exists, newest version first."""
    found = next((p for p in paths if exists(spark, p)), None)
    if found is None:
        raise FileNotFoundError(f"none of {paths}")
    return spark.read.schema(schema).csv(found, header=True)


def image_files(spark: SparkSession, path: str | list[str], suffixes=IMAGE_SUFFIXES) -> DataFrame:
    """Files with the suffixes at any depth of a folder or of several: path, modificationTime, length, content (read only if selected). The
    driver lists them all."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a folder, and the folder's path in it. An error if Arrow doesn't know the store."""
    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + quote(folder.removeprefix("file:")))


def listed(name: str) -> bool:
    """Whether Spark's file sources list a file by its path below the folder: they skip hidden files and those still being copied."""
    parts = name.split("/")
    return not any(p.startswith(".") or p.startswith("_") and "=" not in p or p.endswith("._COPYING_") for p in parts)


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """One file for each row, with the row's name and bytes, and their number. A name may begin with a folder below the given one. Tasks
    write through Arrow's file systems, to the folder's own store; a task that runs again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        made = set()
        for batch in batches:
            for n, c in zip(*batch.columns, strict=True):
                file = f"{base}/{n.as_py()}"
                if (parent := file.rsplit("/", 1)[0]) not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                with store.open_output_stream(file) as out:
                    out.write(c.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return rows.select(name, content).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def decoded_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, height, width, channels and pixel bytes (blue first); height -1 for a file that can't be decoded."""
    # the origin is a URI, a listed path is not
    origin = F.url_decode(F.replace(F.regexp_replace("image.origin", "^file:/+", "file:/"), F.lit("+"), F.lit("%2B")))
    images = spark.read.format("image").option("recursiveFileLookup", True).load(path)
    return images.select(origin.alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def report_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of QA reports, one row each."""
    return spark.read.schema(schemas.QA_REPORT).option("multiLine", True).json(path).select(F.explode("records").alias("r")).select("r.*")


def scan_results(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file a scan; files that can't be read as one are skipped."""
    return spark.read.schema(schemas.SCAN).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def all_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All reports of a folder with the time they were written, newest first."""
    reports = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return reports.select("*", F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_path").alias("file")).orderBy(F.desc("written"), "file")


def latest(reports: DataFrame, by: str, *ties: str) -> DataFrame:
    """The one row with the largest `by`; no row if there is none."""
    return reports.orderBy(F.desc(by), *ties).limit(1)


def append_run(log: DataFrame, path: str) -> None:
    log.write.mode("append").json(path)


def run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RUN_LOG).option("mode", "DROPMALFORMED").json(path)


def tail(log: DataFrame, n: int = 10, order: str = "timestamp", tie: str = "run_count") -> DataFrame:
    return log.orderBy(F.desc(order), F.desc(tie)).limit(n)


def numbered(log: DataFrame, agent: str = "agent", order: str = "timestamp", tie: str | None = None) -> DataFrame:
    """Adds run_count, the number of a run among those of its agent."""
    return log.withColumn("run_count", F.row_number().over(W.partitionBy(agent).orderBy(order, *([tie] if tie else []))))


def write_split(df: DataFrame, path: str, kind: str = "parquet", split: str = "split") -> None:
    """One folder for each split."""
    writer = df.write.mode("overwrite").partitionBy(split)
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """CSV files of a folder: name without suffix, size and time, by name; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)\.csv$", 1).alias("session"), F.col("length").alias("size"), F.col("modificationTime").alias("created")).orderBy("session")


def paper_articles(spark: SparkSession, path: str, query: str = "") -> DataFrame:
    """Papers of landed article XML; fields that are missing are null or empty, articles without a title go."""
    rows = spark.read.format("xml").schema(PAPER_XML).option("rowTag", "PubmedArticle").option("mode", "DROPMALFORMED").load(path)
    a, pmid = "MedlineCitation.Article", F.col("MedlineCitation.PMID")
    rows = rows.select(
        F.lit("pubmed").alias("source"), pmid.alias("pmid"), F.col(f"{a}.ArticleTitle").alias("title"), F.col(f"{a}.Journal.Title").alias("journal"),
        F.col(f"{a}.Journal.JournalIssue.PubDate.Year").alias("year"), F.substring(F.coalesce(F.col(f"{a}.Abstract.AbstractText"), F.lit("")), 1, 300).alias("abstract_excerpt"),
        F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")).alias("url"), F.lit(query).alias("query"),
    )
    return rows.where(F.length("title") > 0)


def paper_entries(spark: SparkSession, path: str, query: str = "") -> DataFrame:
    """Papers of a landed Atom feed."""
    rows = spark.read.format("xml").schema(ENTRY_XML).option("rowTag", "entry").option("mode", "DROPMALFORMED").load(path)
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return rows.where(F.length("title") > 0).select(
        F.lit("arxiv").alias("source"), clean("title").alias("title"), F.substring(F.coalesce(clean("summary"), F.lit("")), 1, 300).alias("abstract_excerpt"), F.col("id").alias("url"), F.lit(query).alias("query")
    )


def metrics(spark: SparkSession, path: str, defaults: dict[str, float]) -> DataFrame:
    """One row of metrics; what the file lacks, or all if there is none, comes from the defaults."""
    fields = ", ".join(f"{k} double" for k in defaults)
    if exists(spark, path):
        rows = spark.read.schema(fields).option("multiLine", True).json(path).limit(1)
    else:
        rows = spark.createDataFrame([tuple(None for _ in defaults)], fields)
    return rows.select(*(F.coalesce(k, F.lit(float(v))).alias(k) for k, v in defaults.items()))
