"""Views of the given tables as prediction records, scans, papers and questions, in Spark and as SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CLASSES, DEFAULT
from ..functions import columns as C
from ..operators import qa, score


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_records(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Lineitems, from the table or a stream of it, with ids and seven logits in integer arithmetic."""
    c = F.col
    base = c("l_orderkey") * 31 + c("l_partkey") * 7 + c("l_suppkey") * 13
    logit = lambda k: ((base + c("l_linenumber") * (k * k * 17) + c("l_orderkey") * (k * k)) % 97).cast("double") / F.lit(16.0) + F.lit(1.0 if k == 2 else 0.0)
    day = c("l_shipdate").cast("date").cast("string")
    return (table(spark, sf_dir, "lineitem") if lineitem is None else lineitem).withColumns({
        "image_id": F.concat_ws("-", *(c(x).cast("string") for x in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")), day),
        "dup_id": F.concat_ws("-", c("l_orderkey").cast("string"), c("l_linenumber").cast("string")),
        "logits": F.array(*(logit(k) for k in range(1, 8))),
        "ts": c("l_shipdate"),
        "batch_id": F.year("l_shipdate").cast("long"),
        "dataset": F.when(c("l_returnflag") == "R", "DS_A").when(c("l_returnflag") == "A", "DS_B").otherwise("DS_C"),
        "sex": F.when((c("l_returnflag") == "N") & (c("l_linenumber") == 7), None).when(c("l_linestatus") == "F", "female").otherwise("male"),
    })


def records(spark: SparkSession, sf_dir: str, age: bool = False, site: bool = False, lineitem: DataFrame | None = None) -> DataFrame:
    """Prediction records with labels and flags; age and site on request, by joins with dimensions. They are joined to the narrow rows,
    before predictions make them wide."""
    if age or site:
        lineitem = table(spark, sf_dir, "lineitem") if lineitem is None else lineitem
    if age:
        lineitem = lineitem.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") * 2).cast("double").alias("age")), "l_partkey")
    if site:
        lineitem = lineitem.join(sites(spark, sf_dir), "l_suppkey")
    out = score.predict(raw_records(spark, sf_dir, lineitem), temperature=DEFAULT.temperature)
    own = (F.col("l_partkey") * 3 + F.col("l_suppkey") + F.col("l_linenumber")) % 10 < 7
    out = out.withColumn("human_label", F.when(own, F.col("pred_class")).otherwise(F.get(C.strings(CLASSES), (F.col("l_partkey") % 7).cast("int"))))
    return qa.annotate(out)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier and site."""
    where = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return where.select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("site"))


def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, sex and site, without predictions."""
    return raw_records(spark, sf_dir).join(sites(spark, sf_dir), "l_suppkey").select("image_id", "sex", "site")


def scans(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events, from the table or a stream of it, as a scan log."""
    kind = F.col("event_type")
    verdict = F.when(kind == "error", "CANCER_FLAGGED").when(kind.isin("click", "purchase"), "REVIEW_REQUIRED").otherwise("NORMAL")
    return (table(spark, sf_dir, "events") if events is None else events).select(F.col("event_id").alias("scan_id"), F.col("user_id").alias("patient_id"), F.col("ts").alias("timestamp"), verdict.alias("verdict"), kind.alias("pred_class"), (F.col("value") / 500).alias("confidence"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers: the whole text is the title, the first three hundred characters are the excerpt that a paper carries."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("lang").alias("query"), F.col("text").alias("title"), C.excerpt("text").alias("abstract_excerpt"))


_NAMES = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"
RECORDS = f"""
raw AS (SELECT *, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS image_id,
  concat_ws('-', l_orderkey, l_linenumber) AS dup_id, l_shipdate AS ts, CAST(year(l_shipdate) AS BIGINT) AS batch_id,
  CASE l_returnflag WHEN 'R' THEN 'DS_A' WHEN 'A' THEN 'DS_B' ELSE 'DS_C' END AS dataset,
  CASE WHEN l_returnflag = 'N' AND l_linenumber = 7 THEN NULL WHEN l_linestatus = 'F' THEN 'female' ELSE 'male' END AS sex,
  [CAST((l_orderkey * 31 + l_partkey * 7 + l_suppkey * 13 + l_linenumber * k * k * 17 + l_orderkey * k * k) % 97 AS DOUBLE) / CAST(16 AS DOUBLE)
   + CAST(CASE WHEN k = 2 THEN 1 ELSE 0 END AS DOUBLE) FOR k IN [1, 2, 3, 4, 5, 6, 7]] AS logits FROM lineitem),
exps AS (SELECT *, [exp((x - list_max(logits)) / CAST(0.4095 AS DOUBLE)) FOR x IN logits] AS e FROM raw),
soft AS (SELECT *, [x / list_sum(e) FOR x IN e] AS probs FROM exps),
best AS (SELECT *, list_max(probs) AS top, {_NAMES}[list_position(probs, list_max(probs))] AS pred_class, list_reverse_sort(probs) AS down FROM soft),
labelled AS (SELECT *, round(top * 10, 2) AS confidence_score, round(probs[1], 4) AS mel_prob,
  CASE WHEN (l_partkey * 3 + l_suppkey + l_linenumber) % 10 < 7 THEN pred_class ELSE {_NAMES}[1 + l_partkey % 7] END AS human_label FROM best),
records AS (SELECT *, CASE WHEN human_label <> pred_class AND confidence_score >= 7 THEN 'ANNOTATION_CONFLICT' WHEN (down[1] - down[2]) * 10 < 2 THEN 'AMBIGUOUS'
  WHEN top < 0.65 THEN 'LOW_CONFIDENCE' ELSE 'OK' END AS flag FROM labelled),
people AS (SELECT r.*, CAST(p_size * 2 AS DOUBLE) AS age, r_name AS site FROM records r JOIN part ON p_partkey = l_partkey
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
"""
SCANS = """
scans AS (SELECT event_id AS scan_id, user_id AS patient_id, ts AS "timestamp", CASE WHEN event_type = 'error' THEN 'CANCER_FLAGGED'
  WHEN event_type IN ('click', 'purchase') THEN 'REVIEW_REQUIRED' ELSE 'NORMAL' END AS verdict, event_type AS pred_class, value / 500 AS confidence FROM events)
"""
PAPERS = "papers AS (SELECT doc_id, lang AS query, text AS title, substr(text, 1, 300) AS abstract_excerpt FROM documents)"
