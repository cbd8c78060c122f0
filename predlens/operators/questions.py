"""Report queries over scans, reports and logs; the ten data questions; routing of free questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import CLASSES, DATA_KEYWORDS, FULL_NAMES, KNOWLEDGE_KEYWORDS, QUESTIONS
from ..functions import columns as C
from ..sources.io import latest

# scans


def by_id(scans: DataFrame, scan_id) -> DataFrame:
    return scans.where(F.col("scan_id") == F.lit(scan_id))


def patient_history(scans: DataFrame, patient_id) -> DataFrame:
    return scans.where(F.col("patient_id") == F.lit(patient_id)).orderBy(F.desc("timestamp"), "scan_id")


def history_counts(scans: DataFrame) -> DataFrame:
    return scans.groupBy("patient_id").agg(F.count(F.lit(1)).alias("scans"))


def audit_log(scans: DataFrame, n: int = 50, columns=("scan_id", "timestamp", "verdict", "pred_class", "confidence")) -> DataFrame:
    return scans.orderBy(F.desc("timestamp"), "scan_id").select(*(c for c in columns if c in scans.columns)).limit(n)


def search(scans: DataFrame, text: str | None = None, verdict: str | None = None, pred_class: str | None = None) -> DataFrame:
    """Scans whose record as JSON holds the text, case folded, and that have the verdict and class; each is optional."""
    out = scans
    if verdict:
        out = out.where(F.col("verdict") == verdict)
    if pred_class:
        out = out.where(F.col("pred_class") == pred_class)
    return out.where(F.contains(F.lower(F.to_json(F.struct(*scans.columns))), F.lit(text.lower()))) if text else out


def scan_stats(scans: DataFrame, by: list[str] | None = None) -> DataFrame:
    count = lambda v: F.count_if(F.col("verdict") == v)
    return scans.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total"), count("CANCER_FLAGGED").alias("flagged"), count("REVIEW_REQUIRED").alias("review"), count("NORMAL").alias("normal"))


def recently_flagged(scans: DataFrame, as_of: Column | None = None, days: int = 7) -> DataFrame:
    """Flagged scans of the last days before as_of (now by default)."""
    since = (F.current_timestamp() if as_of is None else as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    return scans.where((F.col("timestamp") >= since) & (F.col("verdict") == "CANCER_FLAGGED"))


# conversations and alerts


def classify(questions: DataFrame, column: str = "question") -> DataFrame:
    return questions.withColumn("intent", C.intent(column, DATA_KEYWORDS, KNOWLEDGE_KEYWORDS))


def match(questions: DataFrame, column: str = "question", library: dict[str, str] = QUESTIONS, least: float = 0.4) -> DataFrame:
    """Adds question_id of the library question most of whose words the question has, over the least share; the first of equals.

    The library is a few rows and becomes part of the expression, so questions are neither joined nor shuffled.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(column), r"\s+"), lambda w: w != ""))
    scores = []
    for i, (key, text) in enumerate(library.items()):
        own = sorted(set(text.lower().split()))
        share = F.size(F.array_intersect(words, C.strings(own))) / F.lit(float(len(own)))
        scores.append(F.struct(share.alias("share"), F.lit(-i).alias("n"), F.lit(key).alias("id")))
    best = F.array_max(F.array(*scores))
    return questions.withColumn("_b", best).withColumn("question_id", F.when(F.col("_b.share") > least, F.col("_b.id"))).drop("_b")


def last_turns(turns: DataFrame, n: int = 6, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    return turns.withColumn("_n", F.row_number().over(W.partitionBy(session).orderBy(F.desc(turn)))).where(F.col("_n") <= n).drop("_n")


def alerts(feed: DataFrame, unread_only: bool = False, n: int = 50) -> DataFrame:
    """The newest alerts, and how many there are before the cut."""
    out = feed.where(~F.col("read")) if unread_only else feed
    total = out.agg(F.count(F.lit(1)).alias("matching"))
    return out.orderBy(F.desc("timestamp"), "id").limit(n).crossJoin(F.broadcast(total))


# metrics and digests


def metric_flags(metrics: DataFrame, fnr: float = 0.20, sensitivity: float = 0.80, specificity: float = 0.95) -> DataFrame:
    rules = ((F.col("fnr") > fnr, "high_fnr"), (F.col("sensitivity") < sensitivity, "low_sensitivity"), (F.col("specificity") > specificity, "high_specificity"))
    return metrics.withColumn("metric_flags", C.messages(*rules))


def class_auc_table(metrics: DataFrame, classes=CLASSES) -> DataFrame:
    """Class, full name and AUC, a row for each class; null where the metrics lack it."""
    values = metrics.select(*((F.col(f"{c}_auc") if f"{c}_auc" in metrics.columns else F.lit(None)).cast("double").alias(c) for c in classes))
    return values.unpivot([], list(classes), "pred_class", "auc").withColumn("full_name", C.lookup("pred_class", FULL_NAMES))


def digest(metrics: DataFrame, drift: DataFrame, papers: DataFrame, n: int = 5) -> DataFrame:
    """One row: metrics, the newest drift report and the titles of the best papers."""
    best = papers.orderBy(F.desc("relevance"), "title").limit(n).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("relevance")).alias("r"), "title"))), lambda x: x["title"]).alias("papers"))
    return metrics.join(drift, how="left").join(best, how="left")


def research_report(metrics: DataFrame, groups: DataFrame, drift: DataFrame) -> dict[str, DataFrame]:
    """The tables of a research report: AUC by class, subgroups by sex, drift."""
    return {"per_class": class_auc_table(metrics), "by_sex": groups.where(F.col("axis") == "sex"), "drift": drift}


def report_rows(metrics: DataFrame, groups: DataFrame, drift: DataFrame) -> DataFrame:
    """The research report as one table: section, item, value and note. Class AUCs, then those by sex, then the newest drift report."""
    parts = research_report(metrics, groups, drift)
    per_class = parts["per_class"].select(F.lit("per_class").alias("section"), F.col("pred_class").alias("item"), F.col("auc").alias("value"), F.col("full_name").alias("note"))
    by_sex = parts["by_sex"].select(F.lit("by_sex"), "group", "auc", F.concat(F.lit("n = "), F.col("n").cast("string")))
    newest = parts["drift"].select(F.lit("drift"), "severity", "kl_divergence", F.array_join("flags", "; "))
    return per_class.union(by_sex).union(newest)


def key_findings(flag_totals: DataFrame, drift: DataFrame, calibration: DataFrame, queue_summary: DataFrame) -> DataFrame:
    """One row from one-row reports."""
    parts = (flag_totals.select(F.col("annotation_conflict").alias("conflicts"), "ambiguous", "low_confidence"), drift.select("severity"), calibration.select("recommendation"), queue_summary.select("est_auc_gain"))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, how="left")
    return out


# the data questions


def _worst(groups: DataFrame, n: int = 3) -> DataFrame:
    return groups.where((F.col("axis") == "site") & F.col("auc").isNotNull()).orderBy("auc", "group").limit(n)


def _fnr(metrics: DataFrame, counts: DataFrame, order: str) -> DataFrame:
    last = latest(counts, order)
    return last.join(metrics.select("fnr", "sensitivity"), how="left").withColumn("source", F.when(F.col("fnr").isNotNull(), "metrics").otherwise("verification_report"))


def _low(counts: DataFrame, order: str) -> DataFrame:
    last = latest(counts, order)
    return last.select(F.col("low_confidence").alias("low_confidence_count"), "total", F.round(F.col("low_confidence") / F.greatest("total", F.lit(1)), 4).alias("rate"))


def _conflicts(records: DataFrame, n: int = 20) -> DataFrame:
    rows = records.where(F.col("flag") == "ANNOTATION_CONFLICT")
    total = rows.agg(F.count(F.lit(1)).alias("total_conflicts"))
    return rows.orderBy(F.desc("ts"), "image_id").limit(n).select("image_id", "pred_class", "human_label", "confidence_score").crossJoin(F.broadcast(total))


#: Question to function of the tables it needs, by name, and parameters.
ROUTES: dict[str, Callable[..., DataFrame]] = {
    "Q01": lambda t, **p: recently_flagged(t["scans"], **p).agg(F.count(F.lit(1)).alias("count")),
    "Q02": lambda t, order="batch_id": _fnr(t["metrics"], t["flag_counts"], order),
    "Q03": lambda t, n=3: _worst(t["groups"], n),
    "Q04": lambda t, n=20: _conflicts(t["records"], n),
    "Q05": lambda t, order="batch_id": _low(t["flag_counts"], order),
    "Q06": lambda t: t["metrics"],
    "Q07": lambda t, order="batch_id": latest(t["drift"], order).select("severity", "flags", F.col("kl_divergence").alias("kl_div"), "conf_mean"),
    "Q08": lambda t, n=10: t["queue"].orderBy(F.desc("uncertainty_score"), "image_id").limit(n),
    "Q09": lambda t: t["calibration"].select("ece", "overconfidence", "needs_recal", "recommendation", "current_t", "recommended_t"),
    "Q10": lambda t: t["groups"].where(F.col("axis") == "sex"),
}


def answer(question_id: str, tables: dict[str, DataFrame], **params) -> DataFrame:
    if question_id not in ROUTES:
        raise KeyError(f"no data question {question_id}")
    return ROUTES[question_id](tables, **params)
