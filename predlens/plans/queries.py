"""The registered queries of the library's own operators, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config, schemas
from ..config import CLASSES, DEFAULT
from ..functions import columns as C
from ..functions import stats
from ..operators import active, calibrate, curate, drift, fairness, hypothesis, ingest_qc, papers, qa, questions, score
from ..sources import io
from ..streaming import jobs, streams
from . import records as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEYWORDS = ("the", "tion", "der", "que", "la ", "and", "license", "en", "ou", "re")
TESTS = [("sex", "female"), ("sex", "male"), ("site", "asia"), ("site", "europe"), ("flag", "LOW_CONFIDENCE"), ("pred_class", "nv")]


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rec(sql: str) -> str:
    return f"WITH {V.RECORDS} {sql}"


# predictions and annotation QA


def flat(array: str, names) -> list:
    """Elements of an array as rounded columns."""
    return [F.round(F.get(array, F.lit(i)), 4).alias(n) for i, n in enumerate(names)]


def flat_sql(array: str, names) -> str:
    return ", ".join(f"round({array}[{i}], 4) AS {n}" for i, n in enumerate(names, 1))


SEVEN = [f"x{i}" for i in range(7)]


@query(rec(f"SELECT image_id, pred_class, {flat_sql('probs', CLASSES)} FROM records"))
def softmax_predict(spark, d):
    return V.records(spark, d).select("image_id", "pred_class", *flat("probs", CLASSES))


@query(f"""WITH f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS l FROM embeddings), e AS (SELECT vec_id, [exp(x - list_max(l)) FOR x IN l] AS e FROM f),
p AS (SELECT vec_id, [x / list_sum(e) FOR x IN e] AS p FROM e) SELECT vec_id, {flat_sql('p', SEVEN)}, round(list_max(p), 4) AS top FROM p""")
def softmax_float32(spark, d):
    """Over all components; the first seven probabilities and the largest."""
    rows = V.table(spark, d, "embeddings").select("vec_id", C.softmax("embedding").alias("p"))
    return rows.select("vec_id", *flat("p", SEVEN), F.round(F.array_max("p"), 4).alias("top"))


@query(rec("SELECT image_id, confidence_score, mel_prob FROM records"))
def confidence_score(spark, d):
    return V.records(spark, d).select("image_id", "confidence_score", "mel_prob")


@query(rec("SELECT image_id, pred_class, human_label, flag FROM records"))
def qa_flags(spark, d):
    return V.records(spark, d).select("image_id", "pred_class", "human_label", "flag")


_FLAG_COUNTS = "count(*) AS total, " + ", ".join(f"count(*) FILTER (flag = '{f}') AS {f.lower()}" for f in config.FLAGS)


@query(rec(f"SELECT batch_id, {_FLAG_COUNTS} FROM records GROUP BY batch_id"))
def qa_flag_counts(spark, d):
    return qa.flag_counts(V.records(spark, d), ["batch_id"])


@query(rec("SELECT image_id, pred_class, human_label, confidence_score FROM records WHERE flag = 'ANNOTATION_CONFLICT'"))
def label_conflicts(spark, d):
    return qa.conflicts(V.records(spark, d)).select("image_id", "pred_class", "human_label", "confidence_score")


@query(rec("SELECT image_id, confidence_score FROM records ORDER BY confidence_score, image_id LIMIT 50"))
def lowest_confidence_top50(spark, d):
    return qa.lowest_confidence(V.records(spark, d)).select("image_id", "confidence_score")


@query("""WITH l AS (SELECT lower(concat('doc', doc_id)) AS stem, doc_id, lang, n_chars FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULLIF(lang, '') ELSE CASE WHEN doc_id % 3 = 1 THEN lang ELSE NULL END END AS human_label FROM l""")
def human_label_lookup(spark, d):
    docs = V.table(spark, d, "documents")
    rows = docs.select("doc_id", F.concat(F.lit("/in/doc"), "doc_id", F.lit(".jpg")).alias("path"))
    kind = F.col("doc_id") % 3
    labels = docs.where(kind < 2).select(F.concat(F.lit("doc"), "doc_id", F.when(kind == 1, ".jpg").otherwise("")).alias("image"), F.col("lang").alias("dx"))
    return qa.human_labels(rows, labels).select("doc_id", "human_label")


# triage

_VERDICT = """tri AS (SELECT *, CASE WHEN pred_class IN ('mel', 'bcc', 'akiec') OR probs[1] >= 0.312 THEN 'CANCER_FLAGGED'
  WHEN pred_class = 'vasc' OR top < 0.65 THEN 'REVIEW_REQUIRED' ELSE 'NORMAL' END AS verdict FROM records)"""
_PRIORITY = "CASE verdict WHEN 'CANCER_FLAGGED' THEN CASE WHEN pred_class = 'mel' OR probs[1] > 0.6 THEN 1 ELSE 2 END WHEN 'REVIEW_REQUIRED' THEN 3 ELSE 4 END"


def triage_sql(sql: str) -> str:
    return f"WITH {V.RECORDS}, {_VERDICT} {sql}"


@query(triage_sql(f"SELECT image_id, verdict, {_PRIORITY} AS priority, round(top, 4) AS confidence, round(probs[1], 4) AS mel_score FROM tri"))
def verdict_triage(spark, d):
    return score.triage(V.records(spark, d)).select("image_id", "verdict", "priority", "confidence", "mel_score")


@query(triage_sql("SELECT batch_id, count(*) AS total, count(*) FILTER (verdict = 'CANCER_FLAGGED') AS flagged, count(*) FILTER (verdict = 'REVIEW_REQUIRED') AS review FROM tri GROUP BY batch_id"))
def triage_counts(spark, d):
    return qa.triage_counts(score.triage(V.records(spark, d)), ["batch_id"])


def _values(*tables: dict) -> str:
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"('{c}', " + ", ".join(text(t.get(c)) for t in tables) + ")" for c in CLASSES)


@query(rec(f"""SELECT image_id, r.pred_class, full_name AS pred_class_full, icd10, snomed, treatments AS treatment_recs
FROM records r JOIN (VALUES {_values(config.FULL_NAMES, config.ICD10, config.SNOMED, {k: "; ".join(v) for k, v in config.TREATMENTS.items()})}) AS c(pred_class, full_name, icd10, snomed, treatments) USING (pred_class)"""))
def code_lookup(spark, d):
    out = score.with_codes(V.records(spark, d))
    return out.select("image_id", "pred_class", "pred_class_full", "icd10", "snomed", F.array_join("treatment_recs", "; ").alias("treatment_recs"))


@query(rec("""SELECT image_id, string_agg(c, ',' ORDER BY p DESC, c) AS ranked FROM (SELECT image_id, unnest(['mel', 'nv', 'bcc', 'akiec', 'bkl', 'df', 'vasc']) AS c,
  unnest([round(p, 4) FOR p IN probs]) AS p FROM records) GROUP BY image_id"""))
def prob_map_ranked(spark, d):
    out = V.records(spark, d).withColumn("m", C.prob_map("probs", CLASSES))
    return out.select("image_id", F.array_join(F.transform(C.ranked("m"), lambda e: e["key"]), ",").alias("ranked"))


_REPORT = "resourceType string, id string, conclusion string, conclusionCode array<struct<coding:array<struct<code:string, display:string>>>>, extension array<struct<valueDecimal:double>>"
_CODES = f"(VALUES {_values(config.FULL_NAMES, config.ICD10, config.SNOMED)}) AS c(pred_class, full_name, icd10, snomed)"


@query(triage_sql(f"""SELECT image_id AS scan_id, 'DiagnosticReport' AS kind, image_id AS id, concat(verdict, ': ', full_name) AS conclusion,
coalesce(icd10, 'L98.9') AS code, full_name AS display, round(probs[1], 4) AS mel_score FROM tri JOIN {_CODES} USING (pred_class)"""))
def fhir_export(spark, d):
    """The report's fields, read back from its JSON; of the conclusion what stands before the percentage, whose ties at .05 the two
    engines round in different ways."""
    out = score.to_fhir(score.scan_results(V.records(spark, d)).withColumns({"scan_id": F.col("image_id"), "timestamp": F.col("ts")}))
    out = out.withColumn("r", F.from_json("report", _REPORT))  # one reading of the text for all fields
    coding = F.col("r.conclusionCode")[0]["coding"][0]
    return out.select(
        "scan_id", F.col("r.resourceType").alias("kind"), "r.id", F.regexp_extract("r.conclusion", r"^(.*) \(", 1).alias("conclusion"), coding["code"].alias("code"), coding["display"].alias("display"),
        F.col("r.extension")[0]["valueDecimal"].alias("mel_score"),
    )


@query(triage_sql(f"""SELECT image_id, verdict, {_PRIORITY} AS priority, full_name AS pred_class_full, concat(CASE verdict WHEN 'CANCER_FLAGGED' THEN 'Cancer Flagged' WHEN 'REVIEW_REQUIRED' THEN 'Review Required' ELSE 'Normal' END,
' — ', full_name, ' detected with ', printf('%.1f', top * 100), '% confidence.') AS plain_summary, round(probs[1], 4) AS p_mel, round(probs[2], 4) AS p_nv, icd10, snomed FROM tri JOIN {_CODES} USING (pred_class)"""))
def scan_results(spark, d):
    out = score.scan_results(V.records(spark, d))
    return out.select("image_id", "verdict", "priority", "pred_class_full", "plain_summary", F.round(F.col("probs")["mel"], 4).alias("p_mel"), F.round(F.col("probs")["nv"], 4).alias("p_nv"), "icd10", "snomed")


@query("SELECT doc_id, n_chars > 5000 AS rejected FROM documents")
def size_guard(spark, d):
    files = V.table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("length"))
    fits, rejects = score.within_size(files, config.Config(max_bytes=5000))
    return fits.select("doc_id", F.lit(False).alias("rejected")).unionByName(rejects.select("doc_id", F.lit(True).alias("rejected")))


def _linear():
    """A stand-in for a model: seven sums of all 64 features, weighed by quarters."""
    import numpy as np

    weights = ((np.arange(64)[:, None] * 7 + np.arange(7) * 3) % 5 - 2) / 4
    return lambda x: x.astype("float64") @ weights


@query(f"""WITH f AS (SELECT vec_id, [list_sum([CAST(embedding[i] AS DOUBLE) * (((i - 1) * 7 + k * 3) % 5 - 2) * 0.25::DOUBLE FOR i IN range(1, 65)]) FOR k IN range(7)] AS l FROM embeddings)
SELECT vec_id, {flat_sql('l', SEVEN)} FROM f""")
def batch_scoring(spark, d):
    rows = V.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    scored = score.score_batch(rows, _linear, ["x"], 256, shapes=[[64]])
    return scored.select("vec_id", *flat("logits", SEVEN))


# active learning

_UNCERTAIN = """unc AS (SELECT *, -list_sum([CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END FOR p IN probs]) AS ent, down[1] - down[2] AS mar FROM records),
scored AS (SELECT *, round(ent, 4) AS entropy, round(mar, 4) AS margin, round(ent * (1 - mar), 4) AS uncertainty_score FROM unc)"""


def uncertain_sql(sql: str) -> str:
    return f"WITH {V.RECORDS}, {_UNCERTAIN} {sql}"


@query(uncertain_sql("SELECT image_id, entropy, margin, uncertainty_score FROM scored"))
def uncertainty_scores(spark, d):
    return active.uncertainty(V.records(spark, d)).select("image_id", "entropy", "margin", "uncertainty_score")


@query(uncertain_sql("SELECT image_id, pred_class, uncertainty_score FROM scored ORDER BY uncertainty_score DESC, image_id LIMIT 50"))
def annotation_queue(spark, d):
    return active.queue(active.uncertainty(V.records(spark, d))).select("image_id", "pred_class", "uncertainty_score")


@query(uncertain_sql("SELECT pred_class, count(*) AS n FROM (SELECT * FROM scored ORDER BY uncertainty_score DESC, image_id LIMIT 50) GROUP BY pred_class"))
def queue_breakdown(spark, d):
    return active.breakdown(active.queue(active.uncertainty(V.records(spark, d))))


@query(uncertain_sql("""SELECT count(*) AS top_n, round(avg(uncertainty_score), 4) AS avg_uncertainty, round(avg(uncertainty_score) * 0.01, 4) AS est_auc_gain
FROM (SELECT * FROM scored ORDER BY uncertainty_score DESC, image_id LIMIT 50)"""))
def queue_summary(spark, d):
    return active.summary(active.queue(active.uncertainty(V.records(spark, d))))


# drift

_SHARES = ", ".join(f"count(*) FILTER (pred_class = '{c}') / CAST(count(*) AS DOUBLE) AS s{i}" for i, c in enumerate(CLASSES))
_KL = " + ".join(f"CASE WHEN s{i} > 0 THEN s{i} * ln(s{i} / {config.TRAIN_SHARES[c]!r}::DOUBLE) ELSE 0 END" for i, c in enumerate(CLASSES))
_DRIFT = f"""sh AS (SELECT batch_id, count(*) AS n_images, {_SHARES}, avg(confidence_score / 10) AS cm, stddev_pop(confidence_score / 10) AS cs,
  avg(CASE WHEN confidence_score / 10 < 0.65 THEN 1.0 ELSE 0.0 END) AS low FROM records GROUP BY batch_id),
kl AS (SELECT *, round({_KL}, 4) AS kl_divergence, abs(cm - 0.82) / 0.14 AS z, abs(s0 - 0.0909) > 0.10 AS mel_anomaly FROM sh),
rep AS (SELECT *, CASE WHEN z > 2 THEN CASE WHEN kl_divergence > 0.2 THEN 'HIGH' ELSE 'MEDIUM' END WHEN kl_divergence > 0.5 THEN 'HIGH' WHEN kl_divergence > 0.2 THEN 'MEDIUM' ELSE 'OK' END AS severity,
  concat_ws('; ', CASE WHEN kl_divergence > 0.5 THEN 'HIGH_DISTRIBUTION_SHIFT' WHEN kl_divergence > 0.2 THEN 'MODERATE_DISTRIBUTION_SHIFT' END, CASE WHEN z > 2 THEN 'CONFIDENCE_SHIFT' END,
  CASE WHEN mel_anomaly THEN 'MEL_RATE_ANOMALY' END, CASE WHEN low > 0.30 THEN 'HIGH_LOW_CONFIDENCE_RATE' END) AS flags FROM kl)"""


def drift_sql(sql: str) -> str:
    return f"WITH {V.RECORDS}, {_DRIFT} {sql}"


@query(rec("SELECT batch_id, count(*) AS n_images, " + ", ".join(f"round(count(*) FILTER (pred_class = '{c}') / CAST(count(*) AS DOUBLE), 6) AS {c}" for c in CLASSES) + " FROM records GROUP BY batch_id"))
def class_shares(spark, d):
    out = drift.class_shares(V.records(spark, d), ["batch_id"])
    return out.select("batch_id", "n_images", *(F.round(c, 6).alias(c) for c in CLASSES))


@query(drift_sql("SELECT batch_id, kl_divergence FROM rep"))
def kl_drift(spark, d):
    return drift.report(V.records(spark, d), ["batch_id"]).select("batch_id", "kl_divergence")


@query(drift_sql("SELECT batch_id, round(cm, 4) AS conf_mean, round(cs, 4) AS conf_std, round(z, 2) AS conf_shift_z FROM rep"))
def confidence_shift(spark, d):
    return drift.report(V.records(spark, d), ["batch_id"]).select("batch_id", "conf_mean", "conf_std", "conf_shift_z")


@query(drift_sql("SELECT batch_id, round(low, 4) AS low_conf_share FROM rep"))
def low_conf_share(spark, d):
    return drift.report(V.records(spark, d), ["batch_id"]).select("batch_id", "low_conf_share")


@query(drift_sql("""SELECT batch_id, n_images, kl_divergence, round(cm, 4) AS conf_mean, round(cs, 4) AS conf_std, round(z, 2) AS conf_shift_z, round(s0, 4) AS mel_rate, mel_anomaly,
round(low, 4) AS low_conf_share, flags, severity FROM rep"""))
def drift_report(spark, d):
    return drift.report(V.records(spark, d), ["batch_id"]).withColumn("flags", F.concat_ws("; ", "flags"))


@query(rec("SELECT " + ", ".join(f"round(count(*) FILTER (pred_class = '{c}') / CAST(count(*) AS DOUBLE), 6) AS {c}" for c in CLASSES) + ", round(avg(confidence_score / 10), 4) AS conf_mean, round(stddev_pop(confidence_score / 10), 4) AS conf_std FROM records"))
def reference_distribution(spark, d):
    out = drift.reference(V.records(spark, d))
    return out.select(*(F.round(c, 6).alias(c) for c in CLASSES), F.round("conf_mean", 4).alias("conf_mean"), F.round("conf_std", 4).alias("conf_std"))


# fairness


def auc_sql(groups: str, score: str, positive: str, source: str) -> str:
    """Mann-Whitney by average ranks, for groups named g."""
    return f"""rk AS (SELECT {groups} AS g, {positive} AS y, rank() OVER (PARTITION BY {groups} ORDER BY {score}) + (count(*) OVER (PARTITION BY {groups}, {score}) - 1) / 2.0 AS r
  FROM {source} WHERE {groups} IS NOT NULL AND {score} IS NOT NULL),
ag AS (SELECT g, count(*) AS n, count(*) FILTER (y) AS p, sum(CASE WHEN y THEN r ELSE 0 END) AS s FROM rk GROUP BY g),
auc AS (SELECT g, n, CASE WHEN p >= 3 AND n - p >= 3 THEN round((s - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * (n - p)), 4) END AS auc FROM ag)"""


_BAND = "CASE WHEN age <= 0 THEN NULL WHEN age <= 30 THEN '<30' WHEN age <= 45 THEN '30-45' WHEN age <= 60 THEN '45-60' WHEN age <= 75 THEN '60-75' WHEN age <= 120 THEN '75+' END"


def _axis_sql(axis: str, groups: str) -> str:
    return f"WITH {V.RECORDS}, src AS (SELECT *, {groups} AS grp FROM people), {auc_sql('grp', 'mel_prob', chr(40) + 'human_label = ' + chr(39) + 'mel' + chr(39) + chr(41), 'src')} SELECT '{axis}' AS axis, g AS \"group\", n, auc FROM auc"


@query(_axis_sql("sex", "sex"))
def auc_by_sex(spark, d):
    return fairness.by_axis(V.records(spark, d), "sex")


@query(_axis_sql("age", _BAND))
def auc_by_age_band(spark, d):
    return fairness.by_axis(V.records(spark, d, age=True), "age")


@query(_axis_sql("site", "site"))
def auc_by_site(spark, d):
    return fairness.by_axis(V.records(spark, d, site=True), "site")


def _groups(spark, d):
    return fairness.by_axes(V.records(spark, d, age=True, site=True))


def _all_axes_sql(sql: str) -> str:
    src = f"src AS (SELECT 'sex|' || sex AS grp, * FROM people UNION ALL SELECT 'age|' || ({_BAND}), * FROM people UNION ALL SELECT 'site|' || site, * FROM people)"
    groups = "grps AS (SELECT split_part(g, '|', 1) AS axis, split_part(g, '|', 2) AS grp, n, auc FROM auc)"
    return f"WITH {V.RECORDS}, {src}, {auc_sql('grp', 'mel_prob', '(human_label = ' + repr('mel') + ')', 'src')}, {groups} {sql}"


_LIMIT = "CASE axis WHEN 'sex' THEN 0.02 ELSE 0.05 END"


@query(_all_axes_sql(f"""SELECT axis, round(max(auc) - min(auc), 4) AS gap, CAST({_LIMIT} AS DOUBLE) AS threshold, first(grp ORDER BY auc, grp) AS worst, min(auc) AS worst_auc,
CASE WHEN max(auc) - min(auc) > {_LIMIT} * 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM grps WHERE auc IS NOT NULL GROUP BY axis HAVING count(*) >= 2 AND max(auc) - min(auc) > {_LIMIT}"""))
def disparity_warnings(spark, d):
    return fairness.disparities(_groups(spark, d))


@query(rec("SELECT 'sex' AS axis, CASE WHEN count(sex) > 0 THEN 'ok' ELSE 'no_data' END AS status FROM records UNION ALL SELECT 'age', 'metadata_unavailable' UNION ALL SELECT 'site', 'metadata_unavailable'"))
def axis_status(spark, d):
    return fairness.axis_status(V.records(spark, d))


_QUALITY = "src AS (SELECT lang, n_chars, quality FROM documents JOIN labels USING (doc_id))"


@query(f"WITH {_QUALITY}, {auc_sql('lang', 'n_chars', '(quality = 1)', 'src')} SELECT g AS lang, n, auc FROM auc")
def auc_quality_by_lang(spark, d):
    rows = V.table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(V.table(spark, d, "labels"), "doc_id").where(F.col("lang").isNotNull())
    return stats.auc(rows, ["lang"], "n_chars", F.col("quality") == 1).select("lang", "n", "auc")


# calibration

_BINS = "CASE " + " ".join(f"WHEN conf >= {low!r}::DOUBLE AND conf < {high!r}::DOUBLE THEN {i}" for i, (low, high) in enumerate(zip(calibrate.EDGES, calibrate.EDGES[1:], strict=False))) + " END"
_EVAL = f"""ev AS (SELECT *, confidence_score / 10 AS conf, CASE WHEN pred_class = human_label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS acc FROM records), bn AS (SELECT *, {_BINS} AS bin FROM ev)"""


@query(f"WITH {V.RECORDS}, {_EVAL} SELECT bin, count(*) AS n, round(avg(conf), 4) AS mean_conf, round(avg(acc), 4) AS mean_acc FROM bn WHERE bin IS NOT NULL GROUP BY bin")
def reliability_bins(spark, d):
    return calibrate.bins(V.records(spark, d))


_ECE = "be AS (SELECT batch_id, bin, count(*) AS n, sum(conf) AS c, sum(acc) AS a FROM bn GROUP BY batch_id, bin), ec AS (SELECT batch_id, sum(n) AS n, sum(CASE WHEN bin IS NULL THEN 0 ELSE abs(a - c) END) / sum(n) AS e, sum(c) / sum(n) AS mc, sum(a) / sum(n) AS ma FROM be GROUP BY batch_id)"


@query(f"WITH {V.RECORDS}, {_EVAL}, {_ECE} SELECT batch_id, CAST(n AS BIGINT) AS n_eval, round(e, 4) AS ece FROM ec")
def ece(spark, d):
    return calibrate.report(V.records(spark, d), ["batch_id"]).select("batch_id", "n_eval", "ece")


@query(f"""WITH {V.RECORDS}, {_EVAL}, {_ECE} SELECT batch_id, round(mc, 4) AS mean_conf, round(ma, 4) AS mean_acc, round(mc - ma, 4) AS overconfidence, e > 0.10 OR abs(mc - ma) > 0.15 AS needs_recal,
CASE WHEN mc - ma > 0.10 THEN round(0.4095::DOUBLE * 1.1, 4) WHEN mc - ma < -0.10 THEN round(0.4095::DOUBLE * 0.9, 4) ELSE 0.4095::DOUBLE END AS recommended_t FROM ec""")
def overconfidence(spark, d):
    return calibrate.report(V.records(spark, d), ["batch_id"]).select("batch_id", "mean_conf", "mean_acc", "overconfidence", "needs_recal", "recommended_t")


@query(f"WITH {V.RECORDS}, {_EVAL} SELECT pred_class, count(*) AS n, round(avg(conf), 4) AS mean_conf, round(avg(acc), 4) AS mean_acc, round(avg(conf) - avg(acc), 4) AS overconfidence FROM ev GROUP BY pred_class HAVING count(*) >= 3")
def calibration_by_class(spark, d):
    return calibrate.by_class(V.records(spark, d))


# hypotheses


@query(f"""WITH {V.RECORDS}, tests(axis, value) AS (VALUES {", ".join(f"('{a}', '{v}')" for a, v in TESTS)}),
rows AS (SELECT t.axis, t.value, confidence_score / 10 AS c, coalesce(lower(CASE t.axis WHEN 'sex' THEN sex WHEN 'site' THEN site WHEN 'flag' THEN flag ELSE pred_class END), 'nan') = lower(t.value) AS g FROM people, tests t),
ag AS (SELECT axis, value, count(*) FILTER (g) AS na, count(*) FILTER (NOT g) AS nb, avg(c) FILTER (g) AS ma, avg(c) FILTER (NOT g) AS mb, var_samp(c) FILTER (g) AS va, var_samp(c) FILTER (NOT g) AS vb FROM rows GROUP BY axis, value)
SELECT axis, value, na AS n_group, nb AS n_rest, round(ma, 4) AS mean_conf_group, round(mb, 4) AS mean_conf_rest, CASE WHEN ma < mb THEN 'lower' ELSE 'higher' END AS direction,
round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0::DOUBLE / na + 1.0::DOUBLE / nb)), 4) AS t_statistic FROM ag""")
def ttest_group_vs_rest(spark, d):
    out = hypothesis.test(V.records(spark, d, site=True), TESTS, with_p=False)
    return out.select("axis", "value", "n_group", "n_rest", "mean_conf_group", "mean_conf_rest", "direction", "t_statistic")


@query(f"""WITH {V.RECORDS}, tests(axis, value) AS (VALUES {", ".join(f"('{a}', '{v}')" for a, v in TESTS)}),
src AS (SELECT axis || '|' || value || '|' || (coalesce(lower(CASE t.axis WHEN 'sex' THEN sex WHEN 'site' THEN site WHEN 'flag' THEN flag ELSE pred_class END), 'nan') = lower(t.value)) AS grp, mel_prob, human_label FROM people, tests t WHERE human_label IS NOT NULL),
{auc_sql("grp", "mel_prob", "(human_label = 'mel')", "src")}
SELECT split_part(g, '|', 1) AS axis, split_part(g, '|', 2) AS value, max(auc) FILTER (g LIKE '%|true') AS mel_auc_group, max(auc) FILTER (g LIKE '%|false') AS mel_auc_rest FROM auc GROUP BY ALL""")
def hypothesis_results(spark, d):
    """AUC of both sides; ttest_group_vs_rest has the other columns, tests the p-value."""
    return hypothesis.test(V.records(spark, d, site=True), TESTS, with_p=False).select("axis", "value", "mel_auc_group", "mel_auc_rest")


_PATTERNS = (("worse.*(eau|tion)", "site", "torso"), ("en.*(der|que)", "sex", "female"), ("the", "flag", "LOW_CONFIDENCE"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'worse.*(eau|tion)') THEN 'site' WHEN regexp_matches(lower(text), 'en.*(der|que)') THEN 'sex' WHEN regexp_matches(lower(text), 'the') THEN 'flag' END AS axis,
CASE WHEN regexp_matches(lower(text), 'worse.*(eau|tion)') THEN 'torso' WHEN regexp_matches(lower(text), 'en.*(der|que)') THEN 'female' WHEN regexp_matches(lower(text), 'the') THEN 'LOW_CONFIDENCE' END AS value FROM conversations WHERE role = 'user'""")
def hypothesis_parse(spark, d):
    asked = V.table(spark, d, "conversations").where(F.col("role") == "user")
    return hypothesis.parse(asked, "text", _PATTERNS).select("conv_id", "turn", "axis", "value")


# curation

_UPPER = [c.upper() for c in CLASSES]


def _onehot(spark, d):
    raw = V.records(spark, d)
    return raw.select(F.col("image_id").alias("image"), *((F.col("pred_class") == c).cast("double").alias(c.upper()) for c in CLASSES), "l_partkey")


@query(rec("SELECT image_id AS image, upper(pred_class) AS label FROM records"))
def onehot_to_label(spark, d):
    return _onehot(spark, d).select("image", C.onehot_label(_UPPER).alias("label"))


@query(rec("SELECT image_id, CASE pred_class WHEN 'mel' THEN 'MEL' WHEN 'nv' THEN 'NV' WHEN 'bkl' THEN 'BKL' ELSE 'AKIEC' END AS label FROM records WHERE pred_class IN ('mel', 'nv', 'bkl', 'akiec')"))
def label_remap(spark, d):
    out = V.records(spark, d).select("image_id", C.remap("pred_class", {"mel": "MEL", "nv": "NV", "bkl": "BKL", "akiec": "AKIEC", "df": None}).alias("label"))
    return out.where(F.col("label").isNotNull())


def _three_sources(spark, d):
    raw = V.raw_records(spark, d)
    a, b, c = (raw.where(F.col("dataset") == x) for x in ("DS_A", "DS_B", "DS_C"))
    one = a.select(F.col("dup_id").alias("image_id"), F.col("image_id").alias("image_path"), "dataset", "sex")
    two = b.select(F.col("image_id").alias("image_path"), F.col("dup_id").alias("image_id"), "dataset")
    three = c.select(F.col("dup_id").alias("image_id"), F.col("image_id").alias("image_path"), "dataset", "sex")
    return [one, two, three]


_SOURCES = "srcs AS (SELECT dup_id AS image_id, image_id AS image_path, dataset, CASE WHEN dataset = 'DS_B' THEN NULL ELSE sex END AS sex FROM raw)"


@query(f"WITH {V.RECORDS}, {_SOURCES} SELECT image_id, image_path, dataset, sex FROM srcs")
def union_align(spark, d):
    return curate.merge([curate.align(f) for f in _three_sources(spark, d)]).select("image_id", "image_path", "dataset", "sex")


@query(f"WITH {V.RECORDS}, {_SOURCES}, n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY dataset, image_path) AS nth FROM srcs) SELECT image_id, image_path, dataset, sex FROM n WHERE nth = 1")
def dedupe_first_wins(spark, d):
    rows = curate.merge([curate.align(f) for f in _three_sources(spark, d)]).select("image_id", "image_path", "dataset", "sex", "priority")
    return curate.first_wins(rows, "image_id", "priority", "image_path").select("image_id", "image_path", "dataset", "sex")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l JOIN orders ON o_orderkey = l_orderkey WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 10)")
def with_existing_file(spark, d):
    files = V.table(spark, d, "part").where("p_size <= 10").select(F.concat(F.lit("/img/"), "p_partkey", F.lit(".jpg")).alias("path"))
    rows = V.table(spark, d, "lineitem").join(V.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    return curate.with_file(rows.withColumn("key", F.col("l_partkey").cast("string")), files, "key").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT count(*) - count(DISTINCT o_custkey) AS leaking_groups FROM (SELECT DISTINCT o_custkey, 0 AS split FROM orders)")
def group_split_leakage(spark, d):
    return curate.leaks(curate.group_split(V.table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey"), "o_custkey")


@query("SELECT count(*) FILTER (a <> b) AS leaking_groups FROM (SELECT min(o_orderkey % 5 = 0) AS a, max(o_orderkey % 5 = 0) AS b FROM orders GROUP BY o_custkey)")
def leaks_of_a_row_split(spark, d):
    """Customers in both parts where orders, not customers, are split."""
    rows = V.table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 5 == 0, "val").otherwise("train").alias("split"))
    return curate.leaks(rows, "o_custkey")


@query("""WITH g AS (SELECT DISTINCT o_custkey FROM orders), r AS (SELECT o_custkey, row_number() OVER (ORDER BY substr(md5(concat(o_custkey, '|42')), 1, 15), o_custkey) AS nth, count(*) OVER () AS n FROM g),
s AS (SELECT o_orderstatus, CASE WHEN nth <= ceil(0.2::DOUBLE * n) THEN 'val' ELSE 'train' END AS split FROM orders JOIN r USING (o_custkey))
SELECT o_orderstatus, split, count(*) AS n FROM s GROUP BY GROUPING SETS ((o_orderstatus, split), (o_orderstatus))""")
def split_counts(spark, d):
    rows = curate.group_split(V.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey", exact=True)
    return curate.distribution(rows, "o_orderstatus", "split")


@query("SELECT 'val' AS split, CAST(ceil(0.2 * count(DISTINCT o_custkey)) AS BIGINT) AS groups FROM orders UNION ALL SELECT 'train', count(DISTINCT o_custkey) - CAST(ceil(0.2 * count(DISTINCT o_custkey)) AS BIGINT) FROM orders")
def split_sizes(spark, d):
    rows = curate.group_split(V.table(spark, d, "orders").select("o_custkey"), "o_custkey", exact=True)
    return rows.groupBy("split").agg(F.countDistinct("o_custkey").alias("groups"))


@query(rec("SELECT pred_class, n, round(min(n) OVER () / CAST(n AS DOUBLE), 4) AS weight FROM (SELECT pred_class, count(*) AS n FROM records GROUP BY pred_class)"))
def class_weights(spark, d):
    return curate.class_weights(V.records(spark, d), "pred_class")


@query(rec("SELECT human_label, dataset, count(*) AS n FROM records GROUP BY human_label, dataset UNION ALL SELECT human_label, NULL, count(*) FROM records GROUP BY human_label"))
def label_distribution(spark, d):
    return curate.distribution(V.records(spark, d), "human_label", "dataset")


@query(f"""WITH {V.RECORDS}, c AS (SELECT avg(CASE WHEN sex IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS sex, avg(CASE WHEN l_partkey % 7 > 0 THEN 1.0::DOUBLE ELSE 0 END) AS age, avg(CASE WHEN l_suppkey % 5 > 1 THEN 1.0::DOUBLE ELSE 0 END) AS site FROM people)
SELECT 'sex' AS "column", round(sex * 100, 2) AS percent FROM c UNION ALL SELECT 'age', round(age * 100, 2) FROM c UNION ALL SELECT 'site', round(site * 100, 2) FROM c""")
def metadata_coverage(spark, d):
    """Parts of one number in seven have no age, two suppliers in five no site."""
    rows = V.records(spark, d, age=True, site=True)
    rows = rows.withColumns({"age": F.when(F.col("l_partkey") % 7 > 0, F.col("age")), "site": F.when(F.col("l_suppkey") % 5 > 1, F.col("site"))})
    return curate.coverage(rows, ["sex", "age", "site"])


@query(rec(f"SELECT s.dataset, c.pred_class, count(r.image_id) AS n FROM (SELECT DISTINCT dataset FROM records) s CROSS JOIN (SELECT unnest({V._NAMES}) AS pred_class) c LEFT JOIN records r ON r.dataset = s.dataset AND r.pred_class = c.pred_class GROUP BY s.dataset, c.pred_class"))
def dataset_summary(spark, d):
    return curate.zero_filled(V.records(spark, d), ["dataset"], "pred_class", CLASSES)


# ingest checks


@query("WITH m AS (SELECT doc_id, md5(text) AS md5 FROM documents), f AS (SELECT *, min(doc_id) OVER (PARTITION BY md5) AS first FROM m) SELECT doc_id, CASE WHEN md5 IS NOT NULL AND first <> doc_id THEN CAST(first AS VARCHAR) END AS duplicate_of FROM f")
def content_duplicates(spark, d):
    rows = V.table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"))
    return ingest_qc.duplicates(rows, path="doc_id").select("doc_id", F.col("duplicate_of").cast("string").alias("duplicate_of"))


@query("SELECT doc_id, CASE WHEN n_chars < 100 THEN 'too_small' WHEN n_chars > 8192 THEN 'too_large' END AS issue FROM documents WHERE n_chars < 100 OR n_chars > 8192")
def size_outliers(spark, d):
    rows = V.table(spark, d, "documents").select("doc_id", C.messages((F.col("n_chars") < 100, "too_small"), (F.col("n_chars") > DEFAULT.max_side, "too_large")).alias("issues"))
    return rows.where(F.size("issues") > 0).select("doc_id", F.get("issues", F.lit(0)).alias("issue"))


def _pages(spark, d):
    rows = V.table(spark, d, "pages").select(F.col("page_id").alias("path"), F.length("html").alias("height"), F.length("html").alias("width"), F.md5("html").alias("md5"))
    rows = rows.withColumns({"saturation": F.col("path") % 100 + 5.0, "brightness": F.col("path") % 255 + 0.0, "rename_to": F.lit(None).cast("string")})
    return ingest_qc.issues(ingest_qc.duplicates(rows))


_PAGES = """pg AS (SELECT page_id AS path, length(html) AS h, min(page_id) OVER (PARTITION BY md5(html)) AS first, page_id % 100 + 5.0 AS sat, page_id % 255 + 0.0 AS val FROM pages),
iss AS (SELECT *, first <> path AS dup, h < 32 AS small, h > 8192 AS large, sat < 10 OR val < 20 OR val > 250 AS ood FROM pg)"""


@query(f"""WITH {_PAGES} SELECT count(*) AS total, CAST(0 AS BIGINT) AS corrupt, count(*) FILTER (dup) AS duplicates, count(*) FILTER (small) AS too_small, count(*) FILTER (large) AS too_large, count(*) FILTER (ood) AS ood_flagged,
CAST(0 AS BIGINT) AS renamed, count(*) FILTER (NOT (dup OR small OR large OR ood)) AS clean_count, count(*) FILTER (dup) + count(*) FILTER (small) + count(*) FILTER (ood) AS issue_count, count(*) - count(*) FILTER (dup) AS ready_count FROM iss""")
def ingest_report(spark, d):
    return ingest_qc.report(_pages(spark, d))


@query(f"WITH {_PAGES} SELECT path, CASE WHEN dup THEN 'remove_duplicate' WHEN small OR large OR ood THEN 'flag' ELSE 'clean' END AS action FROM iss")
def ingest_actions(spark, d):
    return _pages(spark, d).select("path", "action")


@query("""WITH f AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN concat('/a/', upper(p_name), ' ', p_partkey % 50, '.jpg') ELSE concat('/a/', replace(lower(p_name), ' ', '_'), '_', p_partkey % 50, '.jpg') END AS path FROM part),
u AS (SELECT DISTINCT path FROM f), t AS (SELECT path, concat('/a/', replace(lower(substr(path, 4)), ' ', '_')) AS target FROM u),
w AS (SELECT target, min(path) AS by_path FROM t WHERE target <> path GROUP BY target)
SELECT t.path, CASE WHEN w.by_path = t.path AND NOT EXISTS (SELECT 1 FROM u WHERE u.path = t.target) THEN t.target END AS rename_to FROM t LEFT JOIN w ON w.target = t.target""")
def filename_plan(spark, d):
    n, k = F.col("p_name"), (F.col("p_partkey") % 50).cast("string")
    path = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/a/"), F.upper(n), F.lit(" "), k, F.lit(".jpg"))).otherwise(F.concat(F.lit("/a/"), C.clean_name(n), F.lit("_"), k, F.lit(".jpg")))
    return ingest_qc.rename_plan(V.table(spark, d, "part").select(path.alias("path")).distinct()).select("path", "rename_to")


# papers

_HITS = " + ".join(f"CASE WHEN contains(lower(concat(coalesce(title, ''), ' ', coalesce(abstract_excerpt, ''))), '{k}') THEN 1 ELSE 0 END" for k in KEYWORDS)
_FIRST = "ft AS (SELECT *, row_number() OVER (PARTITION BY substr(lower(title), 1, 60) ORDER BY doc_id) AS nth FROM papers WHERE length(title) > 0)"


@query(f"WITH {V.PAPERS} SELECT doc_id, round(({_HITS}) / {float(len(KEYWORDS))}::DOUBLE, 3) AS relevance FROM papers")
def keyword_relevance(spark, d):
    return papers.with_relevance(V.papers(spark, d), KEYWORDS).select("doc_id", "relevance")


@query(f"WITH {V.PAPERS}, {_FIRST} SELECT doc_id, title FROM ft WHERE nth = 1")
def title_dedupe(spark, d):
    return papers.first_by_title(V.papers(spark, d), "doc_id").select("doc_id", "title")


@query(f"WITH {V.PAPERS}, {_FIRST} SELECT doc_id, round(({_HITS}) / {float(len(KEYWORDS))}::DOUBLE, 3) AS relevance FROM ft WHERE nth = 1 ORDER BY relevance DESC, doc_id LIMIT 20")
def top_papers(spark, d):
    return papers.rank(V.papers(spark, d), "doc_id", keywords=KEYWORDS).select("doc_id", "relevance")


@query(f'WITH {V.PAPERS} SELECT count(*) AS total, count(DISTINCT substr(lower(title), 1, 60)) AS "unique", count(DISTINCT query) AS queries FROM papers')
def literature_totals(spark, d):
    return papers.totals(V.papers(spark, d))


# questions and conversations


def _count_sql(words) -> str:
    return " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in words)


@query(f"SELECT conv_id, turn, CASE WHEN {_count_sql(config.DATA_KEYWORDS)} >= {_count_sql(config.KNOWLEDGE_KEYWORDS)} THEN 'data' ELSE 'knowledge' END AS intent FROM conversations WHERE role = 'user'")
def intent_classify(spark, d):
    asked = V.table(spark, d, "conversations").where(F.col("role") == "user")
    return questions.classify(asked, "text").select("conv_id", "turn", "intent")


_LIBRARY = {"A": "the and of to", "B": "de la que et", "C": "der die und en", "D": "one two three four"}


@query("""WITH q AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM conversations WHERE role = 'user'),
s AS (SELECT conv_id, turn, id, n, len(list_intersect(w, l)) / 4.0::DOUBLE AS share FROM q, (VALUES ('A', 0, ['the', 'and', 'of', 'to']), ('B', 1, ['de', 'la', 'que', 'et']), ('C', 2, ['der', 'die', 'und', 'en']), ('D', 3, ['one', 'two', 'three', 'four'])) AS lib(id, n, l))
SELECT conv_id, turn, CASE WHEN max(share) > 0.4 THEN first(id ORDER BY share DESC, n) END AS question_id FROM s GROUP BY conv_id, turn""")
def question_match(spark, d):
    asked = V.table(spark, d, "conversations").where(F.col("role") == "user")
    return questions.match(asked, "text", _LIBRARY).select("conv_id", "turn", "question_id")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6")
def last_turns(spark, d):
    return questions.last_turns(V.table(spark, d, "conversations").select("conv_id", "turn", "role"))


# scans


def scan_sql(sql: str) -> str:
    return f"WITH {V.SCANS} {sql}"


@query(scan_sql("SELECT scan_id, patient_id, \"timestamp\", verdict FROM scans WHERE patient_id = 7"))
def patient_history(spark, d):
    return questions.patient_history(V.scans(spark, d), 7).select("scan_id", "patient_id", "timestamp", "verdict")


@query(scan_sql("SELECT patient_id, count(*) AS scans FROM scans GROUP BY patient_id"))
def history_counts(spark, d):
    return questions.history_counts(V.scans(spark, d))


@query(scan_sql("SELECT scan_id, \"timestamp\", verdict, pred_class, confidence FROM scans ORDER BY \"timestamp\" DESC, scan_id LIMIT 50"))
def audit_log(spark, d):
    return questions.audit_log(V.scans(spark, d))


@query(scan_sql("SELECT scan_id, verdict FROM scans WHERE verdict = 'REVIEW_REQUIRED' AND pred_class = 'click' AND contains(CAST(scan_id AS VARCHAR), '77')"))
def scan_search(spark, d):
    rows = V.scans(spark, d).select(F.concat(F.lit("Scan"), "scan_id").alias("scan_id"), "verdict", "pred_class")
    out = questions.search(rows, "scan", "REVIEW_REQUIRED", "click").where(F.contains("scan_id", F.lit("77")))
    return out.select(F.substring("scan_id", 5, 20).cast("long").alias("scan_id"), "verdict")


@query(scan_sql("SELECT CAST(CAST(\"timestamp\" AS DATE) AS VARCHAR) AS day, count(*) AS total, count(*) FILTER (verdict = 'CANCER_FLAGGED') AS flagged, count(*) FILTER (verdict = 'REVIEW_REQUIRED') AS review, count(*) FILTER (verdict = 'NORMAL') AS normal FROM scans GROUP BY day"))
def scan_stats(spark, d):
    return questions.scan_stats(V.scans(spark, d).withColumn("day", F.to_date("timestamp").cast("string")), ["day"])


@query(scan_sql("SELECT scan_id, pred_class, confidence, \"timestamp\" FROM scans WHERE verdict = 'CANCER_FLAGGED' AND \"timestamp\" >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 7 DAY"))
def flagged_last_days(spark, d):
    return questions.recently_flagged(V.scans(spark, d), F.lit("2024-01-25 00:00:00").cast("timestamp_ntz").cast("timestamp")).select("scan_id", "pred_class", "confidence", "timestamp")


@query(scan_sql("SELECT scan_id, verdict, confidence FROM scans WHERE scan_id = 42"))
def scan_by_id(spark, d):
    return questions.by_id(V.scans(spark, d), 42).select("scan_id", "verdict", "confidence")


# reports


@query(drift_sql("SELECT concat('drift-', batch_id) AS id, concat('Drift ', severity) AS title, flags AS body, severity, (SELECT count(*) FROM rep WHERE severity <> 'OK') AS matching FROM rep WHERE severity <> 'OK' ORDER BY batch_id DESC, id LIMIT 50"))
def alerts_latest(spark, d):
    rows = drift.report(V.records(spark, d), ["batch_id"])
    feed = streams.alerts_of(rows).withColumn("timestamp", F.col("id"))
    return questions.alerts(feed, unread_only=True).select("id", "title", "body", "severity", "matching")


@query(drift_sql("SELECT batch_id, severity, kl_divergence FROM rep ORDER BY batch_id DESC LIMIT 1"))
def latest_report(spark, d):
    return io.latest(drift.report(V.records(spark, d), ["batch_id"]), "batch_id").select("batch_id", "severity", "kl_divergence")


def _log(spark, d):
    kind = F.col("event_type")
    return V.table(spark, d, "events").select(kind.alias("agent"), F.col("ts").alias("timestamp"), F.col("event_id").alias("run_count"), F.when(kind == "error", "error").otherwise("success").alias("status"))


@query("SELECT event_type AS agent, ts AS \"timestamp\", event_id AS run_count FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def run_log_tail(spark, d):
    return io.tail(_log(spark, d)).select("agent", "timestamp", "run_count")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS INTEGER) AS run_count FROM events")
def run_counter(spark, d):
    rows = V.table(spark, d, "events").select("event_id", F.col("event_type").alias("agent"), F.col("ts").alias("timestamp"))
    return io.numbered(rows, tie="event_id").select("event_id", "run_count")


@query("SELECT event_type AS agent, count(*) AS runs, max(ts) AS last_run, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS last_status, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY event_type")
def agent_summary(spark, d):
    from . import pipeline

    return pipeline.status(_log(spark, d))


_MSG = """SELECT batch_id, concat_ws('; ', CASE WHEN annotation_conflict > 0 THEN concat(annotation_conflict, ' annotation conflict(s)') END, CASE WHEN ambiguous > 0 THEN concat(ambiguous, ' ambiguous case(s)') END,
CASE WHEN low_confidence > 0 THEN concat(low_confidence, ' low-confidence prediction(s)') END, CASE WHEN ok > 0 AND annotation_conflict = 0 THEN concat(ok, ' passed without issues') END) AS messages"""


@query(rec(f"{_MSG} FROM (SELECT batch_id, {_FLAG_COUNTS} FROM records GROUP BY batch_id)"))
def qa_messages(spark, d):
    return qa.messages(qa.flag_counts(V.records(spark, d), ["batch_id"])).select("batch_id", F.concat_ws("; ", "messages").alias("messages"))


# the ten data questions, over the views

def _metrics(spark, d):
    """Metrics of the records themselves: sensitivity and its like for the positive class."""
    m, y = F.col("pred_class") == "mel", F.col("human_label") == "mel"
    rows = V.records(spark, d).agg(F.count_if(m & y).alias("tp"), F.count_if(~m & y).alias("fn"), F.count_if(~m & ~y).alias("tn"), F.count_if(m & ~y).alias("fp"))
    rate = lambda a, b: F.round(F.col(a) / (F.col(a) + F.col(b)), 4)
    return rows.select(rate("tp", "fn").alias("sensitivity"), rate("tn", "fp").alias("specificity"), rate("fn", "tp").alias("fnr"))


_CONF = "cf AS (SELECT count(*) FILTER (pred_class = 'mel' AND human_label = 'mel') AS tp, count(*) FILTER (pred_class <> 'mel' AND human_label = 'mel') AS fn, count(*) FILTER (pred_class <> 'mel' AND human_label <> 'mel') AS tn, count(*) FILTER (pred_class = 'mel' AND human_label <> 'mel') AS fp FROM records), mt AS (SELECT round(tp / (tp + fn), 4) AS sensitivity, round(tn / (tn + fp), 4) AS specificity, round(fn / (tp + fn), 4) AS fnr FROM cf)"


@query(scan_sql("SELECT count(*) AS \"count\" FROM scans WHERE verdict = 'CANCER_FLAGGED' AND \"timestamp\" >= TIMESTAMP '2024-01-18 00:00:00'"))
def q01_flagged_this_week(spark, d):
    return questions.answer("Q01", {"scans": V.scans(spark, d)}, as_of=F.lit("2024-01-25 00:00:00").cast("timestamp_ntz").cast("timestamp"))


@query(f"WITH {V.RECORDS}, {_CONF}, c AS (SELECT batch_id, count(*) AS total FROM records GROUP BY batch_id ORDER BY batch_id DESC LIMIT 1) SELECT batch_id, total, fnr, sensitivity, 'metrics' AS source FROM c, mt")
def q02_last_batch_fnr(spark, d):
    out = questions.answer("Q02", {"metrics": _metrics(spark, d), "flag_counts": qa.flag_counts(V.records(spark, d), ["batch_id"])})
    return out.select("batch_id", "total", "fnr", "sensitivity", "source")


@query(_all_axes_sql("SELECT grp AS \"group\", auc FROM grps WHERE axis = 'site' AND auc IS NOT NULL ORDER BY auc, grp LIMIT 3"))
def q03_weakest_sites(spark, d):
    return questions.answer("Q03", {"groups": fairness.by_axis(V.records(spark, d, site=True), "site")}).select("group", "auc")


@query(rec("SELECT image_id, pred_class, human_label, confidence_score, (SELECT count(*) FROM records WHERE flag = 'ANNOTATION_CONFLICT') AS total_conflicts FROM records WHERE flag = 'ANNOTATION_CONFLICT' ORDER BY ts DESC, image_id LIMIT 20"))
def q04_conflicts(spark, d):
    return questions.answer("Q04", {"records": V.records(spark, d)})


@query(rec("SELECT count(*) FILTER (flag = 'LOW_CONFIDENCE') AS low_confidence_count, count(*) AS total, round(count(*) FILTER (flag = 'LOW_CONFIDENCE') / CAST(count(*) AS DOUBLE), 4) AS rate FROM records GROUP BY batch_id ORDER BY batch_id DESC LIMIT 1"))
def q05_low_confidence_rate(spark, d):
    return questions.answer("Q05", {"flag_counts": qa.flag_counts(V.records(spark, d), ["batch_id"])})


@query(f"WITH {V.RECORDS}, {_CONF} SELECT sensitivity, specificity, fnr FROM mt")
def q06_metrics(spark, d):
    return questions.answer("Q06", {"metrics": _metrics(spark, d)})


@query(drift_sql("SELECT severity, flags, kl_divergence AS kl_div, round(cm, 4) AS conf_mean FROM rep ORDER BY batch_id DESC LIMIT 1"))
def q07_drift(spark, d):
    return questions.answer("Q07", {"drift": drift.report(V.records(spark, d), ["batch_id"])}).withColumn("flags", F.concat_ws("; ", "flags"))


@query(uncertain_sql("SELECT image_id, pred_class, uncertainty_score FROM scored ORDER BY uncertainty_score DESC, image_id LIMIT 10"))
def q08_queue(spark, d):
    return questions.answer("Q08", {"queue": active.queue(active.uncertainty(V.records(spark, d)))}).select("image_id", "pred_class", "uncertainty_score")


@query(f"""WITH {V.RECORDS}, {_EVAL}, b AS (SELECT bin, count(*) AS n, sum(conf) AS c, sum(acc) AS a FROM bn GROUP BY bin), t AS (SELECT sum(CASE WHEN bin IS NULL THEN 0 ELSE abs(a - c) END) / sum(n) AS e, sum(c) / sum(n) - sum(a) / sum(n) AS o FROM b)
SELECT round(e, 4) AS ece, round(o, 4) AS overconfidence, e > 0.10 OR abs(o) > 0.15 AS needs_recal, 0.4095::DOUBLE AS current_t, CASE WHEN o > 0.10 THEN round(0.4095::DOUBLE * 1.1, 4) WHEN o < -0.10 THEN round(0.4095::DOUBLE * 0.9, 4) ELSE 0.4095::DOUBLE END AS recommended_t FROM t""")
def q09_calibration(spark, d):
    return questions.answer("Q09", {"calibration": calibrate.report(V.records(spark, d))}).drop("recommendation")


@query(_all_axes_sql("SELECT axis, grp AS \"group\", n, auc FROM grps WHERE axis = 'sex'"))
def q10_sex_disparity(spark, d):
    return questions.answer("Q10", {"groups": fairness.by_axis(V.records(spark, d), "sex")})


@query(f"WITH {V.RECORDS}, {_CONF} SELECT sensitivity, specificity, fnr, concat_ws(',', CASE WHEN fnr > 0.20 THEN 'high_fnr' END, CASE WHEN sensitivity < 0.80 THEN 'low_sensitivity' END, CASE WHEN specificity > 0.95 THEN 'high_specificity' END) AS metric_flags FROM mt")
def metric_flags(spark, d):
    return questions.metric_flags(_metrics(spark, d)).withColumn("metric_flags", F.concat_ws(",", "metric_flags"))


@query(f"""WITH {V.RECORDS}, {_DRIFT}, {_UNCERTAIN}, {_EVAL}, b AS (SELECT bin, count(*) AS n, sum(conf) AS c, sum(acc) AS a FROM bn GROUP BY bin), t AS (SELECT sum(n) AS n, sum(c) / sum(n) - sum(a) / sum(n) AS o FROM b)
SELECT (SELECT count(*) FROM records WHERE flag = 'ANNOTATION_CONFLICT') AS conflicts, (SELECT count(*) FROM records WHERE flag = 'AMBIGUOUS') AS ambiguous, (SELECT count(*) FROM records WHERE flag = 'LOW_CONFIDENCE') AS low_confidence,
(SELECT severity FROM rep ORDER BY batch_id DESC LIMIT 1) AS severity, (SELECT CASE WHEN n < 10 THEN NULL WHEN o > 0.10 THEN 'increase temperature' WHEN o < -0.10 THEN 'decrease temperature' ELSE 'no recalibration needed' END FROM t) AS recommendation,
(SELECT round(avg(uncertainty_score) * 0.01, 4) FROM (SELECT * FROM scored ORDER BY uncertainty_score DESC, image_id LIMIT 50)) AS est_auc_gain""")
def key_findings(spark, d):
    rows = V.records(spark, d)
    totals = qa.flag_counts(rows, [])
    last = io.latest(drift.report(rows, ["batch_id"]), "batch_id")
    return questions.key_findings(totals, last, calibrate.report(rows), active.summary(active.queue(active.uncertainty(rows))))


@query(f"""{drift_sql("").rstrip()}, {V.PAPERS}, {_FIRST}, {_CONF}, ranked AS (SELECT title, round(({_HITS}) / {float(len(KEYWORDS))}::DOUBLE, 3) AS relevance FROM ft WHERE nth = 1 ORDER BY relevance DESC, doc_id LIMIT 20),
picked AS (SELECT * FROM ranked ORDER BY relevance DESC, title LIMIT 5) SELECT sensitivity, specificity, fnr, severity, kl_divergence, (SELECT string_agg(md5(title), ',' ORDER BY relevance DESC, title) FROM picked) AS papers
FROM mt, (SELECT severity, kl_divergence FROM rep ORDER BY batch_id DESC LIMIT 1)""")
def digest_row(spark, d):
    last = io.latest(drift.report(V.records(spark, d), ["batch_id"]), "batch_id").select("severity", "kl_divergence")
    out = questions.digest(_metrics(spark, d), last, papers.rank(V.papers(spark, d), "doc_id", keywords=KEYWORDS))
    return out.withColumn("papers", F.array_join(F.transform("papers", F.md5), ","))


def class_metrics(rows: DataFrame) -> DataFrame:
    """One row with the AUC of every class against the rest, of rounded probabilities."""
    pairs = F.explode(F.arrays_zip(C.strings(CLASSES).alias("c"), F.transform("probs", lambda p: F.round(p, 4)).alias("p")))
    each = rows.select("human_label", pairs.alias("x")).select("human_label", F.col("x.c").alias("of"), F.col("x.p").alias("score"))
    auc = stats.auc(each, ["of"], "score", F.col("human_label") == F.col("of"))
    return auc.groupBy().pivot("of", list(CLASSES)).agg(F.first("auc")).toDF(*(f"{c}_auc" for c in CLASSES))


@query(f"""WITH {V.RECORDS}, src AS (SELECT human_label, unnest([{", ".join(f"'{c}'" for c in CLASSES)}]) AS of, unnest([round(p, 4) FOR p IN probs]) AS score FROM records WHERE human_label IS NOT NULL), {auc_sql("of", "score", "(human_label = of)", "src")}
SELECT c.pred_class, auc.auc, c.full_name FROM (VALUES {_values(config.FULL_NAMES)}) AS c(pred_class, full_name) LEFT JOIN auc ON auc.g = c.pred_class""")
def class_auc_table(spark, d):
    return questions.class_auc_table(class_metrics(V.records(spark, d)))


# sources and sinks: given tables written out in a format, and read back


@query(rec("SELECT image_id AS image, upper(pred_class) AS label FROM records"))
def labels_csv_scan(spark, d):
    """Through the CSV sink by split, and the scan of all CSV files below a folder."""
    path = io.shared_dir(spark)
    one = _onehot(spark, d).drop("l_partkey").withColumn("split", F.when(F.pmod(F.xxhash64("image"), F.lit(5)) == 0, "val").otherwise("train"))
    io.write_split(one, path, "csv")
    return io.labels_csv(spark, path, schemas.ONEHOT_7).select("image", C.onehot_label(_UPPER).alias("label"))


@query("SELECT doc_id, lang, n_chars FROM documents")
def versioned_csv_scan(spark, d):
    """The newest version that exists; an optional file that does not exist adds nothing."""
    path = io.shared_dir(spark)
    V.table(spark, d, "documents").select("doc_id", "lang", "n_chars").write.option("header", True).csv(f"{path}/v1")
    return io.versioned_csv(spark, [f"{path}/v2", f"{path}/v1"], "doc_id long, lang string, n_chars long")


@query(rec("SELECT image_id, pred_class, confidence_score, flag FROM records"))
def report_records_scan(spark, d):
    """QA reports of a thousand orders each, one JSON file a report, and back to their records."""
    path = io.shared_dir(spark)
    rows = V.records(spark, d).select(F.floor(F.col("l_orderkey") / 1000).alias("part"), F.struct("image_id", "pred_class", "confidence_score", "flag").alias("r"))
    reports = rows.groupBy("part").agg(F.lit("query").alias("trigger"), F.count(F.lit(1)).cast("int").alias("total_images"), F.collect_list("r").alias("records"))
    reports.write.partitionBy("part").json(path)
    return io.report_records(spark, path).select("image_id", "pred_class", "confidence_score", "flag")


@query("SELECT coalesce(nullif(source, ''), '__HIVE_DEFAULT_PARTITION__') AS source, CAST(sum(coalesce(strlen(text), 0) + 1) AS BIGINT) AS bytes FROM documents GROUP BY ALL")
def file_scan(spark, d):
    """Texts in files by source, found by their suffix at any depth; only their sizes are read."""
    path = io.shared_dir(spark)
    V.table(spark, d, "documents").select("text", "source").write.partitionBy("source").text(path)
    spark.range(3).select(F.col("id").cast("string")).write.option("header", True).csv(f"{path}/other")
    found = io.image_files(spark, path, suffixes=(".txt",))
    return found.groupBy(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source")).agg(F.sum("length").alias("bytes"))


@query("SELECT CAST(sum(length(CAST(doc_id AS VARCHAR)) + coalesce(length(CAST(n_chars AS VARCHAR)), 0) + 2) AS BIGINT) AS bytes, true AS named FROM documents")
def session_listing(spark, d):
    path = io.shared_dir(spark)
    V.table(spark, d, "documents").select("doc_id", "n_chars").write.csv(path)
    listed = io.sessions(spark, path)
    return listed.agg(F.sum("size").alias("bytes"), F.bool_and((F.length("session") > 0) & F.col("created").isNotNull()).alias("named"))


@query("SELECT concat('scan-', n_nationkey) AS scan_id, n_name AS pred_class, CAST(n_regionkey AS INTEGER) AS priority FROM nation")
def scan_folder(spark, d):
    """One scan a nation, one JSON file a scan; a file that holds no scan is skipped."""
    path = io.shared_dir(spark)
    nation = V.table(spark, d, "nation")
    rows = nation.select(F.col("n_nationkey").alias("file"), F.concat(F.lit("scan-"), "n_nationkey").alias("scan_id"), F.col("n_name").alias("pred_class"), F.col("n_regionkey").alias("priority"))
    rows.write.partitionBy("file").json(path)
    nation.limit(1).select(F.lit("no scan")).write.text(f"{path}/file=-1")
    return io.scan_results(spark, path).select("scan_id", "pred_class", "priority")


@query(rec(f"SELECT batch_id, {_FLAG_COUNTS} FROM records GROUP BY batch_id"))
def all_reports_listing(spark, d):
    """One report a batch, written and listed with the time of its file."""
    path = io.shared_dir(spark)
    counts = qa.flag_counts(V.records(spark, d), ["batch_id"])
    counts.withColumn("report", F.col("batch_id")).write.partitionBy("report").json(path)
    listed = io.all_reports(spark, path, ", ".join(f"{c} long" for c in counts.columns))
    return listed.where(F.col("written").isNotNull()).select(*counts.columns)


@query("SELECT event_type AS agent, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS INTEGER) AS run_count, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, CAST(event_id AS VARCHAR) AS payload FROM events")
def run_log_append(spark, d):
    """Events as runs, appended to a log in two turns and read back; lines that are no JSON are skipped."""
    path = io.shared_dir(spark)
    rows = _log(spark, d).withColumnsRenamed({"run_count": "event_id"}).withColumns({"timestamp": F.col("timestamp").cast("timestamp"), "payload": F.col("event_id").cast("string")})
    runs = io.numbered(rows, order="event_id").drop("event_id")
    for side in (True, False):
        io.append_run(runs.where((F.col("run_count") % 2 == 0) == F.lit(side)), path)
    rows.limit(1).select(F.lit("{no run")).write.mode("append").text(path)
    return io.run_log(spark, path).select("agent", "run_count", "status", "payload")


@query("""WITH p AS (SELECT doc_id, concat('Title ', md5(text)) AS title, source AS journal, substr(repeat(md5(text), 10), 1, 300) AS abstract_excerpt FROM documents WHERE text IS NOT NULL)
SELECT CASE WHEN doc_id % 2 = 0 THEN 'pubmed' ELSE 'arxiv' END AS source, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) END AS pmid, title, CASE WHEN doc_id % 2 = 0 THEN journal END AS journal, CASE WHEN doc_id % 2 = 0 THEN '2001' END AS "year",
abstract_excerpt, CASE WHEN doc_id % 2 = 0 THEN concat('https://pubmed.ncbi.nlm.nih.gov/', doc_id, '/') ELSE concat('id-', doc_id) END AS url, 'skin' AS query, CAST(doc_id % 2 AS INTEGER) AS feed_no FROM p""")
def paper_feeds(spark, d):
    """Papers as article XML and as an Atom feed, read back and put together; those without a title go."""
    path, docs = io.shared_dir(spark), V.table(spark, d, "documents")
    digest, even = F.md5("text"), F.col("doc_id") % 2 == 0
    docs = docs.select("doc_id", "source", F.concat(F.lit("Title "), digest).alias("title"), F.repeat(digest, F.lit(10)).alias("body"))
    issue = F.struct(F.struct(F.lit("2001").alias("Year")).alias("PubDate")).alias("JournalIssue")
    article = F.struct(F.col("title").alias("ArticleTitle"), F.struct(F.col("body").alias("AbstractText")).alias("Abstract"), F.struct(F.col("source").alias("Title"), issue).alias("Journal"))
    rows = docs.where(even).select(F.struct(F.col("doc_id").cast("string").alias("PMID"), article.alias("Article")).alias("MedlineCitation"))
    rows.write.format("xml").option("rowTag", "PubmedArticle").option("rootTag", "PubmedArticleSet").save(f"{path}/articles")
    entries = docs.where(~even).select("title", F.col("body").alias("summary"), F.concat(F.lit("id-"), "doc_id").alias("id"))
    entries.write.format("xml").option("rowTag", "entry").option("rootTag", "feed").save(f"{path}/entries")
    return papers.union(io.paper_articles(spark, f"{path}/articles", "skin"), io.paper_entries(spark, f"{path}/entries", "skin"))


@query(f"WITH {V.RECORDS}, {_CONF} SELECT sensitivity, fnr, 0.9::DOUBLE AS auc FROM mt")
def metrics_lookup(spark, d):
    """A metrics file that lacks one field, which comes from the defaults."""
    path = io.shared_dir(spark)
    io.write_json(_metrics(spark, d).select("sensitivity", "fnr"), path)
    return io.metrics(spark, path, {"sensitivity": 0.5, "fnr": 0.5, "auc": 0.9})


_NTH = f"CASE l_partkey % 7 {' '.join(f'WHEN {i} THEN {chr(39)}{c.upper()}{chr(39)}' for i, c in enumerate(CLASSES))} END"
_IDX = f"list_position([{', '.join(repr(c.upper()) for c in CLASSES)}], label) - 1"


@query(rec(f"""SELECT image_id, image_path, label, CAST({_IDX} AS INTEGER) AS label_idx, patient_id, dataset, source, age, sex, site, priority FROM (
SELECT image_id, concat(image_id, '.jpg') AS image_path, {_NTH} AS label, CASE WHEN l_linenumber < 5 AND l_partkey % 4 > 1 THEN concat('les-', l_orderkey) ELSE image_id END AS patient_id, 'D2' AS dataset, 'hot' AS source,
CASE WHEN l_linenumber < 5 THEN CAST(l_suppkey % 90 AS DOUBLE) END AS age, CASE WHEN l_linenumber < 5 THEN sex END AS sex, CASE WHEN l_linenumber < 5 THEN l_linestatus END AS site, 0 AS priority
FROM raw WHERE l_returnflag = 'R' AND l_suppkey % 11 > 0
UNION ALL SELECT image_id, concat(image_id, '.jpg'), CASE l_partkey % 5 WHEN 0 THEN 'BKL' WHEN 1 THEN 'MEL' WHEN 2 THEN NULL ELSE CASE l_suppkey % 3 WHEN 0 THEN 'NV' WHEN 1 THEN 'MEL' END END,
CASE WHEN l_linenumber % 3 > 0 THEN concat('p', l_orderkey) ELSE image_id END, 'D3', 'binary', CAST(l_suppkey % 90 AS DOUBLE), sex, l_linestatus, 1 FROM raw WHERE l_returnflag <> 'R') WHERE label IS NOT NULL"""))
def curation_chain(spark, d):
    """Two label sets to image records: one-hot rows with metadata of some images, and diagnoses with a target to fall back on."""
    raw, c = V.raw_records(spark, d), F.col
    image = c("image_id").alias("image")
    # the fourth class comes as either of the two columns that mean it; a supplier in eleven has no class
    columns = {"MEL": 0, "NV": 1, "BCC": 2, "AK": 3, "BKL": 4, "DF": 5, "VASC": 6, "SCC": 3}
    side = {"AK": c("l_linenumber") % 2 == 0, "SCC": c("l_linenumber") % 2 == 1}
    known = c("l_suppkey") % 11 > 0
    hot = [(known & (c("l_partkey") % 7 == k) & side.get(n, F.lit(True))).cast("double").alias(n) for n, k in columns.items()]
    rows = raw.where(c("l_returnflag") == "R")
    lesion = F.when(c("l_partkey") % 4 > 1, F.concat(F.lit("les-"), "l_orderkey")).when(c("l_partkey") % 4 == 1, "").alias("lesion_id")
    age = (c("l_suppkey") % 90).cast("double").alias("age_approx")
    meta = rows.where(c("l_linenumber") < 5).select(image, lesion, age, "sex", c("l_linestatus").alias("anatom_site_general"))
    one = curate.normalise_onehot(rows.select(image, *hot, (~known).cast("double").alias("UNK")), config.ONEHOT_8, "D2", "hot", _UPPER, meta)
    diagnosis = F.get(F.array(*(F.lit(x) for x in ("Seborrheic Keratosis", "melanoma", "Unknown", None, "odd thing"))), (c("l_partkey") % 5).cast("int"))
    binary = raw.where(c("l_returnflag") != "R").select(
        c("image_id").alias("image_name"), F.when(c("l_linenumber") % 3 > 0, F.concat(F.lit("p"), "l_orderkey")).alias("patient_id"), diagnosis.alias("diagnosis"),
        F.when(c("l_suppkey") % 3 < 2, c("l_suppkey") % 3).cast("int").alias("target"), age, "sex", c("l_linestatus").alias("anatom_site_general_challenge"),
    )
    return curate.merge([one, curate.normalise_binary(binary, config.DIAGNOSES, "D3", "binary", _UPPER)])


#: Images of a task, more or less.
ROWS_A_TASK = 10_000


@query("""WITH img AS (SELECT concat('/in/', CASE WHEN p_partkey % 2 = 0 THEN 'img_' WHEN p_partkey % 3 = 0 THEN 'Only ' ELSE 'Img ' END, p_partkey // 2, '.png') AS path, p_partkey % 150 AS content,
CASE WHEN p_partkey % 17 = 0 THEN -1 ELSE 20 + p_size END AS height, greatest(p_partkey % 256, p_partkey * 7 % 256, p_partkey * 13 % 256) AS hi, least(p_partkey % 256, p_partkey * 7 % 256, p_partkey * 13 % 256) AS lo FROM part),
f AS (SELECT content, min(path) AS first FROM img WHERE height >= 0 GROUP BY content),
r AS (SELECT img.*, CASE WHEN height >= 0 AND first <> path THEN first END AS dup, CASE WHEN lower(replace(path, ' ', '_')) <> path AND lower(replace(path, ' ', '_')) NOT IN (SELECT path FROM img) THEN lower(replace(path, ' ', '_')) END AS rename_to,
CASE WHEN hi > 0 THEN (hi - lo) / CAST(hi AS DOUBLE) * 255 ELSE 0 END AS sat FROM img LEFT JOIN f USING (content)),
i AS (SELECT *, CASE WHEN height < 0 THEN 'corrupt' ELSE concat_ws(';', CASE WHEN least(height, 40) < 32 THEN 'too_small' END, CASE WHEN dup IS NOT NULL THEN concat('duplicate_of:', dup) END, CASE WHEN sat < 10 THEN 'ood:near_grayscale' END,
CASE WHEN hi < 20 THEN 'ood:near_black' END, CASE WHEN hi > 250 THEN 'ood:near_white' END, CASE WHEN rename_to IS NOT NULL THEN 'renamed' END) END AS issues FROM r)
SELECT path, CAST(height AS INTEGER) AS height, 40 AS width, issues, CASE WHEN issues = '' THEN 'clean' WHEN height < 0 THEN 'remove' WHEN dup IS NOT NULL THEN 'remove_duplicate' ELSE 'flag' END AS action, rename_to FROM i""")
def ingest_scan(spark, d):
    """Parts as images of one colour each, 40 wide, some of them corrupt, repeated or with names to clean."""
    p = F.col("p_partkey")
    name = F.concat(F.when(p % 2 == 0, "img_").when(p % 3 == 0, "Only ").otherwise("Img "), F.floor(p / 2).cast("string"), F.lit(".png"))
    good, height = p % 17 != 0, F.col("p_size").cast("int") + 20
    pixel = F.concat(*(F.lpad(F.hex(p * k % 256), 2, "0") for k in (1, 7, 13)))
    parts = V.table(spark, d, "part").withColumn("path", F.concat(F.lit("/in/"), name))
    # the table is small beside the pixels that its rows become, so its own splits would be few
    rows = parts.repartition(parts.count() // ROWS_A_TASK + 1, "path")
    files = rows.select("path", (p % 150).cast("string").cast("binary").alias("content"))
    images = rows.select("path", F.when(good, height).otherwise(-1).alias("height"), F.lit(40).alias("width"), F.lit(3).alias("channels"), F.when(good, F.unhex(F.repeat(pixel, height * 40))).alias("data"))
    return ingest_qc.scan(files, images).withColumn("issues", F.concat_ws(";", "issues"))


@query("SELECT doc_id, concat('doc-', doc_id, '/', lang) AS patient_id, CASE WHEN doc_id % 4 = 0 THEN concat('img-', doc_id) ELSE concat('les-', doc_id // 3) END AS lesion FROM documents WHERE lang IS NOT NULL")
def patient_keys(spark, d):
    """Patient and lesion keys; a missing lesion falls back to the image."""
    docs = V.table(spark, d, "documents").where(F.col("lang").isNotNull())
    lesion = F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("les-"), F.floor(F.col("doc_id") / 3).cast("string"))).otherwise("")
    return docs.select("doc_id", F.concat_ws("/", F.concat(F.lit("doc-"), "doc_id"), "lang").alias("patient_id"), C.patient_key(lesion, F.concat(F.lit("img-"), "doc_id")).alias("lesion"))


@query(f"WITH {V.RECORDS} SELECT image_id, sex, site FROM people")
def demographics_join(spark, d):
    """Demographics, of a table of their own, joined by image id to records that have none."""
    return fairness.with_demographics(V.records(spark, d).drop("sex"), V.demographics(spark, d)).select("image_id", "sex", "site")


@query("""SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS human_label FROM orders GROUP BY o_custkey""")
def last_label_wins(spark, d):
    """Of several labels of one image the last by order key counts."""
    orders = V.table(spark, d, "orders")
    labels = orders.select(F.concat(F.lit("c"), "o_custkey").alias("image"), F.col("o_orderstatus").alias("dx"), "o_orderkey")
    rows = orders.select("o_custkey").distinct().withColumn("path", F.concat(F.lit("/in/c"), "o_custkey", F.lit(".jpg")))
    return qa.human_labels(rows, labels, order="o_orderkey").select("o_custkey", "human_label")


# streams: the same rows through a file source


def _stream(spark, d, name: str) -> DataFrame:
    path = f"{d}/{name}[.]parquet"  # a pattern, so that a single file will do as well as a folder
    return streams.drops(spark, path, V.table(spark, d, name).schema, "parquet")


def _finished(q) -> None:
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def _counted(frame: DataFrame) -> DataFrame:
    """The final rows of an aggregating stream, which are few, by a memory table."""
    name = "predlens_" + uuid.uuid4().hex
    _finished(frame.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", io.shared_dir(frame.sparkSession)).trigger(availableNow=True).start())
    return frame.sparkSession.table(name)


def _written(frame: DataFrame) -> DataFrame:
    """The rows of an appending stream, by Parquet files in the shared folder."""
    spark, out = frame.sparkSession, io.shared_dir(frame.sparkSession)
    _finished(frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", io.shared_dir(spark)).trigger(availableNow=True).start())
    return spark.read.schema(frame.schema).parquet(out)


@query(rec(f"SELECT batch_id, {_FLAG_COUNTS} FROM records GROUP BY batch_id"))
def stream_flag_counts(spark, d):
    return _counted(streams.running_flag_counts(V.records(spark, d, lineitem=_stream(spark, d, "lineitem"))))


@query(rec("""SELECT image_id, pred_class, CASE WHEN l_linenumber = 1 AND pred_class <> 'nv' AND confidence_score >= 7 THEN 'ANNOTATION_CONFLICT' WHEN (down[1] - down[2]) * 10 < 2 THEN 'AMBIGUOUS'
WHEN top < 0.65 THEN 'LOW_CONFIDENCE' ELSE 'OK' END AS flag FROM records"""))
def stream_qa_on_upload(spark, d):
    """Uploaded logits, some with a label, as they come."""
    rows = V.raw_records(spark, d, _stream(spark, d, "lineitem")).withColumn("human_label", F.when(F.col("l_linenumber") == 1, "nv"))
    return _written(streams.qa_on_upload(rows, DEFAULT.temperature).select("image_id", "pred_class", "flag"))


@query(rec("SELECT CAST(floor(epoch(ts) / 2592000) * 30 AS BIGINT) AS window_day, count(*) AS n_images, " + ", ".join(f"round(count(*) FILTER (pred_class = '{c}') / CAST(count(*) AS DOUBLE), 6) AS {c}" for c in CLASSES) + " FROM records GROUP BY window_day"))
def stream_daily_drift(spark, d):
    out = _counted(streams.daily_drift(V.records(spark, d, lineitem=_stream(spark, d, "lineitem")), every="30 days"))
    return out.select(F.unix_date(F.to_date("window_start")).cast("long").alias("window_day"), "n_images", *(F.round(c, 6).alias(c) for c in CLASSES))


@query(drift_sql("SELECT batch_id, kl_divergence, severity FROM rep"))
def stream_drift_after_batch(spark, d):
    """Each micro-batch adds its sums exactly once; the reports come from all of them, however rows fall into turns."""
    out = io.shared_dir(spark)
    rows = V.records(spark, d, lineitem=_stream(spark, d, "lineitem"))
    _finished(jobs.drift_by_turns(rows, out, ["batch_id"], checkpoint=io.shared_dir(spark)))
    return jobs.drift_table(spark, out, ["batch_id"]).select("batch_id", "kl_divergence", "severity")


@query("SELECT DISTINCT md5(text) AS md5 FROM documents")
def stream_dedupe(spark, d):
    rows = _stream(spark, d, "documents").select(F.md5("text").alias("md5"), F.timestamp_seconds(F.col("doc_id") + 1_000_000_000).alias("ts"))
    return _written(streams.first_of_content(rows, within="3650 days").select("md5"))


@query(scan_sql("SELECT CAST(floor(epoch(\"timestamp\") / 86400) - i AS BIGINT) AS window_day, count(*) AS flagged FROM scans, (SELECT unnest(range(7)) AS i) WHERE verdict = 'CANCER_FLAGGED' GROUP BY window_day"))
def stream_rolling_flagged(spark, d):
    out = _counted(streams.rolling_flagged(V.scans(spark, d, _stream(spark, d, "events"))))
    return out.select(F.unix_date(F.to_date("window_start")).cast("long").alias("window_day"), "flagged")


@query(scan_sql("SELECT count(*) AS total, count(*) FILTER (verdict = 'CANCER_FLAGGED') AS flagged, count(*) FILTER (verdict = 'REVIEW_REQUIRED') AS review, count(*) FILTER (verdict = 'NORMAL') AS normal FROM scans"))
def stream_scan_stats(spark, d):
    return _counted(questions.scan_stats(V.scans(spark, d, _stream(spark, d, "events"))))


@query(rec("SELECT CAST(floor(epoch(ts) / 604800) * 7 AS BIGINT) AS window_day, count(*) AS n_images FROM records GROUP BY window_day"))
def stream_weekly_drift(spark, d):
    """The weekly job: the drift monitor over event-time weeks."""
    out = _counted(streams.daily_drift(V.records(spark, d, lineitem=_stream(spark, d, "lineitem")), every="7 days"))
    return out.select(F.unix_date(F.to_date("window_start")).cast("long").alias("window_day"), "n_images")


@query(drift_sql("SELECT concat('drift-', batch_id) AS id, concat('Drift ', severity) AS title, severity, false AS \"read\" FROM rep WHERE severity <> 'OK'"))
def stream_alerts(spark, d):
    """Drift reports dropped into a folder, and the alerts of those that are not OK as they come."""
    path = io.shared_dir(spark)
    reports = drift.report(V.records(spark, d), ["batch_id"]).select("batch_id", "severity", "flags")
    reports.write.json(path)
    return _written(streams.alerts_of(streams.drops(spark, path, reports.schema)).drop("body"))


@query(scan_sql("SELECT count(*) AS total, count(*) FILTER (verdict = 'CANCER_FLAGGED') AS flagged, count(*) FILTER (verdict = 'REVIEW_REQUIRED') AS review, count(*) FILTER (verdict = 'NORMAL') AS normal FROM scans"))
def stream_dashboard(spark, d):
    """The dashboard's memory table after one turn over what is there."""
    name = "predlens_" + uuid.uuid4().hex
    _finished(streams.dashboard(V.scans(spark, d, _stream(spark, d, "events")), name, every=None))
    return spark.table(name)
