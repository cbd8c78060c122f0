"""The registered queries of the scheduled and stateful monitors, and of joins along time."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import columns as C
from ..functions import stats
from ..operators import active, curate, drift, fairness, hypothesis, ingest_qc, papers, questions, sketches, temporal
from ..sources import io, papers_xml
from ..streaming import jobs, stateful, streams
from . import pipeline
from . import records as V
from .queries import _BAND, _CODES, _DRIFT, _EVAL, _HITS, _UNCERTAIN, KEYWORDS, TESTS, _finished, auc_sql, class_metrics, query, rec, scan_sql


def in_turns(drops: list[DataFrame], make: Callable[[DataFrame], DataFrame], seen: Callable[[StreamingQuery], None] | None = None) -> DataFrame:
    """Rows of an appending stream over a folder that the drops come into one after the other. After each the stream runs over what is
    there and ends; the next run goes on from its checkpoint."""
    spark = drops[0].sparkSession
    path, out, mark = (io.shared_dir(spark) for _ in range(3))
    for drop in drops:
        drop.write.mode("append").parquet(path)
        frame = make(streams.drops(spark, path, drop.schema, "parquet"))
        q = frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        _finished(q)
        if seen:
            seen(q)
    return spark.read.schema(frame.schema).parquet(out)


def _day(c: str, alias: str):
    return F.unix_date(F.to_date(c)).cast("long").alias(alias)


# weekly jobs


#: Lineitems of the first two drops, and those that come when their weeks are over.
_LATE, _NEW = "(l_linenumber > 5 AND l_shipdate < TIMESTAMP '1998-01-01')", "l_shipdate >= TIMESTAMP '1998-03-01'"


@query(f"""WITH {V.RECORDS}, {_EVAL}, wk AS (SELECT *, CAST(floor(epoch(ts) / 604800) * 7 AS BIGINT) AS week_day FROM bn WHERE NOT {_LATE}),
be AS (SELECT week_day, bin, count(*) AS n, sum(conf) AS c, sum(acc) AS a FROM wk GROUP BY week_day, bin), ec AS (SELECT week_day, sum(n) AS n, sum(CASE WHEN bin IS NULL THEN 0 ELSE abs(a - c) END) / sum(n) AS e, sum(c) / sum(n) AS mc, sum(a) / sum(n) AS ma FROM be GROUP BY week_day)
SELECT week_day, CAST(n AS BIGINT) AS n_eval, CASE WHEN n >= 10 THEN CAST(round(e * n * 1000) AS BIGINT) END AS gap, CASE WHEN n >= 10 THEN CAST(round((mc - ma) * n * 1000) AS BIGINT) END AS surplus, CASE WHEN n >= 10 THEN CASE WHEN mc - ma > 0.10 THEN round(0.4095::DOUBLE * 1.1, 4) WHEN mc - ma < -0.10 THEN round(0.4095::DOUBLE * 0.9, 4) ELSE 0.4095::DOUBLE END END AS recommended_t,
CASE WHEN n >= 10 THEN 'ok' ELSE 'insufficient_data' END AS status FROM ec WHERE week_day + 7 <= (SELECT max(epoch(ts)) / 86400 - 14 FROM raw)""")
def stream_weekly_calibration(spark, d):
    """The weekly calibration job. Rows come in three drops; those of the last are of weeks that are over, and are dropped. Weeks that
    the watermark has not passed at the end are still open. gap and surplus: the ECE and the over-confidence times the week's records, in
    thousandths, which are whole numbers."""
    rows = V.table(spark, d, "lineitem")
    drops = [rows.where(f"NOT {_LATE} AND NOT {_NEW}"), rows.where(f"NOT {_LATE} AND {_NEW}"), rows.where(_LATE)]
    out = in_turns(drops, lambda s: jobs.weekly_calibration(V.records(spark, d, lineitem=s), late="14 days", digits=12))
    whole = lambda c: F.round(F.col(c) * F.col("n_eval") * 1000).cast("long")
    return out.select(_day("week", "week_day"), "n_eval", whole("ece").alias("gap"), whole("overconfidence").alias("surplus"), "recommended_t", "status")


#: Documents come four hours after each other, from a time on that is above the watermark that a stream begins with.
_SEEN = "timestamp_seconds(1000000000 + doc_id * 14400)"


@query(f"""WITH {V.PAPERS}, f AS (SELECT *, 1000000000 + doc_id * 14400 AS sec, CASE WHEN query IN ('en', 'de') THEN 0 ELSE 1 END AS feed_no FROM papers),
wm AS (SELECT min(s) - 2 * 86400 AS closed FROM (SELECT max(sec) AS s FROM f GROUP BY feed_no)),
ft AS (SELECT *, sec // 604800 AS week, row_number() OVER (PARTITION BY sec // 604800, substr(lower(title), 1, 60) ORDER BY feed_no, doc_id) AS nth FROM f WHERE length(title) > 0),
r AS (SELECT CAST(week * 7 AS BIGINT) AS week_day, doc_id, round(({_HITS}) / {float(len(KEYWORDS))}::DOUBLE, 3) AS relevance FROM ft, wm WHERE nth = 1 AND (week + 1) * 604800 <= closed)
SELECT week_day, CAST(row_number() OVER (PARTITION BY week_day ORDER BY relevance DESC, doc_id) AS INTEGER) AS rank, doc_id, relevance FROM r QUALIFY rank <= 20""")
def stream_weekly_papers(spark, d):
    """The weekly literature job: two feeds, each title once a week whichever brings it, and the week's most relevant papers."""
    rows = V.papers(spark, d).withColumn("ts", F.expr(_SEEN))
    half = rows.agg(F.max("doc_id") / 2).first()[0] or 0

    def feeds(s: DataFrame) -> DataFrame:
        first = F.coalesce(F.col("query").isin("en", "de"), F.lit(False))
        return jobs.weekly_papers(s.where(first), s.where(~first), order=("doc_id",))

    out = in_turns([rows.where(F.col("doc_id") <= half), rows.where(F.col("doc_id") > half)], feeds)
    best = papers.rank_within(out, "week", "doc_id", keywords=KEYWORDS)
    return best.select(_day("week", "week_day"), "rank", "doc_id", "relevance")


# joins along time

_MONTHLY = """mon AS (SELECT dataset, date_trunc('month', ts) AS month, count(*) AS n_images, count(*) FILTER (pred_class = 'mel') / CAST(count(*) AS DOUBLE) AS mel FROM records GROUP BY ALL),
pub AS (SELECT dataset, CAST(month + INTERVAL 1 MONTH AS TIMESTAMP) AS published, n_images, mel FROM mon)"""


def _monthly(spark, d) -> DataFrame:
    """A drift report for each data set and month, published when the month is over."""
    shares = drift.class_shares(V.records(spark, d).withColumn("month", F.date_trunc("month", "ts")), ["dataset", "month"])
    return shares.select("dataset", F.expr("month + INTERVAL 1 MONTH").alias("published"), "n_images", "mel")


@query(f"""WITH {V.RECORDS}, {_MONTHLY} SELECT r.image_id, CAST(floor(epoch(p.published) / 86400) AS BIGINT) AS report_day, p.n_images, round(p.mel, 6) AS mel
FROM raw r ASOF LEFT JOIN pub p ON r.dataset = p.dataset AND r.ts >= p.published""")
def asof_last_report(spark, d):
    """Every scan with the last drift report of its data set before it; a third of all scans and more are of one data set."""
    rows = V.raw_records(spark, d).select("image_id", "dataset", "ts")
    out = temporal.asof_join(rows, _monthly(spark, d), ["dataset"], "ts", "published", ["published", "n_images", "mel"])
    return out.select("image_id", _day("published", "report_day"), "n_images", F.round("mel", 6).alias("mel"))


_SEVERITY = "CASE WHEN round(mel, 6) > 0.14 THEN 'HIGH' ELSE 'OK' END"


@query(f"""WITH {V.RECORDS}, {_MONTHLY}, sev AS (SELECT *, {_SEVERITY} AS severity FROM pub), nxt AS (SELECT *, lag(severity, 1, 'OK') OVER w AS was FROM sev WINDOW w AS (PARTITION BY dataset ORDER BY published)),
op AS (SELECT dataset, published, (SELECT min(o.published) FROM sev o WHERE o.dataset = n.dataset AND o.published > n.published AND o.severity = 'OK') AS ended FROM nxt n WHERE severity <> 'OK' AND was = 'OK')
SELECT r.image_id, CAST(floor(epoch(op.published) / 86400) AS BIGINT) AS alert_day FROM raw r JOIN op ON r.dataset = op.dataset AND r.ts >= op.published AND (op.ended IS NULL OR r.ts < op.ended)""")
def scans_during_alerts(spark, d):
    """Scans within the time that a drift alert of their data set was open: from the first report that is not OK to the next that is."""
    reports = _monthly(spark, d).withColumn("severity", F.expr(_SEVERITY))
    alerts = temporal.periods(reports, ["dataset"], "published", F.col("severity") != "OK")
    rows = V.raw_records(spark, d).select("image_id", "dataset", "ts")
    return temporal.interval_join(rows, alerts, ["dataset"], "ts", "begin", "end", ["begin"]).select("image_id", _day("begin", "alert_day"))


_SESSIONS = """m AS (SELECT patient_id, epoch_us("timestamp") AS t FROM scans WHERE "timestamp" IS NOT NULL{where}), s AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 14400000000 THEN 0 ELSE 1 END AS fresh FROM m WINDOW w AS (PARTITION BY patient_id ORDER BY t)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY patient_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS nth FROM s)
SELECT patient_id, min(t) AS begin_us, max(t) AS end_us, count(*) AS n FROM i GROUP BY patient_id, nth"""


def _micros(out: DataFrame) -> DataFrame:
    return out.select("patient_id", F.unix_micros("begin").alias("begin_us"), F.unix_micros("end").alias("end_us"), "n")


@query(scan_sql(", " + _SESSIONS.format(where="")))
def upload_sessions(spark, d):
    """Sessions of a patient's scans, which end where none follows within four hours."""
    return _micros(temporal.sessions(V.scans(spark, d), ["patient_id"], "timestamp", gap=4 * 3600))


_TARDY = "(event_id % 10 = 0 AND ts < TIMESTAMP '2024-01-05')"


@query(scan_sql(", " + _SESSIONS.format(where=" AND NOT (scan_id % 10 = 0 AND \"timestamp\" < TIMESTAMP '2024-01-05')") + " HAVING max(t) + 14400000000 <= (SELECT max(epoch_us(ts)) FROM events) - 86400000000"))
def stream_upload_sessions(spark, d):
    """The same as a stream: scans before and after the tenth of the month, and then some of its first days, too late to count."""
    rows = V.table(spark, d, "events")
    drops = [rows.where(f"NOT {_TARDY} AND ts < TIMESTAMP '2024-01-10'"), rows.where("ts >= TIMESTAMP '2024-01-10'"), rows.where(_TARDY)]
    return _micros(in_turns(drops, lambda s: temporal.stream_sessions(V.scans(spark, d, s), ["patient_id"], "timestamp", "4 hours", "1 day")))


# state across micro-batches


@query(f"""WITH {V.RECORDS}, {_MONTHLY}, sev AS (SELECT *, {_SEVERITY} AS severity FROM pub), nxt AS (SELECT *, lag(severity, 1, 'OK') OVER (PARTITION BY dataset ORDER BY published) AS previous FROM sev)
SELECT dataset, CAST(floor(epoch(published) / 86400) AS BIGINT) AS report_day, previous, severity FROM nxt WHERE severity <> previous""")
def stream_severity_changes(spark, d):
    """Drift reports as they come, a year or so at a time; an alert only where the severity is not that of the report before."""
    reports = _monthly(spark, d).withColumn("severity", F.expr(_SEVERITY)).select("dataset", F.col("published").alias("ts"), "severity")
    year = F.year("ts")
    out = in_turns([reports.where(year < 1997), reports.where((year >= 1997) & (year < 2000)), reports.where(year >= 2000)], lambda s: stateful.severity_changes(s, "dataset"))
    return out.select("dataset", _day("ts", "report_day"), "previous", "severity")


@query("WITH s AS (SELECT doc_id, md5(text) AS md5, doc_id - lag(doc_id) OVER (PARTITION BY md5(text) ORDER BY doc_id) AS since FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5 FROM s WHERE since IS NULL OR since >= 18")
def stream_unseen_content(spark, d):
    """Documents whose content did not come within three days before."""
    rows = V.table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"), F.expr(_SEEN).alias("ts"))
    half = rows.agg(F.max("doc_id") / 2).first()[0] or 0
    out = in_turns([rows.where(F.col("doc_id") <= half), rows.where(F.col("doc_id") > half)], lambda s: stateful.unseen_content(s, "md5", "doc_id", live="3 days"))
    return out.select("doc_id", "md5")


# statistics

_AXIS = "CASE t.axis WHEN 'sex' THEN sex WHEN 'site' THEN site WHEN 'flag' THEN flag ELSE pred_class END"


@query(f"""WITH {V.RECORDS}, tests(axis, value) AS (VALUES {", ".join(f"('{a}', '{v}')" for a, v in TESTS)}),
rows AS (SELECT t.axis, t.value, confidence_score / 10 AS c, coalesce(lower({_AXIS}), 'nan') = lower(t.value) AS g FROM people, tests t),
ag AS (SELECT axis, value, count(*) FILTER (g) AS na, count(*) FILTER (NOT g) AS nb, avg(c) FILTER (g) AS ma, avg(c) FILTER (NOT g) AS mb, var_samp(c) FILTER (g) AS va, var_samp(c) FILTER (NOT g) AS vb FROM rows GROUP BY axis, value),
ts AS (SELECT *, CAST(na + nb - 2 AS DOUBLE) AS v, abs((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0::DOUBLE / na + 1.0::DOUBLE / nb))) AS t FROM ag),
grid AS (SELECT *, least(t, 60) / 4000 AS h FROM ts),
p AS (SELECT axis, value, na, 1 - 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * h / 3 * list_sum([CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * (1 + (i * h) ** 2 / v) ** (-(v + 1) / 2) FOR i IN range(4001)]) AS p FROM grid)
SELECT axis, value, na AS n_group, CASE WHEN round(p, 4) = 0 THEN 0.0::DOUBLE ELSE round(p, 4) END AS p_value, p < 0.05 AS significant FROM p""")
def ttest_p_values(spark, d):
    """The p-values of the two-group tests, in built-in functions; the SQL sums the density over its own grid."""
    return hypothesis.test(V.records(spark, d, site=True), TESTS).select("axis", "value", "n_group", "p_value", "significant")


@query(f"WITH {V.RECORDS}, src AS (SELECT 'all' AS grp, probs[1] AS s, human_label FROM records), {auc_sql('grp', 's', chr(40) + 'human_label = ' + repr('mel') + chr(41), 'src')} SELECT n, auc FROM auc")
def auc_of_all_scores(spark, d):
    """The AUC of all records as one group, by scores that are not rounded: nearly as many distinct values as rows."""
    rows = V.records(spark, d).withColumn("score", F.get("probs", F.lit(0)))
    return stats.auc(rows, [], "score", F.col("human_label") == "mel", ranges=64).select("n", "auc")


_LEVEL = "grouping(human_label) * 4 + grouping(dataset) * 2 + grouping(sex)"


@query(rec(f"SELECT human_label, dataset, sex, CAST({_LEVEL} AS BIGINT) AS level, count(*) AS n, round(avg(confidence_score), 4) AS mean_score FROM records GROUP BY CUBE (human_label, dataset, sex)"))
def label_cube(spark, d):
    """Records and their mean score by label, data set and sex, by each pair of them, by each alone, and in all."""
    return curate.distributions(V.records(spark, d), ["human_label", "dataset", "sex"], mean_score=F.round(F.avg("confidence_score"), 4))


@query(rec("SELECT human_label, dataset, sex, CAST(CASE WHEN human_label IS NULL THEN 5 ELSE 3 END AS BIGINT) AS level, n FROM (SELECT human_label, NULL AS dataset, NULL AS sex, count(*) AS n FROM records GROUP BY human_label UNION ALL SELECT NULL, dataset, NULL, count(*) FROM records GROUP BY dataset)"))
def label_and_source_counts(spark, d):
    """Records by label, and by data set, in one aggregate."""
    return curate.distributions(V.records(spark, d), ["human_label", "dataset", "sex"], [["human_label"], ["dataset"]])


_ERROR = 2.3 / sketches.K**0.9


@query("""WITH e AS (SELECT CAST(floor(epoch(ts) / 604800) * 7 AS BIGINT) AS week_day, user_id, value FROM events), w AS (SELECT week_day, count(*) AS n, count(DISTINCT user_id) AS users, count(value) > 0 AS filled FROM e GROUP BY week_day)
SELECT week_day, n, users, filled AS median_holds, filled AS tail_holds, users > 0 AS users_hold FROM w""")
def weekly_sketches(spark, d):
    """Weeks merged from daily sketches, beside exact counts: whether the sketch's median and 95th percentile have the rank that is
    asked for, within the bound that the sketch states, and the distinct users the exact number, within 3 standard errors."""
    events = V.table(spark, d, "events")
    week = (F.floor(F.unix_date("day") / 7) * 7).cast("long").alias("week_day")
    weeks = sketches.read(sketches.merged(sketches.daily(events, "ts", "value", "user_id"), [week]), {"median": 0.5, "tail": 0.95})
    rows = events.withColumn("day", F.to_date("ts")).select(week, "user_id", "value").join(weeks.select("week_day", "median", "tail"), "week_day")
    rank = lambda c, op: F.count_if(F.col("value") < F.col(c)) if op == "<" else F.count_if(F.col("value") <= F.col(c))
    true = rows.groupBy("week_day").agg(F.countDistinct("user_id").alias("users"), F.count("value").alias("m"), *(rank(c, o).alias(f"{c}{i}") for c in ("median", "tail") for i, o in enumerate(("<", "<="))))
    holds = lambda c, q: (F.col(f"{c}0") <= (q + _ERROR) * F.col("m")) & (F.col(f"{c}1") >= (q - _ERROR) * F.col("m"))
    near = F.abs(F.col("distinct") - F.col("users")) <= 3 * 1.04 / 2 ** (sketches.LG_K / 2) * F.col("users")
    return weeks.join(true, "week_day").select("week_day", "n", "users", holds("median", 0.5).alias("median_holds"), holds("tail", 0.95).alias("tail_holds"), near.alias("users_hold"))


# sources


@query("""WITH p AS (SELECT doc_id, doc_id % 11 AS kind, concat('Title ', md5(text)) AS title FROM documents WHERE text IS NOT NULL)
SELECT CAST(doc_id AS VARCHAR) AS pmid, title, NULL AS error FROM p WHERE kind > 2
UNION ALL SELECT NULL, NULL, CASE kind WHEN 0 THEN 'no title' WHEN 1 THEN 'no XML' ELSE 'the record has no end' END FROM p WHERE kind <= 2""")
def paper_rejects(spark, d):
    """Documents as article XML in which some records have no title, are no XML, or have no end; every one comes back, as a paper or as a reject
    with its reason."""
    path, kind = io.shared_dir(spark), F.col("doc_id") % 11
    docs = V.table(spark, d, "documents").where(F.col("text").isNotNull())
    title = F.concat(F.lit("<ArticleTitle>"), F.when(kind == 0, "").otherwise(F.concat(F.lit("Title "), F.md5("text"))), F.when(kind == 1, "<i>").otherwise(""), F.lit("</ArticleTitle>"))
    record = F.concat(F.lit("<PubmedArticle><MedlineCitation><PMID>"), "doc_id", F.lit("</PMID><Article>"), title, F.lit("</Article></MedlineCitation>"))
    # a record that follows one without an end, itself without a title
    after = "\n<PubmedArticle><MedlineCitation><Article><ArticleTitle></ArticleTitle></Article></MedlineCitation>"
    docs.select(F.concat(record, F.when(kind == 2, after).otherwise(""), F.lit("</PubmedArticle>")).alias("value")).write.text(path)
    good, bad = papers_xml.read(spark, path)
    bad = bad.where(~F.col("record").startswith("<PubmedArticle><MedlineCitation><Article>")).select(F.regexp_extract("error", "^[^:]*", 0).alias("error"))
    return good.select("pmid", "title").unionByName(bad, allowMissingColumns=True)


@query("SELECT doc_id, lang, length(lang) > 0 AS known FROM documents")
def optional_csv_scan(spark, d):
    """An optional file that exists, joined to what one that doesn't adds nothing to."""
    path, docs = io.shared_dir(spark), V.table(spark, d, "documents")
    docs.select("doc_id", "lang").write.option("header", True).csv(path)
    found = [f for p in (path, f"{path}-none", None) if (f := io.optional_csv(spark, p, "doc_id long, lang string")) is not None]
    out = reduce(DataFrame.unionByName, found)
    return docs.select("doc_id").join(out, "doc_id", "left").select("doc_id", "lang", (F.length("lang") > 0).alias("known"))


# reports


def _pipeline(spark, d, log: str | None = None) -> dict[str, DataFrame]:
    """The tables of the QA pipeline, all written by now, over all records."""
    records = V.records(spark, d, age=True, site=True)
    out = pipeline.run(records.select("image_id", "batch_id", "probs", "pred_class", "human_label", "confidence_score", "mel_prob", "flag", "sex", "age", "site"), log)
    out.pop("records")
    return out


@query(f"""WITH {V.RECORDS}, {_DRIFT}, {_EVAL}, {_UNCERTAIN}, tot AS (SELECT count(*) FILTER (flag = 'ANNOTATION_CONFLICT') AS conflicts, count(*) FILTER (flag = 'AMBIGUOUS') AS ambiguous, count(*) FILTER (flag = 'LOW_CONFIDENCE') AS low_confidence FROM records),
cal AS (SELECT avg(conf) - avg(acc) AS over FROM ev), q AS (SELECT round(avg(uncertainty_score) * 0.01, 4) AS est_auc_gain FROM (SELECT * FROM scored ORDER BY uncertainty_score DESC, image_id LIMIT 50))
SELECT conflicts, ambiguous, low_confidence, (SELECT severity FROM rep ORDER BY batch_id DESC LIMIT 1) AS severity, CASE WHEN over > 0.10 THEN 'increase temperature' WHEN over < -0.10 THEN 'decrease temperature' ELSE 'no recalibration needed' END AS recommendation, est_auc_gain FROM tot, cal, q""")
def qa_pipeline_findings(spark, d):
    """The QA pipeline's key findings, from the tables that its stages wrote."""
    out = _pipeline(spark, d)
    totals = out["verification"].agg(*(F.sum(c).alias(c) for c in ("annotation_conflict", "ambiguous", "low_confidence")))
    return questions.key_findings(totals, io.latest(out["drift"], "batch_id"), out["calibration"], active.summary(out["active_learning"]))


@query(rec(f"""SELECT agent, CAST(1 AS BIGINT) AS runs, 'success' AS last_status, CAST(n AS BIGINT) AS n_rows FROM (SELECT 'verification' AS agent, count(DISTINCT batch_id) AS n FROM records UNION ALL SELECT 'drift', count(DISTINCT batch_id) FROM records
UNION ALL SELECT 'active_learning', least(50, count(*)) FROM records UNION ALL SELECT 'calibration', 1 UNION ALL SELECT 'fairness', count(DISTINCT sex) + count(DISTINCT site) + count(DISTINCT {_BAND}) FROM people)"""))
def qa_pipeline_status(spark, d):
    """The status of the QA pipeline's agents by its own run log, and the rows that each has written."""
    log = io.shared_dir(spark)
    out = _pipeline(spark, d, log)
    rows = reduce(DataFrame.unionByName, (t.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("agent", F.lit(k)) for k, t in out.items()))
    return pipeline.status(io.run_log(spark, log)).join(rows, "agent").select("agent", "runs", "last_status", "n_rows")


@query(f"""WITH {V.RECORDS}, {_DRIFT}, src AS (SELECT 'class|' || c AS grp, s, human_label = c AS y FROM (SELECT human_label, unnest({V._NAMES}) AS c, unnest([round(p, 4) FOR p IN probs]) AS s FROM records) UNION ALL SELECT 'sex|' || sex, mel_prob, human_label = 'mel' FROM records),
{auc_sql('grp', 's', 'y', 'src')}
SELECT 'per_class' AS section, c.pred_class AS item, auc AS value, full_name AS note FROM {_CODES} LEFT JOIN auc ON g = 'class|' || c.pred_class
UNION ALL SELECT 'by_sex', split_part(g, '|', 2), auc, concat('n = ', n) FROM auc WHERE g LIKE 'sex|%'
UNION ALL SELECT * FROM (SELECT 'drift', severity, kl_divergence, flags FROM rep ORDER BY batch_id DESC LIMIT 1)""")
def research_report(spark, d):
    """The research report as one table: AUCs by class and by sex, and the newest drift report."""
    rows = V.records(spark, d)
    last = io.latest(drift.report(rows, ["batch_id"]), "batch_id")
    return questions.report_rows(class_metrics(rows), fairness.by_axis(rows, "sex"), last)


# image files


def _bytes(n, count: int):
    """A number's bytes, the lowest first, in hexadecimal digits."""
    return F.concat(*(F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(count)))


#: Files of a folder, more or less, tasks that write them, and folders that are written before they are read: their files are a few GB.
FILES_A_FOLDER, WRITERS, FOLDERS_A_TURN = 1000, 512, 512


def bitmap(height, width: int, pixel):
    """A bitmap file of one colour: height, width (a multiple of four) and the pixel as six hexadecimal digits, blue first."""
    size, number = height * F.lit(3 * width), lambda x: _bytes(F.lit(x), 4)
    head = F.concat(F.lit("424D"), _bytes(size + 54, 4), number(0), number(54), number(40), number(width), _bytes(height, 4), F.lit("01001800"), number(0), _bytes(size, 4), *(number(0) for _ in range(4)))
    return F.unhex(F.concat(head, F.repeat(pixel, height * width)))


@query("""WITH img AS (SELECT concat('/in/', CASE WHEN p_partkey % 2 = 0 THEN 'img_' WHEN p_partkey % 3 = 0 THEN 'Only ' ELSE 'Img ' END, p_partkey // 2, '.png') AS path, concat(p_partkey % 256, '|', p_size) AS content,
CASE WHEN p_partkey % 17 = 0 THEN -1 ELSE 20 + p_size END AS height, greatest(p_partkey % 256, p_partkey * 7 % 256, p_partkey * 13 % 256) AS hi, least(p_partkey % 256, p_partkey * 7 % 256, p_partkey * 13 % 256) AS lo FROM part),
f AS (SELECT content, min(path) AS first FROM img WHERE height >= 0 GROUP BY content),
r AS (SELECT img.*, CASE WHEN height >= 0 AND first <> path THEN first END AS dup, CASE WHEN lower(replace(path, ' ', '_')) <> path AND lower(replace(path, ' ', '_')) NOT IN (SELECT path FROM img) THEN lower(replace(path, ' ', '_')) END AS rename_to,
CASE WHEN hi > 0 THEN (hi - lo) / CAST(hi AS DOUBLE) * 255 ELSE 0 END AS sat FROM img LEFT JOIN f USING (content)),
i AS (SELECT *, CASE WHEN height < 0 THEN 'corrupt' ELSE concat_ws(';', CASE WHEN least(height, 40) < 32 THEN 'too_small' END, CASE WHEN dup IS NOT NULL THEN concat('duplicate_of:', dup) END, CASE WHEN sat < 10 THEN 'ood:near_grayscale' END,
CASE WHEN hi < 20 THEN 'ood:near_black' END, CASE WHEN hi > 250 THEN 'ood:near_white' END, CASE WHEN rename_to IS NOT NULL THEN 'renamed' END) END AS issues FROM r)
SELECT path, CAST(height AS INTEGER) AS height, CASE WHEN height < 0 THEN -1 ELSE 40 END AS width, issues, CASE WHEN issues = '' THEN 'clean' WHEN height < 0 THEN 'remove' WHEN dup IS NOT NULL THEN 'remove_duplicate' ELSE 'flag' END AS action, rename_to FROM i""")
def ingest_files(spark, d):
    """Parts as image files, written, found by their suffix, read, decoded and checked; some are no images, some are copies, and some have
    names to clean. The files are spread over folders of about a thousand, by clean name, and count as those of one folder. Some folders are
    written and read at a time, so that reading finds their files in memory: from the disk it takes more than twice as long."""
    path, dealt, facts, p, parts = io.shared_dir(spark), io.shared_dir(spark), io.shared_dir(spark), F.col("p_partkey"), V.table(spark, d, "part")
    n = parts.count() // FILES_A_FOLDER + 1
    name = F.concat(F.when(p % 2 == 0, "img_").when(p % 3 == 0, "Only ").otherwise("Img "), F.floor(p / 2).cast("string"), F.lit(".png"))
    pixel = F.concat(*(F.lpad(F.hex(p * k % 256), 2, "0") for k in (1, 7, 13)))
    image = F.when(p % 17 == 0, F.concat(F.lit("no image "), p.cast("string")).cast("binary")).otherwise(bitmap(F.col("p_size").cast("int") + 20, 40, pixel))
    rows = parts.select(p, "p_size", F.pmod(F.xxhash64(C.clean_name(name)), F.lit(n)).alias("folder")).withColumn("turn", F.floor(F.col("folder") / FOLDERS_A_TURN).cast("int"))
    rows.write.partitionBy("turn").parquet(dealt)
    for turn in range((n - 1) // FOLDERS_A_TURN + 1):
        some = spark.read.schema(rows.schema).parquet(dealt).where(F.col("turn") == turn)
        io.write_files(some.repartition(min(n, WRITERS), "folder").select(F.concat(F.col("folder").cast("string"), F.lit("/"), name).alias("name"), image.alias("content")), path)
        folders = sorted(r[0] for r in some.select("folder").distinct().collect())
        ingest_qc.facts_of_folders(spark, [f"{path}/{i}" for i in folders]).write.mode("append").parquet(facts)
    facts = spark.read.schema(ingest_qc.FACTS).parquet(facts)
    out = ingest_qc.checked(facts.withColumn("path", F.regexp_replace("path", "^.*/", "/in/")))
    return out.withColumn("issues", F.concat_ws(";", "issues"))
