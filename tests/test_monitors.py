"""Weekly jobs, joins along time, sessions, state across micro-batches, sketches and statistics, against brute force."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from predlens.config import CLASSES
from predlens.functions import stats
from predlens.operators import calibrate, curate, drift, papers, sketches, temporal
from predlens.plans.monitor_queries import in_turns
from predlens.sources import io, papers_xml
from predlens.streaming import jobs, stateful, streams

T0 = datetime(2024, 1, 4)  # a week begins here
at = lambda **k: T0 + timedelta(**k)


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# weekly jobs


def labelled(spark, rows):
    """Records of (time, confidence 0 to 1, is right)."""
    return spark.createDataFrame([(t, c * 10, "nv", "nv" if right else "mel") for t, c, right in rows], "ts timestamp, confidence_score double, pred_class string, human_label string")


def test_weekly_calibration_drops_and_counts_late_rows(spark):
    random.seed(1)
    weeks = [[(at(days=7 * w + i % 7), random.random(), random.random() < 0.6) for i in range(30)] for w in range(4)]
    late, early_enough = [(at(days=2), 0.9, False)] * 5, [(at(days=21, hours=1), 0.9, False)] * 3
    turns = [weeks[0] + weeks[1], weeks[2] + weeks[3], late + early_enough, [(at(days=40), 0.5, True)]]
    dropped = []
    out = in_turns([labelled(spark, t) for t in turns], lambda s: jobs.weekly_calibration(s, late="2 days"), lambda q: dropped.append(jobs.late_rows(q)))
    whole = labelled(spark, sum(weeks, []) + early_enough).withColumn("week", F.window("ts", "7 days")["start"])
    want = calibrate.report(whole, ["week"])
    assert rows_of(out, "week") == rows_of(want.select(out.columns), "week") and sum(dropped) >= 1 and dropped[0] == dropped[1] == 0


def test_report_once_equals_report(spark):
    rng = random.Random(3)
    df = labelled(spark, [(at(days=i % 3), rng.choice([0.0, 0.3, 0.6, 0.95, 1.0]), rng.random() < 0.5) for i in range(200)] + [(at(days=9), 0.5, True)] * 4)
    for one in (False, True):
        a, b = (f(df, ["ts"], include_one=one) for f in (calibrate.report, calibrate.report_once))
        assert rows_of(a, "ts") == rows_of(b.select(a.columns), "ts")


def test_weekly_papers_keep_the_first_of_a_title_whichever_comes_first(spark):
    a = [(at(days=1), "Skin One", "x", 1), (at(days=9), "skin one", "x", 2), (at(days=2), None, "x", 3), (at(days=30), "end", "", 9)]
    b = [(at(days=1), "SKIN ONE", "x", 4), (at(days=3), "Two", "melanoma", 6), (at(days=3), "two", "", 5), (at(days=30), "end", "", 10)]
    frame = lambda rows: spark.createDataFrame([(*r, "a" if r in a else "b") for r in rows], "ts timestamp, title string, abstract_excerpt string, id int, feed string")
    feeds = lambda s: jobs.weekly_papers(s.where("feed = 'a'"), s.where("feed = 'b'"), order=("id",))
    out = in_turns([frame(b[:2]), frame(a[:2] + b[2:3]), frame([a[2], a[3], b[3]])], feeds)
    assert sorted((r.week, r.id) for r in out.collect()) == [(T0, 1), (T0, 5), (at(days=7), 2)]
    ranked = papers.rank_within(out, "week", "id", keywords=("one",), n=1)
    assert sorted((r.week, r["rank"], r.id) for r in ranked.collect()) == [(T0, 1, 1), (at(days=7), 1, 2)]


# joins along time


def report_rows(rng, n=60):
    return [(rng.choice(["hot", "hot", "hot", "b", None]), at(hours=rng.randrange(-300, 900)), i) for i in range(n)] + [("hot", None, 98), ("b", at(hours=5), 99)]


@pytest.mark.parametrize("span", [3600, 86400, 1e9])
@pytest.mark.parametrize("at_once", [True, False])
def test_asof_join(spark, span, at_once):
    rng = random.Random(7)
    reports = report_rows(rng)
    rows = [(i, rng.choice(["hot", "hot", "b", "none", None]), at(hours=rng.randrange(-400, 1000))) for i in range(200)] + [(500, "hot", None), (501, "b", at(hours=5))] * 2

    def last(key, t, within=None):
        if key is None or t is None:
            return None
        known = [(u, v) for k, u, v in reports if k == key and u is not None and (u <= t if at_once else u < t)]
        best = max(known, default=None)
        return None if best is None or within is not None and (t - best[0]).total_seconds() > within else best[1]

    left = spark.createDataFrame(rows, "id int, key string, t timestamp").repartition(3)
    right = spark.createDataFrame(reports, "key string, t timestamp, v int").repartition(2)
    for within in (None, 40 * 3600):
        got = temporal.asof_join(left, right, ["key"], "t", "t", ["v"], span, at_once, ("v",), within)
        assert got.columns == ["id", "key", "t", "v"]
        assert sorted(((r.id, r.v) for r in got.collect()), key=repr) == sorted(((i, last(k, t, within)) for i, k, t in rows), key=repr)
    assert temporal.asof_join(left.limit(0), right, ["key"], "t", "t", ["v"]).collect() == []
    assert temporal.asof_join(left, right.limit(0), ["key"], "t", "t", ["v"]).where("v IS NULL").count() == len(rows)


@pytest.mark.parametrize("span", [60, 7200, 1e7])
def test_interval_join(spark, span):
    rng = random.Random(8)
    spans = [(rng.choice(["hot", "hot", "b", None]), b := at(hours=rng.randrange(-200, 500)), b + timedelta(minutes=rng.choice([0, 1, 59, 60, 5000, 40000])), i) for i in range(40)]
    spans += [("b", at(hours=1), None, 100), ("hot", None, at(hours=1), 101), ("hot", at(hours=2), at(hours=1), 102), ("hot", at(days=-30000), at(days=30000), 103)]
    rows = [(i, rng.choice(["hot", "hot", "b", None, "none"]), at(minutes=rng.randrange(-12000, 40000))) for i in range(150)] + [(i + 200, s[0], e) for i, s in enumerate(spans) for e in s[1:3]]
    want = sorted((i, v) for i, k, t in rows for q, b, e, v in spans if k is not None and k == q and t is not None and b is not None and b <= t and (e is None or t < e))
    left, right = spark.createDataFrame(rows, "id int, key string, t timestamp"), spark.createDataFrame(spans, "key string, b timestamp, e timestamp, v int")
    got = temporal.interval_join(left, right, ["key"], "t", "b", "e", ["v"], span)
    assert got.columns == ["id", "key", "t", "v"] and sorted((r.id, r.v) for r in got.collect()) == want
    assert temporal.interval_join(left.limit(0), right, ["key"], "t", "b", "e", ["v"]).collect() == []


def test_a_long_interval_is_few_pieces(spark):
    """Ten years of hours are 87,660 spans; the join makes a few for each length."""
    left = spark.createDataFrame([("k", at(days=i)) for i in range(10)], "key string, t timestamp")
    right = spark.createDataFrame([("k", at(days=-1000), at(days=2652), 1)], "key string, b timestamp, e timestamp, v int")
    out = temporal.interval_join(left, right, ["key"], "t", "b", "e", ["v"], 3600)
    assert out.count() == 10
    pieces = temporal.pieces_of(right, ["key"], "b", "e", ["v"], 3600).count()
    assert pieces <= 2 * (temporal.SPANS - 1) * temporal.LEVELS


def test_periods(spark):
    rows = [("a", at(days=d), s) for d, s in enumerate("OHHOHOOH")] + [("b", at(days=1), "H"), ("b", None, "O"), ("c", at(days=1), "O"), ("d", at(days=1), "O"), ("d", at(days=1), "H")]
    got = temporal.periods(spark.createDataFrame(rows, "k string, t timestamp, s string"), ["k"], "t", F.col("s") == "H")
    assert rows_of(got, "k", "begin") == [("a", at(days=1), at(days=3)), ("a", at(days=4), at(days=5)), ("a", at(days=7), None), ("b", at(days=1), None), ("d", at(days=1), None)]


@pytest.mark.parametrize("span", [1800, 86400])
def test_sessions_in_batch_and_stream(spark, span):
    rng = random.Random(9)
    rows = sorted([(rng.choice(["hot", "hot", "b"]), at(minutes=rng.randrange(0, 4000))) for _ in range(300)] + [("gap", at(minutes=m)) for m in (0, 30, 61)], key=lambda r: r[1])
    df = spark.createDataFrame([*rows, (None, at(hours=1)), ("b", None)], "k string, t timestamp")

    def brute(points):
        out = []
        for t in sorted(points):
            if out and t - out[-1][1] <= timedelta(minutes=30):
                out[-1] = (out[-1][0], t, out[-1][2] + 1)
            else:
                out.append((t, t, 1))
        return out

    want = sorted(((k, *s) for k in ("hot", "b", "gap") for s in brute([t for q, t in rows if q == k])), key=repr)
    got = temporal.sessions(df, ["k"], "t", 1800, span)
    assert sorted((tuple(r) for r in got.where("k IS NOT NULL").collect()), key=repr) == want and got.where("k IS NULL AND n = 1").count() == 1
    late, dropped = [("hot", at(minutes=-5))] * 4, []
    turns = [rows[:150], rows[150:], late, [("end", at(days=9))]]
    out = in_turns([spark.createDataFrame(t, "k string, t timestamp") for t in turns], lambda s: temporal.stream_sessions(s, ["k"], "t", "30 minutes", "1 hour"), lambda q: dropped.append(jobs.late_rows(q)))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == want and sum(dropped) >= 1


# state across micro-batches


def test_severity_changes_survive_a_restart_and_are_forgotten(spark):
    def reports(*rows):
        return spark.createDataFrame([(k, at(days=d), s) for k, d, s in rows], "site string, ts timestamp, severity string")

    turns = [
        reports(("a", 0, "OK"), ("a", 1, "HIGH"), ("b", 1, "MEDIUM"), ("a", 2, "HIGH"), (None, 1, "HIGH")),
        reports(("a", 4, "HIGH"), ("b", 3, "HIGH"), ("a", 3, "OK"), ("a", 1, "MEDIUM")),  # sorted by time; the last one is old
        reports(("c", 60, "OK")),  # the others' time is over
        reports(("a", 61, "HIGH"), ("c", 61, "OK")),
    ]
    out = in_turns(turns, lambda s: stateful.severity_changes(s, "site", forget="30 days"))  # each turn is a run from the checkpoint
    want = [("a", 1, "OK", "HIGH"), ("a", 3, "HIGH", "OK"), ("a", 4, "OK", "HIGH"), ("a", 61, "OK", "HIGH"), ("b", 1, "OK", "MEDIUM"), ("b", 3, "MEDIUM", "HIGH")]
    got = sorted((r.site, (r.ts - T0).days, r.previous, r.severity) for r in out.collect())
    # the second turn's old report of a is left out: 1 is before 2
    assert got == want


def test_unseen_content_with_a_time_to_live(spark):
    def files(*rows):
        return spark.createDataFrame([(m, p, at(days=d)) for m, p, d in rows], "md5 string, path string, ts timestamp")

    turns = [files(("x", "1", 0), ("x", "2", 0), ("y", "3", 1), (None, "0", 0)), files(("x", "4", 6), ("x", "5", 12)), files(("z", "6", 40)), files(("x", "7", 41), ("y", "8", 41), ("z", "9", 41))]
    out = in_turns(turns, lambda s: stateful.unseen_content(s, live="7 days"))
    assert sorted(r.path for r in out.collect()) == ["1", "3", "6", "7", "8"]


def test_state_keeps_times_that_pandas_does_not(spark):
    """Pandas ends in 2262; microseconds count too."""
    frame = lambda *rows: spark.createDataFrame(rows, "md5 string, path string, ts timestamp, severity string")
    t, live = datetime(2700, 3, 1, 12), timedelta(days=7)
    turns = [frame(("x", "1", t, "OK"), ("y", "2", datetime(1980, 1, 1), "HIGH")), frame(("x", "3", t + live - timedelta(microseconds=1), "HIGH")), frame(("x", "4", t + 2 * live, "HIGH"), ("x", "5", t + 3 * live, "OK"))]
    unseen = in_turns(turns, lambda s: stateful.unseen_content(s, live="7 days"))
    assert sorted((r.path, r.ts) for r in unseen.collect()) == [("1", t), ("2", datetime(1980, 1, 1)), ("4", t + 2 * live), ("5", t + 3 * live)]
    changes = in_turns(turns, lambda s: stateful.severity_changes(s, "md5"))
    assert sorted((r.md5, r.ts, r.severity) for r in changes.collect()) == [("x", t + live - timedelta(microseconds=1), "HIGH"), ("x", t + 3 * live, "OK"), ("y", datetime(1980, 1, 1), "HIGH")]


def test_turns_are_written_exactly_once(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), rng.choice(CLASSES), rng.random() * 10 if i % 9 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "batch_id int, pred_class string, confidence_score double")
    source, table, mark = (io.shared_dir(spark) for _ in range(3))
    for k in range(4):
        df.where(F.pmod(F.xxhash64("confidence_score", "pred_class"), F.lit(4)) == k).coalesce(1).write.mode("append").parquet(source)

    def run(then=None):
        q = jobs.drift_by_turns(streams.drops(spark, source, df.schema, "parquet", per_trigger=1), table, ["batch_id"], checkpoint=mark, then=then)
        try:
            q.awaitTermination()
        except Exception:
            pass
        return q

    def fails(n):
        if n == 2:
            raise RuntimeError("after its rows were written, before the turn is over")

    assert run(fails).exception() is not None
    before = spark.read.parquet(table).where("turn = 2").count()
    assert before > 0 and run().exception() is None  # turn 2 is written again
    assert rows_of(jobs.drift_table(spark, table, ["batch_id"]), "batch_id") == rows_of(drift.report(df, ["batch_id"]), "batch_id")
    assert spark.read.parquet(table).select("turn").distinct().count() == 4


# statistics and groupings


def test_p_value(spark):
    def brute(t, v):
        f = lambda a: math.cos(a) ** (v - 1)
        top, n = math.atan(abs(t) / math.sqrt(v)), 20000
        area = sum((1 if i in (0, n) else 4 if i % 2 else 2) * f(top * i / n) for i in range(n + 1)) * top / n / 3
        return 1 - area * 2 * math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(math.pi)

    cases = [(t, v) for v in (1.0, 2.0, 3.0, 8.0, 17.0, 250.0, 5000.0) for t in (0.0, 0.3, -1.96, 4.0, 45.0)] + [(2.228138852, 10.0), (12.7062047, 1.0)]
    rows = spark.createDataFrame([*cases, (float("inf"), 5.0), (float("nan"), 5.0), (None, 5.0), (1.0, 0.0)], "t double, v double")
    got = [r.p for r in rows.select(stats.p_value(F.col("t"), F.col("v")).alias("p")).collect()]
    for (t, v), p in zip(cases, got, strict=False):
        assert p == pytest.approx(max(0.0, brute(t, v)), abs=2e-9)
    assert got[len(cases) - 2 : len(cases)] == pytest.approx([0.05, 0.05], abs=1e-7) and got[len(cases) :] == [0.0, None, None, None]
    assert [r.p for r in spark.createDataFrame([(1.959963985, 4e9)], "t double, v double").select(stats.p_value(F.col("t"), F.col("v")).alias("p")).collect()] == pytest.approx([0.05], abs=1e-7)
    plan = rows.select(stats.p_value(F.col("t"), F.col("v")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_auc_in_ranges_gives_the_same_rows(spark):
    rng = random.Random(6)
    rows = [(g, None if rng.random() < 0.05 else round(rng.gauss(0, 1), 2) if g != "skew" else rng.random() ** 30, int(rng.random() < 0.3)) for g in ["a", "a", "skew", None, "few"] for _ in range(300)]
    df = spark.createDataFrame([r for i, r in enumerate(rows) if r[0] != "few" or i % 100 == 0], "g string, s double, y int")
    for by in (["g"], []):
        a, b = (stats.auc(df, by, "s", F.col("y") == 1, ranges=r) for r in (0, 16))
        assert rows_of(a, *a.columns) == rows_of(b, *b.columns)


def test_a_group_of_very_many_scores_is_no_partition(spark):
    """A million distinct scores of one group, most of them close together: no range holds more than twice its share."""
    n, ranges = 1_000_000, 32
    rows = spark.range(n).select((F.pow(F.col("id") / n, F.lit(20.0))).alias("s"), (F.col("id") % 3 == 0).alias("y"))
    bins = rows.groupBy("s").agg(F.count_if("y").alias("p"), F.count(F.lit(1)).alias("n"))
    sizes = [r["count"] for r in stats.in_ranges(bins, [], "s", ranges).groupBy("_range").count().collect()]
    assert sum(sizes) == bins.count() > 900_000 and max(sizes) <= 2 * sum(sizes) / ranges
    a, b = (stats.auc(rows, [], "s", F.col("y"), ranges=r).first() for r in (0, ranges))
    assert a == b and a.n == n


def test_distributions(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", None, 2.0), (None, "x", 3.0)], "p string, q string, v double")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in curate.distributions(df, ["p", "q"], total=F.sum("v")).collect()}
    want = {(None, None, 3): (3, 6.0), ("a", None, 1): (2, 3.0), (None, None, 1): (1, 3.0), (None, "x", 2): (2, 4.0), (None, None, 2): (1, 2.0), ("a", "x", 0): (1, 1.0), ("a", None, 0): (1, 2.0), (None, "x", 0): (1, 3.0)}
    assert got == want
    assert sorted(map(tuple, curate.distributions(df, ["p", "q"], [["p"]]).collect()), key=repr) == [("a", None, 1, 2), (None, None, 1, 1)]
    assert sorted(map(tuple, curate.distribution(df, "p", "q").collect()), key=repr) == sorted([("a", "x", 1), ("a", None, 1), (None, "x", 1), ("a", None, 2), (None, None, 1)], key=repr)


def test_sketches_merge_within_their_bounds(spark):
    rng = random.Random(2)
    rows = [(at(days=i % 10, hours=i % 24), rng.expovariate(1), rng.randrange(8000)) for i in range(30000)] + [(at(days=1), None, None), (None, 1.0, 1), (at(days=20), None, 7)]
    df = spark.createDataFrame(rows, "t timestamp, v double, who int")
    days = sketches.daily(df, "t", "v", "who")
    assert days.count() == 11
    ranks = {"low": 0.1, "median": 0.5, "tail": 0.99}
    for low, high in ((0, 10), (2, 5), (7, 8)):
        some = [r for r in rows if r[0] and at(days=low) <= r[0] < at(days=high)]
        part = days.where(F.col("day").between(at(days=low).date(), at(days=high - 1).date()))
        got = sketches.read(sketches.merged(part, []), ranks).first()
        values = sorted(v for _, v, _ in some if v is not None)
        for name, q in ranks.items():
            rank = sum(v <= got[name] for v in values) / len(values)
            assert abs(rank - q) < 2.3 / sketches.K**0.9 + 1 / len(values)
        true = len({w for *_, w in some if w is not None})
        assert got.n == len(some) and abs(got.distinct - true) <= 3 * 1.04 / 2 ** (sketches.LG_K / 2) * true
    alone = sketches.read(days.where(F.col("n") == 1), ranks).first()
    assert alone.median is None and alone.distinct == 1


# sources


def test_paper_xml_rejects_have_a_reason(spark):
    path = io.shared_dir(spark)
    body = lambda i, t: f"<PubmedArticle><MedlineCitation><PMID>{i}</PMID><Article><ArticleTitle>{t}</ArticleTitle><Journal><Title>J</Title><JournalIssue><PubDate><Year>2020</Year></PubDate></JournalIssue></Journal><Abstract><AbstractText>{'w' * 400}</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"
    text = "<?xml version='1.0'?>\n<PubmedArticleSet>" + body(1, "One <i>of</i> two &amp; more") + body(2, "") + body(3, "bad &nothing; here") + body(4, "cut").replace("</PubmedArticle>", "") + body(5, "Fünf") + "</PubmedArticleSet>\n"
    spark.createDataFrame([(text + "<PubmedArticle><MedlineCitation>",)], "value string").write.text(path)
    good, bad = papers_xml.read(spark, path, "q")
    assert [(r.pmid, r.title, r.journal, r.year, len(r.abstract_excerpt), r.url, r.query) for r in good.orderBy("pmid").collect()] == [
        (i, t, "J", "2020", 300, f"https://pubmed.ncbi.nlm.nih.gov/{i}/", "q") for i, t in (("1", "One of two & more"), ("5", "Fünf"))
    ]
    assert sorted(r.error.split(":")[0] for r in bad.collect()) == ["no XML", "no XML", "no title", "the record has no end"]
    feed = io.shared_dir(spark)
    spark.createDataFrame([("<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>A\n  b</title><summary> s  t </summary><id>u</id></entry></feed>",)], "value string").write.text(feed)
    good, bad = papers_xml.read(spark, feed, "q", papers_xml.ENTRY)
    assert [(r.source, r.title, r.abstract_excerpt, r.url) for r in good.collect()] == [("arxiv", "A b", "s t", "u")] and bad.count() == 0
