import math
import struct
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from predlens import schemas
from predlens.config import CLASSES, DIAGNOSES, HYPOTHESES, ONEHOT_8
from predlens.functions import columns as C
from predlens.functions import stats
from predlens.operators import active, calibrate, curate, drift, fairness, hypothesis, ingest_qc, papers, qa, questions, score
from predlens.plans import monitor_queries, pipeline, queries, records
from predlens.sources import io

from .conftest import DATA


def one(df):
    return df.first()[0]


def probs_frame(spark, rows):
    return spark.createDataFrame(rows, "image_id string, probs array<double>, human_label string").withColumns({"pred_class": C.first_max("probs", CLASSES), "confidence_score": C.confidence_score("probs"), "mel_prob": F.round(F.get("probs", F.lit(0)), 4)})


def spread(top, second, first="mel", then="nv"):
    rest = (1 - top - second) / 5
    return [top if c == first else second if c == then else rest for c in CLASSES]


def test_qa_flag_boundaries(spark):
    rows = [
        ("at 7.0", spread(0.7, 0.2), "nv"), ("own label", spread(0.7, 0.2), "mel"), ("empty", spread(0.7, 0.2), ""), ("none", spread(0.7, 0.2), None),
        ("gap below", spread(0.5, 0.305), None), ("floor", spread(0.65, 0.1), None), ("below floor", spread(0.649, 0.1), None), ("error", None, None),
    ]
    found = {r.image_id: r.flag for r in qa.annotate(probs_frame(spark, rows)).collect()}
    assert found == {"at 7.0": "ANNOTATION_CONFLICT", "own label": "OK", "empty": "OK", "none": "OK", "gap below": "AMBIGUOUS", "floor": "OK", "below floor": "LOW_CONFIDENCE", "error": "ERROR"}


@pytest.mark.parametrize(("probs", "expected"), [
    (spread(0.7, 0.312, "nv", "mel"), ("CANCER_FLAGGED", 2)), (spread(0.7, 0.3119, "nv", "mel"), ("NORMAL", 4)), (spread(0.9, 0.05, "vasc"), ("REVIEW_REQUIRED", 3)),
    (spread(0.64, 0.1, "nv", "df"), ("REVIEW_REQUIRED", 3)), (spread(0.65, 0.1, "nv", "df"), ("NORMAL", 4)), (spread(0.5, 0.1), ("CANCER_FLAGGED", 1)), (spread(0.9, 0.05, "bcc"), ("CANCER_FLAGGED", 2)),
])
def test_verdict(spark, probs, expected):
    row = score.triage(probs_frame(spark, [("a", probs, None)])).first()
    assert (row.verdict, row.priority) == expected


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=7, max_size=7))
def test_softmax_sums_to_one(spark, logits):
    row = score.predict(spark.createDataFrame([(logits,)], "logits array<double>"), temperature=0.4095).select("probs", C.softmax("logits", 0.4095).alias("p")).first()
    assert math.isclose(sum(row.probs), 1, rel_tol=1e-9)
    assert row.p == pytest.approx(row.probs)


def test_ece_edges(spark):
    rows = [("a", 10 * c, "x", "x") for c in (0.3, 0.6, 0.7, 1.0)]
    df = spark.createDataFrame(rows, "image_id string, confidence_score double, pred_class string, human_label string")
    bins = {r.image_id: r.bin for r in calibrate.evaluable(df).withColumn("bin", calibrate.bin_of(F.col("conf"))).withColumn("image_id", F.col("conf")).collect()}
    assert bins == {0.3: 2, 0.6: 5, 0.7: 6, 1.0: None}
    assert calibrate.report(df).first().status == "insufficient_data"


def test_auc_against_brute_force(spark):
    rows = [("g", s, y) for s, y in [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1), (0.2, 0)]] + [("t", 0.5, i % 2) for i in range(6)] + [("few", 0.1 * i, int(i < 2)) for i in range(6)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    out = {r.g: r.auc for r in stats.auc(df, ["g"], "s", F.col("y") == 1).collect()}
    pos, neg = [0.35, 0.8, 0.4], [0.1, 0.4, 0.2]
    assert out["g"] == round(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / 9, 4)
    assert out["t"] == 0.5
    assert out["few"] is None


def test_t_test_and_p_value(spark):
    known = spark.createDataFrame([(2.228138852, 10), (0.0, 5)], "t double, v int")
    assert [r[0] for r in known.select(stats.p_value(F.col("t"), F.col("v"))).collect()] == pytest.approx([0.05, 1.0], abs=1e-8)
    rows = [("f", 5.0 + i % 3, 0.1, "mel") for i in range(6)] + [("m", 7.0 + i % 2, 0.2, "nv") for i in range(7)] + [(None, None, 0.2, "nv")]
    df = spark.createDataFrame(rows, "sex string, confidence_score double, mel_prob double, human_label string")
    r = hypothesis.test(df, [("sex", "f"), ("site", "x")]).collect()
    assert len(r) == 1 and r[0].n_rest == 8 and r[0].direction == "lower" and r[0].significant
    assert hypothesis.test(df.limit(4), [("sex", "f")]).first().error == "not enough samples"


def test_hypothesis_patterns(spark):
    asked = spark.createDataFrame([("Is it worse for women?",), ("worse on the face",), ("worse for men",), ("nothing",)], "question string")
    found = [(r.axis, r.value) for r in hypothesis.parse(asked, patterns=HYPOTHESES).collect()]
    assert found == [("sex", "female"), ("site", "head/neck"), ("sex", "male"), (None, None)]


def test_age_bands(spark):
    ages = [0.0, 30.0, 30.5, 45.0, 75.0, 120.0, 121.0, None]
    out = [r[0] for r in spark.createDataFrame([(a,) for a in ages], "a double").select(C.age_band("a")).collect()]
    assert out == [None, "<30", "30-45", "30-45", "60-75", "75+", None, None]


def test_curation(spark, tmp_path):
    hot = spark.createDataFrame([("a", *[0.0] * 8, 1.0), ("b", 0.0, 1.0, *[0.0] * 6, 0.0), ("c", *[0.0] * 7, 1.0, 0.0)], schemas.ONEHOT_8)
    meta = spark.createDataFrame([("b", None, 40.0, "male", "back"), ("c", "L1", None, None, None)], schemas.IMAGE_METADATA)
    names = [c.upper() for c in CLASSES]
    one_ = curate.normalise_onehot(hot, ONEHOT_8, "D2", "s", names, meta)
    assert {(r.image_id, r.label, r.label_idx, r.patient_id, r.site) for r in one_.collect()} == {("b", "NV", 1, "b", "back"), ("c", "AKIEC", 3, "L1", None)}
    binary = spark.createDataFrame([("b", "p1", "Nevus", 0, 1.0, "f", None), ("d", None, "unknown", 1, 1.0, "f", None), ("e", None, None, 0, 2.0, None, "x"), ("f", "p2", "odd thing", 1, None, None, None)], schemas.BINARY)
    two = curate.normalise_binary(binary, DIAGNOSES, "D3", "s", names)
    assert {(r.image_id, r.label, r.patient_id) for r in two.collect()} == {("b", "NV", "p1"), ("e", "NV", "e"), ("f", "MEL", "p2")}
    merged = curate.first_wins(curate.merge([one_, two]), "image_id", "priority", "image_path")
    assert {(r.image_id, r.dataset) for r in merged.collect()} == {("b", "D2"), ("c", "D2"), ("e", "D3"), ("f", "D3")}
    files = spark.createDataFrame([("/x/b.jpg",), ("/x/f.PNG",)], "path string")
    assert curate.with_file(merged, files).count() == 2
    io.write_split(merged.withColumn("split", F.lit("train")), str(tmp_path / "out"), "csv")
    assert io.labels_csv(spark, str(tmp_path / "out"), schemas.IMAGE_RECORD).count() == 4


@pytest.mark.parametrize("exact", [False, True])
def test_group_split(spark, exact):
    df = spark.range(3000).select((F.col("id") % 103).alias("p"), "id")
    out = curate.group_split(df, "p", 0.2, exact=exact).persist()
    assert curate.leaks(out, "p").first()[0] == 0 and out.count() == 3000
    val = out.where("split = 'val'").select("p").distinct().count()
    assert val == math.ceil(0.2 * 103) if exact else 5 < val < 40


def test_drift_of_the_training_shares_is_nothing(spark):
    rows = [(1, c, 8.2) for c, n in zip(CLASSES, (909, 7587, 561, 266, 571, 52, 58), strict=True) for _ in range(n)]
    r = drift.report(spark.createDataFrame(rows, "batch_id int, pred_class string, confidence_score double"), ["batch_id"]).first()
    assert r.kl_divergence == pytest.approx(0, abs=2e-3) and r.severity == "OK" and r.flags == []
    odd = spark.createDataFrame([(1, "vasc", 3.0)] * 5 + [(1, "odd", None)], "batch_id int, pred_class string, confidence_score double")
    r = drift.report(odd, ["batch_id"]).first()
    assert r.severity == "HIGH" and r.n_images == 6 and "CONFIDENCE_SHIFT" in r.flags


def test_fairness_status(spark):
    df = spark.createDataFrame([("a", "mel", 0.1)], "sex string, human_label string, mel_prob double").withColumn("site", F.lit(None).cast("string"))
    assert {r.axis: r.status for r in fairness.axis_status(df).collect()} == {"sex": "ok", "site": "no_data", "age": "metadata_unavailable"}


def test_queue_is_a_prefix(spark):
    df = probs_frame(spark, [(str(i), spread(0.4 + i / 50, 0.2), None) for i in range(20)]).withColumn("flag", F.lit("OK"))
    rows = active.uncertainty(df)
    long = [r.image_id for r in active.queue(rows, 10).collect()]
    assert [r.image_id for r in active.queue(rows, 4).collect()] == long[:4]
    assert "TakeOrderedAndProject" in active.queue(rows, 4)._jdf.queryExecution().executedPlan().toString()


def png(path, w, h, rgb):
    raw = b"".join(b"\0" + bytes(rgb) * w for _ in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_ingest_scan(spark, tmp_path):
    png(tmp_path / "a.png", 40, 40, (200, 50, 50))
    png(tmp_path / "b.png", 40, 40, (200, 50, 50))
    png(tmp_path / "C d.png", 40, 40, (100, 200, 50))
    png(tmp_path / "small.png", 10, 40, (200, 50, 50))
    png(tmp_path / "grey.png", 40, 40, (90, 90, 90))
    (tmp_path / "junk.jpg").write_bytes(b"no image")
    out = ingest_qc.scan(io.image_files(spark, str(tmp_path)), io.decoded_images(spark, str(tmp_path)))
    found = {r.path.split("/")[-1].replace("%20", " "): (r.action, [i.split(":")[0] for i in r.issues]) for r in out.collect()}
    assert found["a.png"] == ("clean", [])
    assert found["b.png"] == ("remove_duplicate", ["duplicate_of"])
    assert found["small.png"] == ("flag", ["too_small"])
    assert found["grey.png"] == ("flag", ["ood"])
    assert found["junk.jpg"] == ("remove", ["corrupt"])
    r = ingest_qc.report(out).first()
    assert (r.total, r.corrupt, r.duplicates, r.ready_count) == (6, 1, 1, 4)


def test_papers_from_xml(spark, tmp_path):
    (tmp_path / "p.xml").write_text(
        "<S><PubmedArticle><MedlineCitation><PMID>1</PMID><Article><ArticleTitle>Melanoma AUC</ArticleTitle><Abstract><AbstractText>dermoscopy</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"
        "<PubmedArticle><MedlineCitation><PMID>2</PMID><Article><ArticleTitle>Other</ArticleTitle></Article></MedlineCitation></PubmedArticle></S>"
    )
    (tmp_path / "e.atom").write_text("<feed><entry><title>MELANOMA auc</title><summary>x</summary><id>u</id></entry></feed>")
    feed = papers.union(io.paper_articles(spark, str(tmp_path / "p.xml")), io.paper_entries(spark, str(tmp_path / "e.atom")))
    top = papers.rank(feed, "feed_no", "title").collect()
    assert [(r.title, r.relevance) for r in top] == [("Melanoma AUC", 0.2), ("Other", 0.0)]


def test_questions(spark):
    asked = spark.createDataFrame([("How many images are in the queue?",), ("Explain why",), ("zzz",)], "question string")
    out = questions.classify(questions.match(asked)).collect()
    assert [(r.question_id, r.intent) for r in out] == [("Q08", "data"), (None, "knowledge"), (None, "data")]
    with pytest.raises(KeyError):
        questions.answer("Q11", {})


def test_pipeline_reads_narrow_written_records(spark):
    """Stages read files in splits, not cached partitions as wide and long as the source's; demographics join rows without predictions."""
    df = probs_frame(spark, [(str(i), spread(0.5 + i / 100, 0.1), "mel") for i in range(12)]).withColumns({"batch_id": F.lit(1), "sex": F.lit("f"), "age": F.lit(50.0), "site": F.lit("x")})
    out = pipeline.run(qa.annotate(df), plan={"calibration": pipeline.stages()["calibration"]})
    plan = out["records"]._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and "parquet" in plan and out["records"].count() == 12
    joined = records.records(spark, "/root/testdata/sf0.001", age=True, site=True)._jdf.queryExecution().optimizedPlan().toString()
    assert joined.index("confidence_score") < joined.index("Join") and "confidence_score" not in joined[joined.index("Join") :]


def test_pipeline_logs_and_stops(spark, tmp_path):
    df = probs_frame(spark, [(str(i), spread(0.5 + i / 100, 0.1), "mel") for i in range(12)]).withColumns({"batch_id": F.lit(1), "sex": F.lit("f"), "age": F.lit(50.0), "site": F.lit("x"), "path": F.concat(F.lit("/"), "image_id")})
    log = str(tmp_path / "log")
    plan = pipeline.stages() | {"broken": lambda t: t["records"].select("no_such")}
    out = pipeline.run(qa.annotate(df), log, plan=plan)
    assert out["broken"] is None and out["calibration"].first().n_eval == 12
    status = {r.agent: (r.last_status, r.errors) for r in pipeline.status(io.run_log(spark, log)).collect()}
    assert status["broken"] == ("error", 1) and status["drift"] == ("success", 0)
    gone = df.select("path", F.lit("remove").alias("action"), F.array(F.lit("corrupt")).alias("issues"))
    assert list(pipeline.run(df, files=gone)) == ["ingest"]
    out["records"].unpersist()


def test_batch_scoring_goes_on_after_a_bad_row(spark):
    def make():
        return lambda x: x * 2

    df = spark.createDataFrame([(1, [1.0] * 7), (2, None), (3, [float("nan")] * 7)], "id int, x array<double>")
    out = {r.id: (r.logits, r.error) for r in score.score_batch(df, make, ["x"], shapes=[[7]]).collect()}
    assert out == {1: ([2.0] * 7, None), 2: (None, "no prediction"), 3: (None, "no prediction")}


def test_a_stage_that_fails_while_running_is_logged(spark, tmp_path):
    """The plan is fine; the error comes from a row."""
    df = probs_frame(spark, [(str(i), spread(0.5 + i / 100, 0.1), "mel") for i in range(12)]).withColumns({"batch_id": F.lit(1), "sex": F.lit("f"), "age": F.lit(50.0), "site": F.lit("x")})
    log = str(tmp_path / "log")
    fails = {"fails": lambda t: t["records"].select(F.raise_error(F.concat(F.lit("no good: "), "image_id")).alias("x")), "after": lambda t: t["records"].groupBy("batch_id").count()}
    out = pipeline.run(qa.annotate(df), log, plan=fails)
    out["records"].unpersist()
    assert out["fails"] is None and out["after"].first()["count"] == 12
    line = io.run_log(spark, log).where("agent = 'fails'").first()
    assert line.status == "error" and "no good" in line.error and line.run_count == 1


def test_two_runs_at_once_get_two_numbers(spark, tmp_path):
    log = str(tmp_path / "log")
    assert [pipeline.next_run(spark, "a", log) for _ in range(3)] == [1, 2, 3] and pipeline.next_run(spark, "b", log) == 1


def test_files_are_written_with_their_names(spark):
    path = io.shared_dir(spark)
    rows = spark.createDataFrame([("a b.png", bytearray(b"\x00\x01")), ("é.jpg", bytearray(b"x"))], "name string, content binary")
    assert io.write_files(rows, path) == 2 and io.write_files(rows.limit(0), path) == 0
    found = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in io.image_files(spark, path).collect()}
    assert found == {"a b.png": b"\x00\x01", "é.jpg": b"x"}


def test_ingest_reads_each_source_once(spark):
    files = spark.createDataFrame([("/x/A b.png", bytearray(b"1")), ("/x/c.png", bytearray(b"1"))], "path string, content binary")
    images = spark.createDataFrame([("/x/A b.png", 40, 40, 3, bytearray(b"\x01\x02\x03" * 4)), ("/x/c.png", 40, 40, 3, bytearray(b"\x01\x02\x03" * 4))], "path string, height int, width int, channels int, data binary")
    out = ingest_qc.scan(files, images)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "content" not in plan and "pixel_means" not in plan  # only the table of facts is read from then on
    assert {r.path: (r.action, r.rename_to) for r in out.collect()} == {"/x/A b.png": ("flag", "/x/a_b.png"), "/x/c.png": ("remove_duplicate", None)}


def test_one_scan_of_records_for_all_tests(spark):
    df = probs_frame(spark, [(str(i), spread(0.5 + i / 100, 0.1), "mel") for i in range(12)]).withColumn("sex", F.when(F.col("image_id") < "5", "female"))
    plan = hypothesis.test(df, [("sex", "female"), ("human_label", "mel")])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Python" not in plan
    scored = score.score_batch(df.withColumn("x", F.col("probs")), lambda: (lambda x: x), ["x"], shapes=[[7]])
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_the_filter_on_bins_stays_above_what_computes_them(spark):
    plan = queries.reliability_bins(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate") :]
    assert "0.30000000000000004" in plan and "0.30000000000000004" not in below and plan.count("round((array_max") <= 3


def test_images_of_a_small_table_are_dealt_to_many_tasks(spark, monkeypatch):
    seen, scan = [], ingest_qc.scan
    monkeypatch.setattr(queries, "ROWS_A_TASK", 20)
    monkeypatch.setattr(ingest_qc, "scan", lambda files, images: seen.append(images) or scan(files, images))
    queries.ingest_scan(spark, "/root/testdata/sf0.001")
    assert seen[0].rdd.getNumPartitions() == seen[0].count() // 20 + 1 > 1


def bmp(width, height, seed=7, fields=()):
    """A bitmap of 24 bits a pixel; fields of its header by name."""
    row = (3 * width + 3) // 4 * 4
    f = {"size": 54 + row * height, "zero": 0, "begin": 54, "head": 40, "width": width, "height": height, "planes": 1, "bits": 24, "packed": 0, "count": row * height} | dict(fields)
    return b"BM" + struct.pack("<IIIIiiHHII16x", *f.values()) + bytes(i * seed % 251 for i in range(row * height))


def images_in(folder, files):
    for name, raw in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(raw)
    return str(folder)


def by_sources(spark, folders):
    return sorted(ingest_qc.facts(io.image_files(spark, folders), io.decoded_images(spark, folders)).collect())


PLAIN = {f"{w}x{h}.png": bmp(w, h) for w in (1, 2, 3, 4, 33) for h in (1, 2, 45)} | {
    "é a+%20.JPG": bmp(6, 6), "sub/b c.jpeg": bmp(5, 3), "none.png": b"no image", "short.png": b"B", "webp.png": b"RIFF1234WEBPVP8 ",
    "empty.png": b"", "note.txt": b"x", ".hidden.png": bmp(2, 2), "_hidden.png": bmp(2, 2), "_k=v.png": bmp(2, 2), "_sub/d.png": bmp(2, 2),
}


def test_folders_of_plain_bitmaps_are_read_by_tasks_as_the_sources_would(spark, tmp_path, monkeypatch):
    folders = [images_in(tmp_path / f"f {i}", PLAIN | {f"{i}.png": bmp(40, 20 + i, i + 1)}) for i in range(9)]
    want = by_sources(spark, folders)
    assert len(want) == 9 * 22 and sum(r.height == -1 for r in want) == 9 * 3

    def unused(*_):
        raise AssertionError("the driver lists no files and the image source decodes none")

    monkeypatch.setattr(ingest_qc, "image_files", unused)
    monkeypatch.setattr(ingest_qc, "decoded_images", unused)
    assert sorted(ingest_qc.facts_of_folders(spark, folders).collect()) == want
    assert ingest_qc.facts_of_folders(spark, []).count() == 0


def test_folders_with_other_formats_or_in_other_stores_go_through_the_sources(spark, tmp_path, monkeypatch):
    folders = [images_in(tmp_path / f"f{i}", PLAIN) for i in range(4)]
    png(tmp_path / "f1" / "real.png", 40, 30, (200, 50, 50))
    (tmp_path / "f3" / "32.png").write_bytes(bmp(5, 4, fields={"bits": 32}))
    want = by_sources(spark, folders)
    monkeypatch.setattr(ingest_qc, "FILES_A_BATCH", 3)
    assert sorted(ingest_qc.facts_of_folders(spark, folders, at_once=1).collect()) == want

    def unknown(folder):
        raise pa.ArrowInvalid("Unrecognized filesystem type in URI")

    monkeypatch.setattr(ingest_qc, "store_of", unknown)
    assert sorted(ingest_qc.facts_of_folders(spark, folders, at_once=3).collect()) == want


def test_image_files_are_written_and_read_some_folders_at_a_time(spark, monkeypatch):
    want = sorted(monitor_queries.ingest_files(spark, DATA).collect(), key=lambda r: r.path)
    seen, of = [], ingest_qc.facts_of_folders
    monkeypatch.setattr(monitor_queries, "FILES_A_FOLDER", 10)
    monkeypatch.setattr(monitor_queries, "FOLDERS_A_TURN", 6)
    monkeypatch.setattr(ingest_qc, "facts_of_folders", lambda spark, folders: seen.append(folders) or of(spark, folders))
    assert sorted(monitor_queries.ingest_files(spark, DATA).collect(), key=lambda r: r.path) == want
    assert len(seen) == 4 and max(map(len, seen)) <= 6 and len({f for s in seen for f in s}) == sum(map(len, seen)) > 6


@pytest.mark.parametrize("fields", [{"height": -4}, {"bits": 32}, {"packed": 1}, {"begin": 60}, {"head": 124}, {"count": 0}, {"size": 1}, {"width": 0}, {"planes": 2}])
def test_only_plain_bitmaps_are_decoded_by_tasks(fields):
    assert ingest_qc.plain_bitmap(bmp(5, 4)).shape == (4, 5, 3)
    assert ingest_qc.plain_bitmap(bmp(5, 4, fields=fields)) is None and ingest_qc.plain_bitmap(bmp(5, 4)[:-1]) is None


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_pixel_means_by_channel(spark, channels):
    raw = bytes(i * 37 % 251 for i in range(12 * channels))
    px = [[float(x) for x in raw[i : i + channels][:3]] for i in range(0, len(raw), channels)]
    r = spark.createDataFrame([(bytearray(raw), channels)], "d binary, c int").select(ingest_qc.pixel_means("d", "c").alias("m")).select("m.*").first()
    assert r.saturation == pytest.approx(sum((max(p) - min(p)) / max(max(p), 1) * 255 for p in px) / 12) and r.brightness == pytest.approx(sum(map(max, px)) / 12)


def test_reports_are_read_once_for_all_fields(spark):
    plan = queries.fhir_export(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and plan.lower().count("from_json") + plan.count("JsonToStructs") + plan.count("jsontostructs") == 1
