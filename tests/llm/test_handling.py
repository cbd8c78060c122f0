"""Cases of handling that the docstrings define, and results that no other test holds against a brute-force version."""

import hashlib
import io
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from predlens.llm import license_scan, line_dedup, media, mixing, topk

from ..conftest import DATA


def brute_feature(text):
    """Area means by exact fractions, over the pixels of the stored image."""
    raw = (text or "").encode()
    raw += b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
    px = np.frombuffer(raw, np.uint8).reshape(-1, 64, 3).sum(axis=2).tolist()
    h, w = len(px), 64

    def overlap(i, n, size, k):
        low, high = max(Fraction(i * size, n), k), min(Fraction((i + 1) * size, n), k + 1)
        return max(high - low, Fraction(0))

    cells = [[sum(overlap(y, 8, h, r) * overlap(x, 9, w, c) * px[r][c] for r in range(h) for c in range(w) if overlap(y, 8, h, r) and overlap(x, 9, w, c)) / (3 * Fraction(h, 8) * Fraction(w, 9)) for x in range(9)] for y in range(8)]
    bits = "".join("1" if row[x + 1] - row[x] > Fraction(1, 10**6) else "0" for row in cells for x in range(8))
    tile = np.array([[int(c + Fraction(1, 2)) for c in row] for row in cells], np.uint8)
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return f"dhash:{int(bits, 2):016x};tile:{hashlib.sha256(out.getvalue()).hexdigest()[:16]}", tile


def test_features_of_images_against_exact_areas(spark):
    texts = ["", None, "x", "Some words, " * 40, "日本 🙂 " * 90, "".join(chr(33 + i * i % 90) for i in range(1500)), "x"]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, feature int")
    got = {r.doc_id: r for r in media.media_columns(rows, keep_media=True).collect()}
    for i, t in enumerate(texts):
        feature, tile = brute_feature(t)
        assert got[i].feature == feature
        assert (np.load(io.BytesIO(bytes(got[i].tile))) == tile).all()
    same = lambda r: tuple(r)[1:]
    assert same(got[2]) == same(got[6]) and same(got[0]) == same(got[1])  # equal texts, equal values


def test_line_dedup_of_one_id_with_several_texts_and_a_very_long_line(spark):
    long = "w " * 200_000
    rows = [(1, "a\nb\nc\nd"), (1, "x\na\nb\nc"), (1, "a\nb\nc\nd"), (2, f"{long}\nq\nr\na\nb\nc"), (3, f"z\n{long}\nq\nr")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # of one id the first place by the text's hash counts; rows with equal texts are one place
    ones = sorted((r.text, r.n_removed) for r in got if r.doc_id == 1)
    assert ones in ([("a\nb\nc\nd", 0), ("a\nb\nc\nd", 0), ("x", 3)], [("d", 3), ("d", 3), ("x\na\nb\nc", 0)])
    assert {r.doc_id: (r.text, r.n_removed) for r in got if r.doc_id > 1} == {2: (f"{long}\nq\nr", 3), 3: ("z", 3)}


def test_mixing_counts_long_texts_whole(spark):
    rows = [(1, "a", "word " * 300_000), (2, "a", "one"), (3, "b", "two three")]
    plan, names = mixing.plan(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    got = {r.doc_id: (r[names["size"]], r[names["taken"]]) for r in plan.collect()}
    assert [got[i][0] for i in (1, 2, 3)] == [300_000, 1, 2] and got[3][1] == 6


def test_license_scan_of_null_ids_and_repeated_rows(spark):
    rows = [(None, "CC BY 4.0"), (1, "gpl: general public license"), (1, "gpl: general public license"), (2, None)]
    got = [tuple(r) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == 4 and got.count(next(r for r in got if r[0] == 1)) == 2
    none = next(r for r in got if r[0] is None)
    assert none[2] == 1 and "cc-by" in none


def test_search_of_shared_ids_and_vectors_of_different_lengths(spark):
    rows = [(0, [1.0, 2.0]), (0, [3.0]), (1, [1.0]), (2, [1.0, 1.0, 5.0]), (3, []), (4, [2.0, 2.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.search(data, F.col("vec_id") % 20 == 0, k=3, scale=1.0).collect()))
    full = [(i, v + [0.0] * (3 - len(v))) for i, v in rows]
    scored = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), j) for i, q in full if i == 0 for j, v in full if j != 0))
    assert got == [(0, r + 1, j, -int(s)) for r, (s, j) in enumerate(scored[:3])]


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_a_very_long_text_whole(spark, stage):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = docs.where("lang = 'en' AND n_chars > 300").orderBy("doc_id").first().text.replace("\n", " ")
    long = "\n".join(f"{i} {text}" for i in range(400))
    one = docs.limit(1).withColumns({"doc_id": F.lit(10**6).cast("long"), "text": F.lit(long), "lang": F.lit("en"), "source": F.lit("src0"), "n_chars": F.lit(len(long)).cast(docs.schema["n_chars"].dataType)})
    out = corpus_pipeline.STAGES[stage][1](spark, docs.unionByName(one), DATA).where(f"doc_id = {10**6}").collect()
    assert (out or stage == 3) and all(r.text == long for r in out)  # a mix may leave a document out, but cuts none
