import itertools
import math
import random
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from predlens.llm import components, language_id, license_scan, media, near_dedup, topk, toxicity
from predlens.llm.common import held_out

from ..conftest import DATA


def crowd(n, low, high, seed):
    """Variants of one text of 200 words, each with some words changed."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [f"b{i}" for i in range(200)]
        for i in rng.sample(range(200), rng.randint(low, high)):
            words[i] = f"v{rng.randrange(10**9)}"
        out.append(words)
    return out


def true_components(docs, width):
    sets = [{tuple(w[j : j + width]) for j in range(len(w) - width + 1)} for w in docs]
    number = {s: i for i, s in enumerate(set().union(*sets))}
    m = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        m[i, [number[x] for x in s]] = 1
    both, n = m @ m.T, m.sum(axis=1)
    near = 100 * both >= 80 * (n[:, None] + n - both)
    label, old = np.arange(len(sets)), None
    while old is None or (label != old).any():
        old, label = label, np.array([label[near[i]].min() for i in range(len(sets))])
    return label


@pytest.mark.parametrize(("n", "low", "high"), [(700, 6, 8), (600, 7, 9), (700, 8, 10)])
def test_crowds_lose_no_link(spark, n, low, high):
    docs = crowd(n, low, high, low)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.link(df, 2).collect()}
    assert [got[i] for i in range(n)] == true_components(docs, 2).tolist()


def template(n, seed, shared=130, own=30):
    """Pages of one template, similar to 0.5 to 0.75, of which a few are near copies of others."""
    rng, out = random.Random(seed), []
    frame = [f"t{i}" for i in range(shared)]
    for i in range(n):
        if i % 40 == 7:
            out.append([w if rng.random() > 0.02 else f"e{rng.randrange(10**9)}" for w in out[rng.randrange(len(out))]])
        else:
            cut = rng.randrange(shared)
            out.append([*frame[:cut], *(f"p{rng.randrange(10**9)}" for _ in range(own)), *frame[cut:]])
    return out


def test_pages_of_a_template_meet_by_rare_shingles(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PREFIX_FROM", 0)
    n = 1500
    docs = template(n, 3)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    blocks = []
    monkeypatch.setattr(near_dedup, "_crowded", lambda dense, *a, f=near_dedup._crowded: (blocks.append(dense.where("outside AND met").count()), f(dense, *a))[1])
    got = {r.doc_id: r.component_id for r in near_dedup.link(df, 2).collect()}
    true = true_components(docs, 2).tolist()
    assert [got[i] for i in range(n)] == true and len(set(true)) < n
    assert blocks[-1] == 0  # no node met all of its region
    sets = [(i, bytearray(near_dedup.shingles(" ".join(w), 2).tobytes())) for i, w in enumerate(docs)]
    dense = spark.createDataFrame([(i, 0, i, True) for i in range(n)], "id long, region long, root long, outside boolean")
    pairs = near_dedup.rare_pairs(near_dedup.rare_shingles(dense, spark.createDataFrame(sets, "id long, set binary"), 80), 80)
    assert pairs.count() < 0.05 * n * (n - 1) / 2
    met = {(r.a, r.b) for r in pairs.collect()}
    size = lambda a, b: (100 * len(set(a) & set(b)), len(set(a) | set(b)))
    tokens = [near_dedup.shingles(" ".join(w), 2).tolist() for w in docs[:300]]
    for a, b in itertools.combinations(range(300), 2):
        both, either = size(tokens[a], tokens[b])
        assert both < 80 * either or (a, b) in met


def test_rows_that_share_an_id(spark):
    text = "a b c d e f g h i j k l m n o p q r s t"
    rows = [(1, text), (2, text), (2, "quite another text of some words"), (2, None), (3, "quite another text of some words"), (4, text + " u")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first, again = (sorted(map(tuple, near_dedup.link(d, 2).collect())) for d in (df, df.orderBy(F.desc("text")).repartition(3)))
    assert first == again and len(first) == len(rows)
    ids = {}
    for i, n, c, _ in first:
        if n:
            ids.setdefault(i, set()).add(c)
    assert all(len(c) == 1 for c in ids.values())


def test_components_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(components, "EDGES", 40)
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 50)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    out, _ = components.components(spark.createDataFrame(edges, "u long, v long").repartition(4))
    assert {(r.node, r.root) for r in out.collect()} == {(x, r) for x, r in root.items() if x != r}


def test_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60 if i % 2 else 5000, rng.integers(1, 80)).astype(np.uint64)) for i in range(300)]
    out = near_dedup.intersections(sets[:70], sets)
    assert all(out[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(70) for j in range(300))


@pytest.mark.parametrize("big", [1e9, 1e307])
def test_search_of_huge_components(spark, big):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=4) * big).tolist()) for i in range(40)] + [(i, rng.normal(size=4).tolist()) for i in range(100, 140)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.search(df, F.col("vec_id") % 20 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {i: [math.floor(Fraction(x) * 64) for x in v] for i, v in rows}
    for q in (i for i in whole if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(best)]


def test_letters():
    assert language_id.letters("½ ² ①") == [] and language_id.letters("ab½cd é2x") == ["ab", "cd", "é", "x"]


def test_expected_counts_sum_over_all_segmentations():
    rng = random.Random(2)
    index = {p: i for i, p in enumerate(sorted({"".join(rng.choices("ab▁", k=n)) for n in range(1, 5) for _ in range(12)}))}
    prob = np.random.default_rng(0).random((len(index), 1)) / len(index)
    words, counts = ["".join(rng.choices("abz", k=rng.randrange(1, 8))) for _ in range(12)], np.arange(1.0, 13.0)
    want = np.zeros(len(index))
    for word, n in zip(words, counts, strict=True):
        word, ways = language_id.MARK + word, []
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
            parts = [word[a:b] for a, b in itertools.pairwise(at)]
            ways.append((math.prod(prob[index[p], 0] if p in index else language_id.UNKNOWN if len(p) == 1 else 0.0 for p in parts), parts))
        total = sum(p for p, _ in ways)
        for p, parts in ways:
            for x in parts:
                if x in index:
                    want[index[x]] += n * p / total
    model = language_id.Lattice(index, prob)
    assert model.expected(words, counts) == pytest.approx(want)
    assert np.isfinite(model.expected(["ab" * 3000], np.ones(1))).all()


def test_junk_goes_and_nothing_learned_keeps_all(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rng = random.Random(0)
    junk = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=300)), "qzxj vkqw zzzx " * 20]
    more = docs.limit(2).select((F.col("doc_id") + 10**6).alias("doc_id"), F.lit(junk[0]).alias("text"), *docs.columns[2:]).unionByName(docs.limit(1).withColumns({"doc_id": F.lit(10**7).cast("long"), "text": F.lit(junk[1])}))
    kept = {r.doc_id for r in language_id.keep_identified(docs.unionByName(more.select(docs.columns)), P.path("piece_bpe_32k.model")).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.keep_identified(unknown, P.path("piece_bpe_32k.model")).count() == docs.count()


def test_toxicity_of_held_out_documents(spark):
    folder = DATA.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    held = [(r.toxic, out[r.doc_id].score) for r in labels.where(held_out("doc_id")).collect() if r.doc_id in out]
    pos, neg = [s for y, s in held if y == 1], [s for y, s in held if y == 0]
    assert np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]) > 0.75
    changed = labels.withColumn("toxic", F.when(held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {i: r.score for i, r in out.items()} == {r.doc_id: r.score for r in toxicity.score(docs, changed).collect()}


def test_risk_and_gradient_against_differences():
    rng = np.random.default_rng(2)
    sets = [[np.unique(rng.integers(0, 6, 3)) for _ in range(n)] for n in (5, 9)]
    w, prior = rng.normal(size=7), 0.3
    z = lambda rows, w: np.array([w[r].sum() + w[6] for r in rows])
    soft = lambda x: np.log1p(np.exp(x))
    parts = lambda w: (soft(z(sets[1], w)).mean() - prior * soft(z(sets[0], w)).mean(), prior * soft(-z(sets[0], w)).mean())
    clean, toxic, as_clean = toxicity.risk(w, *map(toxicity.matrix, sets), prior)
    assert clean == pytest.approx(parts(w)[0])
    for i in range(7):
        step = np.eye(7)[i] * 1e-6
        up, down = parts(w + step), parts(w - step)
        assert as_clean[i] == pytest.approx((up[0] - down[0]) / 2e-6, abs=1e-6) and toxic[i] == pytest.approx((up[1] - down[1]) / 2e-6, abs=1e-6)


@pytest.mark.parametrize(("text", "labels"), [
    ("(SPDX-License-Identifier: MIT)", "permissive,spdx:mit"), ("/* SPDX-License-Identifier: BSL-1.0 */", "permissive,spdx:bsl-1.0"), ("SPDX-License-Identifier: LicenseRef-x", "spdx:licenseref-x,unknown"),
    ("SPDX-License-Identifier: 0BSD", "permissive,spdx:0bsd"), ("SPDX-License-Identifier: CC-BY-4.0", "cc-by,permissive,spdx:cc-by-4.0,terms:permissive"),
    ("under the MIT License or the Apache License, Version 2.0", "apache,mit,terms:permissive"), ("the MIT License and the GNU General Public License", "gpl,mit,terms:copyleft"),
    ("MIT License. Other parts: Mozilla Public License.", "mit,mpl,terms:permissive,terms:weak-copyleft"),
])
def test_tags_and_notices(text, labels):
    assert license_scan.Scanner().row(text)[5] == labels


def test_images_are_resized_in_bands(monkeypatch):
    px = np.random.default_rng(0).integers(0, 256, (97, 64, 3)).astype(np.uint8)
    whole = media.area_resize(px, 8, 9)
    for band in (1, 7, 96):
        monkeypatch.setattr(media, "BAND", band)
        assert media.area_resize(px, 8, 9) == pytest.approx(whole)


@pytest.mark.parametrize("case", ["odd", "none"])
def test_pipeline_of_odd_documents(spark, case):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20).withColumn("n_tokens", F.lit("own"))
    odd = docs.limit(1).unionByName(docs.limit(1)).select(F.explode(F.array(F.lit(None).cast("long"), F.lit(10**6))).alias("doc_id"), F.lit(None).cast("string").alias("text"), *docs.columns[2:])
    docs = docs.limit(0) if case == "none" else docs.unionByName(docs.limit(3)).unionByName(odd).unionByName(odd.withColumn("text", F.lit("")))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        assert k == 4 or out.columns == docs.columns
        docs = out
    assert docs.count() > 0 if case == "odd" else docs.count() == 0
