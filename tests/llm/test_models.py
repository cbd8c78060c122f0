import itertools
import math
import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from predlens.llm import components, language_id, near_dedup, topk, toxicity

from ..conftest import DATA


def test_lattice_sums_all_segmentations():
    rng = random.Random(2)
    index = {p: i for i, p in enumerate(sorted({"".join(rng.choices("ab▁", k=n)) for n in range(1, 5) for _ in range(12)}))}
    prob = np.random.default_rng(0).random((len(index), 2)) / len(index)
    model = language_id.Lattice(index, prob)

    def brute(word, k):
        word, total = language_id.MARK + word, 0.0
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
            parts = [word[a:b] for a, b in itertools.pairwise(at)]
            total += math.prod(prob[index[p], k] if p in index else language_id.UNKNOWN if len(p) == 1 else 0.0 for p in parts)
        return math.log(total)

    words = ["".join(rng.choices("abz", k=rng.randrange(1, 9))) for _ in range(30)]
    out = model.forward(words)
    for i, w in enumerate(words):
        assert out[i] == pytest.approx([brute(w, 0), brute(w, 1)])
    assert np.isfinite(model.forward(["ab" * 20000])).all()


def test_language_id(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", F.lit("own").alias("score"))
    odd = spark.createDataFrame([(10**6, None, "en", None, "o"), (10**6 + 1, "", None, None, "o"), (10**6 + 2, "12 !", "en", None, "o"), (None, "the and", None, None, "o"), (10**6 + 3, "x" * 30000, None, None, "o")], docs.schema)
    out = language_id.identify(docs.unionByName(odd), P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == docs.count() + 5
    assert all(got[10**6 + i].lang_pred == "und" and got[10**6 + i].score == 0 for i in range(3))
    known = {r.doc_id: r.lang for r in docs.collect()}
    held = [got[i].lang_pred == g for i, g in known.items() if got[i].held_out]
    assert held and sum(held) / len(held) > 0.95
    kept = language_id.keep_identified(docs.unionByName(odd), P.path("piece_bpe_32k.model"))
    assert kept.columns == docs.columns and kept.count() >= docs.count() - 1
    empty = language_id.identify(docs.limit(0), P.path("piece_bpe_32k.model"))
    assert empty.collect() == [] and language_id.identify(odd.withColumn("lang", F.lit(None).cast("string")), P.path("piece_bpe_32k.model")).where("lang_pred <> 'und'").count() == 0


def test_language_id_by_brute_force_of_many_languages_and_long_pieces(spark):
    """More languages than any fixed number, a piece of 40 characters, ties, and repeated rows: predictions equal sums over segmentations."""
    long = "x" * 40
    index = {p: i for i, p in enumerate(sorted(["▁", "a", "b", "ab", "▁a", long, "▁" + long]))}
    prob = np.random.default_rng(1).random((len(index), 150)) / 10
    prob[:, 1] = prob[:, 0]  # a tie, which the first by name wins
    names = [f"l{i:03d}" for i in range(150)]
    scorer = language_id.Scorer(sorted(index), names, prob)

    def brute(word, k):
        word, total = language_id.MARK + word, [1.0]
        for end in range(1, len(word) + 1):
            total.append(sum(total[b] * (prob[index[word[b:end]], k] if word[b:end] in index else language_id.UNKNOWN if end - b == 1 else 0.0) for b in range(end)))
        return math.log(total[-1])

    texts = ["ab a b", "b b b", long + " ab", "AB, a!", "ab a b", None, "12 !", "é"]
    got = scorer.predict(texts)
    for t, g, s in zip(texts, *got[:2], strict=True):
        words = language_id.letters(t.lower()) if t else []
        total = [sum(brute(w, k) for w in words) for k in range(150)]
        if not words:
            assert (g, s) == ("und", 0.0)
            continue
        best = max(total)
        assert g == names[next(k for k, x in enumerate(total) if x > best - 1e-9)]
        assert s == pytest.approx(1 / sum(math.exp(x - best) for x in total))
    docs = spark.createDataFrame([(i, f"word{chr(97 + i % 13) * 3} text", f"l{i % 140:03d}") for i in range(1400)], "doc_id long, text string, lang string")
    langs, weights = language_id.fit(docs, sorted(index))
    assert len(langs) == 140 and weights.shape == (len(index), 140)


def test_toxicity_does_not_depend_on_the_order_of_rows_or_on_copies(spark):
    folder = DATA.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")
    three = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10**6)).unionByName(docs.withColumn("doc_id", F.col("doc_id") + 2 * 10**6))
    again = labels.unionByName(labels.withColumn("toxic", F.lit(0)))  # an id with two labels is toxic if any says so
    for rows, known in ((docs, labels), (three, labels), (docs, again)):
        a, b = ({r.doc_id: r.score for r in toxicity.score(x, y).collect()} for x, y in ((rows, known), (rows.orderBy(F.desc("text"), F.desc("doc_id")).repartition(7, "text"), known.orderBy(F.rand(3)))))
        assert a.keys() == b.keys() and max(abs(a[i] - b[i]) for i in a) < 1e-9
    first = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    assert first == {r.doc_id: r.score for r in toxicity.score(docs, again).collect()}


def test_toxicity_features_and_scores_by_brute_force(spark):
    rows = [(i, ("vile nasty " if i < 30 else "calm ") + " ".join([*["words", "about", "skin"][: i % 4], f"n{i}"]), int(i < 30)) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    names, weights = toxicity.fit(docs, labels)
    assert {"vile#1", "nasty#1"} <= set(names) and not any(n.startswith(("calm", "words")) for n in names)

    def brute(text):
        found = set()
        for w in set(text.lower().split()):
            for p in [w] + [w[:k] + "*" for k in (5, 6, 7) if len(w) > k]:
                n = sum((v == p) if "*" not in p else (len(v) > len(p) - 1 and v.startswith(p[:-1])) for v in text.lower().split())
                found |= {f"{p}#{k}" for k in (1, 2, 4) if n >= k}
        z = [w[-1] + sum(w[i] for i, n in enumerate(names) if n in found) for w in weights]
        return sum(1 / (1 + math.exp(-x)) for x in z) / len(z)

    for r in toxicity.score(docs, labels).collect():
        assert r.score == pytest.approx(brute(rows[r.doc_id][1])) and r.predicted == int(r.score >= 0.3)


def test_toxicity(spark):
    folder = DATA.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 1), (10**6 + 1, "", "en", "s", 1), (None, "idiot", "en", "s", 1), (10**6 + 2, "w " * 40000, "en", "s", 1)], docs.schema)
    rows = toxicity.score(docs.unionByName(odd), labels).collect()
    assert len(rows) == docs.count() + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    truth, got = {r.doc_id: r.toxic for r in labels.collect()}, {r.doc_id: r for r in rows}
    pairs = [(truth[i], r.score) for i, r in got.items() if i in truth]
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    assert np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]) > 0.8
    none = toxicity.score(docs.limit(5), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.score(docs.limit(0), labels).collect() == []


def test_nnpu_finds_hidden_positives():
    rng = np.random.default_rng(1)
    doc = lambda toxic: np.array(sorted({0 if toxic and rng.random() < 0.9 else 1, *rng.integers(2, 30, 5)}))
    w = toxicity.train([doc(True) for _ in range(200)], [doc(rng.random() < 0.2) for _ in range(1000)], 30, 0.2, 0)
    assert w[0] + w[30] > 0 > w[1] + w[30]


@pytest.mark.parametrize("k", [1, 20])
def test_search(spark, k):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) + i % 3).tolist()) for i in range(700)] + [(i, [1.0] * 8) for i in range(700, 1500)] + [(2000, [300.0] * 8), (2020, [-0.01] * 8), (2040, [600.0, *[0.0] * 7])]
    bad = [(5000, None), (5020, [None] * 8), (5040, [float("nan")] * 8), (None, [1.0] * 8), (5060, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, score string")
    out = topk.search(df, F.col("vec_id") % 20 == 0, k).collect()
    ids = np.array([i for i, _ in rows])
    m = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(float))
    got = {}
    for r in out:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    asked = [n for n, i in enumerate(ids) if i % 20 == 0]
    assert set(got) == {int(ids[n]) for n in asked}
    for n in asked:
        s = m @ m[n]
        best = sorted((-int(s[j]), int(ids[j])) for j in range(len(ids)) if j != n)[:k]
        assert sorted(got[int(ids[n])]) == [(i + 1, x, -s_) for i, (s_, x) in enumerate(best)]


def test_search_of_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") == 0).collect()] == [(0, 1, 64 * 128)]
    assert topk.search(df.limit(0), F.lit(True)).collect() == []
    assert topk.search(df.limit(1), F.lit(True)).collect() == []


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, 2000 + i) for i in range(1, 50)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    out, _ = components.components(spark.createDataFrame(edges, "u long, v long"))
    assert {(r.node, r.root) for r in out.collect()} == {(x, r) for x, r in root.items() if x != r}


def brute_links(docs, width):
    sets = {}
    for i, t in docs:
        if i is not None:
            w = (t or "").encode().lower().split()
            sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup(spark, width):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one two"), (7, "x y\tz"), (8, "x Y z")]
    base = [[word() for _ in range(rng.randrange(40, 120))] for _ in range(30)]
    for n, b in enumerate(base):
        for k in range(rng.randrange(1, 9)):
            w = list(b)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = word()
            docs.append((1000 - n * 10 - k, " ".join(w)))
    docs.append((2000, " ".join(word() for _ in range(30000))))
    docs.append((2001, docs[-1][1] + " more"))
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, component_id int")
    out = near_dedup.link(df, width).collect()
    want = brute_links(docs, width)
    assert len(out) == len(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out)
    kept = near_dedup.keep_one(df, width)
    assert kept.columns == df.columns and kept.count() == 1 + sum(i == c for i, (_, c) in want.items())


def test_near_dedup_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.link(df).collect() == []
    assert [r.component_id for r in near_dedup.link(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).collect()] == [1]


def test_near_dedup_of_a_star(spark):
    rng = np.random.default_rng(8)
    n, size = 3000, 400
    rows = [list(range(size))]
    for k in range(n):
        changed = rng.choice(size, 40, replace=False)
        row = np.arange(size)
        row[changed] = size + k * 40 + np.arange(40)
        rows.append(row.tolist())
    sets = [set(r) for r in rows]
    assert max(len(a & b) / len(a | b) for a, b in itertools.combinations(sets[1:60], 2)) < 0.8
    ids = rng.permutation(n + 1).tolist()
    df = spark.createDataFrame([(i, " ".join(f"w{x}" for x in r)) for i, r in zip(ids, rows, strict=True)], "doc_id long, text string")
    assert {r.component_id for r in near_dedup.link(df, 1).collect()} == {0}
