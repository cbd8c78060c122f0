"""Collocations, embedding near-dedup and hard negatives against brute force."""

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from predlens.llm import collocations, embedding_dedup, hard_negatives


def brute_phrases(rows, least):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    return {k: v for k, v in f.items() if v >= least}, n


def brute_collocations(rows, least, top):
    f, n = brute_phrases(rows, least)
    best = []
    for (lang, p), a in f.items():
        if len(p) > 1:
            s, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:j]] * f[lang, p[j:]]), j, f[lang, p[:j]], f[lang, p[j:]]) for j in range(1, len(p)))
            held = any(g == lang and len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in f.items())
            if not held:
                best.append((lang, -s, -a, " ".join(p).encode(), left, right))
    out = []
    for lang, rows in itertools.groupby(sorted(best), key=lambda r: r[0]):
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (_, s, a, p, left, right) in enumerate(rows) if i < top]
    return out


def phrase_rows():
    rng = np.random.default_rng(4)
    words = ["a", "B", "ça", "d\x0be", "f g", "h", "日本", "\x00i"]
    rows = [(i, ["en", "de", None, "und"][i % 4], " ".join(rng.choice(words, 12, p=[0.4, 0.2, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])) + rng.choice([".", "!\t", ""])) for i in range(120)]
    rows += [(200, "en", None), (201, "en", ""), (202, None, "..\n!"), (None, "en", "a a a a a a a"), (203, "en", "a a a. a a a"), (203, "en", "a a a. a a a"), (204, "xx", "Rare words only")]
    return rows + [(300 + i, "en", "Very\tlong phrase  of words here ") for i in range(9)] + [(400, "en", "x" * 30000 + " " + "u v w " * 20000)]


def test_collocations_equal_brute_force(spark):
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, lang string, text string, n long, score string").repartition(5)
    for least, top in ((6, 50), (9, 5)):
        got = collocations.collocations(docs, least, top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == sorted(brute_collocations([r[1:] for r in rows], least, top))
    assert collocations.collocations(docs.limit(0)).collect() == []


@pytest.mark.parametrize("block, bits", [(1 << 16, 64), (64, 64), (1 << 16, 6)])
def test_border_failures_are_counted_and_any_filter_is_exact(spark, monkeypatch, block, bits):
    """A phrase that the sample does not hold is a failure, and the pass after it counts what it leads to. A filter that is full
    proposes everything, and counts stay exact; they do also if many phrases share their first hash."""
    monkeypatch.setattr(collocations, "BLOCK_BITS", block)
    monkeypatch.setattr(collocations, "MOST_BLOCKS", 1)
    rows = [r[1:] for r in phrase_rows()]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    got, done = collocations.frequent_phrases(docs, 6, bits=bits)
    f, n = brute_phrases(rows, 6)
    assert {(r.lang, tuple(r.phrase.split(" "))): (r.f, r.n) for r in got.collect()} == {k: (v, n[k[0]]) for k, v in f.items()}
    assert done["failures"][-1] == 0 and (bits == 6 or block == 64 or done["failures"][0] > 0) and (done["shared"] > 0) == (bits == 6)


def test_a_false_positive_and_a_failure_side_by_side_are_in_reach():
    """The first filter has one word by chance, so it is no failure and not proposed again; the second one has the other, which failed."""

    def filter_of(word):
        out = collocations.Bloom(1, [])
        for i in range(collocations.SET_BITS):
            at = int(collocations.Words("en", word).first[0]) >> 16 * i & 0xFFFF
            out.bits[0, at >> 3] |= 1 << (at & 7)
        return out

    words = collocations.Words("en", b"by chance")
    new = {k: at[new].tolist() for k, at, _, _, new in words.phrases([filter_of(b"by"), filter_of(b"chance")])}
    assert new[1] == [] and new[2] == [0]


def test_long_texts_are_cut_where_pieces_end(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 50)
    rows = [("en", "one two three four five. " * 40), ("en", "no end of piece " * 30), ("de", "x")]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "text"])
    got, parts = Counter(), list(collocations.chunks(iter([batch])))
    for lang, text, _ in parts:
        words = collocations.Words(lang, text)
        for k, at, *_ in words.phrases([]):
            got.update((lang, tuple(w.decode() for w in words.names[words.code[i : i + k]])) for i in at.tolist())
            if k == 1:
                break
    want, _ = brute_phrases(rows, 1)
    assert len(parts) > 10 and got == {p: n for p, n in want.items() if len(p[1]) == 1}


def vector_rows(seed=1, n=300, d=6):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d))
    base[100:200] = base[7] + 0.02 * rng.normal(size=(100, d))  # a crowd of near copies
    base[200:240] = base[9]  # and of copies
    rows = [(i, base[i].tolist(), int(i % 4)) for i in range(n)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * d, 1), (903, [1.0, None, *[0.0] * (d - 2)], 1), (904, [float("nan")] * d, 2), (905, [float("inf")] * d, 2), (None, base[0].tolist(), 1)]
    rows += [(906, [1e300] * d, 0), (907, [1e300] * d, 1), (908, [1e-310] * d, 2), (909, [2.0] * 3, 3), (910, [2.0] * 3 + [0.0], None), (3, base[3].tolist(), 3), (5, base[200].tolist(), 2)]
    return rows


def brute_links(rows, least):
    width = max([len(v) for _, v, _ in rows if v], default=0)
    good = [i for i, (k, v, _) in enumerate(rows) if k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    x = np.array([np.pad(rows[i][1], (0, width - len(rows[i][1]))) for i in good]).reshape(len(good), width)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    cosine = (x @ x.T) / np.sqrt((x**2).sum(axis=1)) / np.sqrt((x**2).sum(axis=1))[:, None]
    linked = (cosine >= least) & ~np.eye(len(good), dtype=bool)
    root = {rows[i][0]: rows[i][0] for i in good}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in zip(*np.nonzero(linked), strict=True):
        u, v = find(rows[good[a]][0]), find(rows[good[b]][0])
        root[max(u, v)] = min(u, v)
    n = {i: int(s) for i, s in zip(good, linked.sum(axis=1), strict=True)}
    return sorted(((k, n.get(i, 0), find(k) if i in n else k, (find(k) if i in n else k) == k) for i, (k, _, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("most_rows, least", [(None, 0.9), (40, 0.9), (3, 0.9), (16, 0.99), (5, 0.3)])
def test_embedding_links_equal_brute_force(spark, most_rows, least):
    rows = vector_rows()
    data = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links int, pos string").repartition(3)
    got = embedding_dedup.link(data, least, most_rows=most_rows)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_links(rows, least)
    assert embedding_dedup.link(data.limit(0)).collect() == []
    assert embedding_dedup.link(data.where("vec_id >= 900 AND vec_id < 906")).where("kept AND n_links = 0").count() == 6


def test_a_crowd_is_counted_without_its_pairs(spark):
    """Intervals that are provably near are answered from their sizes; those that are far are skipped."""
    rng = np.random.default_rng(0)
    crowd = 1 + 0.001 * rng.normal(size=(3000, 8))
    far = -1 + 0.001 * rng.normal(size=(1000, 8))
    basis = embedding_dedup.basis_of(embedding_dedup.units([embedding_dedup.pack(v.tolist()) for v in crowd[:100]], 8)[1])
    a, b = (embedding_dedup.Sequence(np.arange(len(x)), np.arange(len(x)), [embedding_dedup.pack(v.tolist()) for v in x], basis) for x in (crowd, far))
    own, apart = embedding_dedup.Join(a, a, 0.9), embedding_dedup.Join(a, b, 0.9)
    assert own.compared == 0 and (own.n[0] == 2999).all() and apart.compared == 0 and not apart.n[0].any()


def brute_negatives(rows, is_anchor, k=5, scale=256.0, percent=80):
    width = max([len(v) for _, v, _ in rows if v], default=0)
    take = [(i, [int(np.floor(scale * c)) for c in v] + [0] * (width - len(v)), t) for i, v, t in rows if i is not None and t is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for i, v, t in {(i, tuple(v), t) for i, v, t in take if is_anchor(i)}:
        scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, u) for j, w, u in take if j != i]
        for s, p, _ in sorted(x for x in scores if x[2] == t)[:k]:
            window = sorted(x for x in scores if x[2] != t and percent * -s <= 100 * -x[0] <= 100 * -s)[:k]
            out += [(i, p, r + 1, j, -s, -z) for r, (z, j, _) in enumerate(window)]
    return sorted(out)


@pytest.mark.parametrize("anchors, rows_of_a_task", [(1024, 4096), (7, 30)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, anchors, rows_of_a_task):
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", rows_of_a_task)
    monkeypatch.setattr(hard_negatives, "MOST_ROWS", rows_of_a_task)
    rows = [r for r in vector_rows() if r[0] not in (906, 907)] + [(1000 + i, [0.5, 0.5, 0.25], i % 3) for i in range(12)]  # ties
    data = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, label int, score int").repartition(3)
    got = hard_negatives.mine(data, F.col("vec_id") % 5 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i % 5 == 0)
    assert hard_negatives.mine(data.limit(0), F.col("vec_id") % 5 == 0).collect() == []


def test_hard_negatives_of_any_size(spark):
    rows = [(i, [float(x) * 10.0 ** (i % 3 * 120) for x in np.random.default_rng(i).normal(size=3)], i % 2) for i in range(40)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    clip = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    want = [(*r[:4], clip(r[4]), clip(r[5])) for r in brute_negatives(rows, lambda i: i % 5 == 0)]
    assert sorted(map(tuple, hard_negatives.mine(data, F.col("vec_id") % 5 == 0).collect())) == sorted(want)


def test_bounds_save_scores():
    rng = np.random.default_rng(3)
    centres = 200 * rng.normal(size=(20, 16))
    points = np.floor(np.repeat(centres, 60, axis=0) + rng.normal(size=(1200, 16)))
    anchors, seen = points[::12], {}
    exact = anchors @ points.T
    low, high = np.quantile(exact, 0.97, axis=1), exact.max(axis=1)
    scored = hard_negatives.scan(anchors, points, low.copy(), high, lambda i, c, s: seen.setdefault(i, []).append((c, s)))
    assert scored < 0.5 * exact.size
    for i in range(len(anchors)):
        c, s = (np.concatenate(x) for x in zip(*seen[i], strict=True))
        assert (exact[i, c] == s).all() and set(np.flatnonzero((exact[i] >= low[i]) & (exact[i] <= high[i]))) <= set(c.tolist())
