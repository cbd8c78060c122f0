import random
from collections import Counter

import pytest

from predlens.llm import line_dedup, mixing

SCHEMA = "doc_id long, text string, source string, n_lines string"


def brute_lines(docs):
    """By (id, line number): the first place of a window keeps its lines, later ones lose them."""
    places, out = {}, []
    docs = [(i, t) for i, t in docs]
    for i, t in sorted((d for d in docs if d[0] is not None and d[1] is not None)):
        lines = ["" if not x.strip(" ") else x for x in t.split("\n")]
        for at in range(len(lines) - 2):
            w = tuple(lines[at : at + 3])
            if any(w):
                places.setdefault(w, set()).add((i, t, at))
    later = {}
    for found in places.values():
        for i, t, at in sorted(found)[1:]:
            later.setdefault((i, t), set()).update((at, at + 1, at + 2))
    for i, t in docs:
        if t is None:
            out.append((i, None, 0, 0))
        else:
            gone = later.get((i, t), set())
            lines = t.split("\n")
            out.append((i, "\n".join(x for n, x in enumerate(lines) if n not in gone), len(lines), len(gone)))
    return out


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "s", "mine") for i, t in docs], SCHEMA)


def result(df):
    return sorted(((r.doc_id, r.text, r["_n_lines"], r["n_removed"]) for r in df.collect()), key=repr)


CASES = {
    "empty": [],
    "edges": [(1, None), (None, "a\nb\nc"), (2, "a\nb\nc"), (3, ""), (4, "x"), (5, "\n\n\n\n"), (6, " \n\n  \n"), (7, "a\nb\nc\n")],
    "copies": [(i, "a\nb\nc\nd\ne") for i in range(5)] + [(3, "a\nb\nc\nd\ne")],
    "overlap": [(1, "a\na\na\na\na\na\nb"), (2, "q\nr\ns\nt\nu"), (3, "0\nq\nr\ns\nt\n1"), (4, "s\nt\nu\nr")],
    "long": [(1, "\n".join(f"l{i}" for i in range(20000))), (2, "\n".join(f"l{i}" for i in range(10000, 30000)))],
}


@pytest.mark.parametrize("case", CASES)
def test_line_dedup(spark, case):
    docs = CASES[case]
    out = line_dedup.line_dedup(frame(spark, docs))
    assert out.columns == ["doc_id", "text", "source", "n_lines", "_n_lines", "n_removed"]
    assert result(out) == sorted(brute_lines(docs), key=repr)


def test_line_dedup_random(spark):
    rng = random.Random(3)
    docs = [(i, "\n".join(rng.choice("abc ") for _ in range(rng.randrange(12)))) for i in range(60)]
    assert result(line_dedup.line_dedup(frame(spark, docs))) == sorted(brute_lines(docs), key=repr)


def test_line_dedup_has_no_python(spark):
    plan = line_dedup.line_dedup(frame(spark, CASES["copies"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def mixed(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, size string, position int")
    rows, names = mixing.plan(df)
    return [{k: r[v] for k, v in names.items()} | {"doc_id": r.doc_id, "source": r.source} for r in rows.collect()], df


def targets(sizes):
    """Water filling by repeated sharing."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, out, open_ = sum(sizes.values()), dict.fromkeys(sizes, 0.0), set(sizes)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * unit > 3 * sizes[s]}
        if not over:
            return out | {s: weight[s] * unit for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mixing(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice(["b", "a", "é", None, "c"]), " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(40))), "own", 1) for i in range(300)]
    docs += [(300, "a", None, None, None), (None, "a", "x y", "s", 2), (301, "tiny", "one two", "s", 3), (7, docs[7][1], docs[7][2], "own", 1), (302, "none", "", "s", 1)]
    rows, df = mixed(spark, docs)
    sizes = {}
    for _, s, t, _, _ in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) < 1.001
        assert all(r["taken"] <= 3 * r["size"] for r in own)
    assert sum(r["taken"] for r in rows) == pytest.approx(sum(sizes.values()), abs=len(sizes))
    out = mixing.mix(df)
    assert out.columns == df.columns
    whole = Counter((r["doc_id"], r["source"], r["size"]) for r in rows for c in r["copies"] if 2 * c["take"] >= r["size"])
    assert Counter((r.doc_id, r.source, len(r.text.split())) for r in out.collect()) == whole
    texts = {(i, s): t for i, s, t, _, _ in docs}
    assert all(r.text == texts[r.doc_id, r.source] for r in out.collect())
    for s in sizes:
        assert abs(sum(n * m for (_, t, n), m in whole.items() if t == s) - want[s]) <= max(r["size"] for r in rows if r["source"] == s) / 2 + 1
    again, _ = mixed(spark, docs)
    assert sorted(again, key=repr) == sorted(rows, key=repr)


def test_mixing_follows_the_schedule(spark):
    docs = [(i, s, "w " * 20, None, None) for s in "abc" for i in range(ord(s) * 1000, ord(s) * 1000 + 400)]
    rows, _ = mixed(spark, docs)
    early = {s: sum(c["position"] < 0.5 for r in rows if r["source"] == s for c in r["copies"]) / sum(len(r["copies"]) for r in rows if r["source"] == s) for s in "abc"}
    assert early["a"] == pytest.approx(0.625, abs=0.02) and early["b"] == pytest.approx(0.5, abs=0.02) and early["c"] == pytest.approx(0.25 / 0.875, abs=0.02)


def test_mixing_empty(spark):
    assert mixed(spark, [])[0] == []
    rows, _ = mixed(spark, [(1, "a", "", None, None)])
    assert rows[0]["taken"] == 0 and rows[0]["target"] == 0
