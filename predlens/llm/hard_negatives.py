"""Hard-negative mining with spanning-tree bounds between anchors.

An anchor's positives are its best rows of the same label. Hard negatives of a positive are the best rows of other labels whose score
lies in a window below the positive's. Anchors that meet in a task are joined by a minimum spanning tree. A candidate's score at a
child anchor lies within its score at the parent, plus or minus the edge's length times the candidate's norm; only candidates whose
bounds overlap what the child still looks for are scored again, the bounds of the others are handed on to the child's children.

Both searches deal anchors and candidates to tasks of bounded size. For positives the label is the key, and a label's anchors and
rows are cut into parts and slices. For negatives anchors are dealt to the nearest of a few hubs, and a row goes to the hubs
whose anchors' windows its bounds at the hub overlap: the same bound, one step above the trees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, map_rows, save
from .topk import lengths, order_key, pack, pivots_of, products, unpack

#: Rows of a sample; most hubs; anchors of a task; least and most candidates of a task; tasks that the candidates are cut into at least.
SAMPLE, HUBS, ANCHORS, LEAST_ROWS, MOST_ROWS, SLICES = 2048, 256, 1024, 4096, 131072, 12
#: Parts that the rows of a label are dealt to where label counts are joined; bounds that are held at once; anchors of a step.
SALTS, BOUNDS, STEP = 16, 4_000_000, 128
#: Share of pairs that need their score from which on all pairs of a step are scored.
MANY = 0.25


class AnchorTree:
    """A minimum spanning tree over points: its levels as (nodes, parents, lengths of the edges to them)."""

    def __init__(self, points: np.ndarray):
        m = len(points)
        parent, edge = np.zeros(m, int), np.full(m, np.inf)
        root = int(lengths(points - points.mean(axis=0)).argmin()) if m else 0
        depth, left = np.zeros(m, int), np.ones(m, bool)
        node = root
        for _ in range(m):
            left[node] = False
            away = lengths(points - points[node])
            nearer = left & (away < edge)
            edge[nearer], parent[nearer] = away[nearer], node
            if not left.any():
                break
            node = int(np.where(left, edge, np.inf).argmin())
            depth[node] = depth[parent[node]] + 1
        self.levels = [(at := np.flatnonzero(depth == k), parent[at], edge[at]) for k in range(depth.max(initial=-1) + 1)] if m else []


def best_of(held: list[tuple[int, int]], scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (-score, id) of what is held and new ones."""
    if len(scores) > 4 * k and scores.dtype != object:
        keep = scores >= np.partition(scores, -k)[-k]
        scores, ids = scores[keep], ids[keep]
    return sorted(held + [(-int(s), i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)])[:k]


def scan(anchors: np.ndarray, candidates: np.ndarray, low: np.ndarray, high: np.ndarray, found, down: bool = False) -> int:
    """Calls found(anchor, columns, scores) with the exact scores of candidates that may lie between the anchor's low and high; found may raise low
    meanwhile. Gives the number of pairs scored. Where scores may pass 2**53 there are no bounds, and all pairs are scored."""
    huge = down or (anchors.size and candidates.size and np.abs(anchors).max() * np.abs(candidates).max() * anchors.shape[1] >= 2.0**53)
    scored, at_once = 0, max(1, BOUNDS // max(1, len(anchors)))
    tree = None if huge else AnchorTree(anchors)
    for begin in range(0, len(candidates), at_once):
        c = candidates[begin : begin + at_once]
        if huge:
            for i in range(len(anchors)):
                found(i, np.arange(begin, begin + len(c)), products(anchors[i : i + 1], c, down)[0])
            scored += len(anchors) * len(c)
            continue
        norm = lengths(c)
        least, most = np.full((len(anchors), len(c)), -np.inf), np.full((len(anchors), len(c)), np.inf)
        for level, parents, edges in tree.levels:
            for cut in range(0, len(level), STEP):
                nodes, above = level[cut : cut + STEP], parents[cut : cut + STEP]
                root = np.isinf(edges[cut])
                if not root:
                    reach = edges[cut : cut + STEP, None] * norm * (1 + 1e-9) + 1e-6
                    least[nodes], most[nodes] = least[above] - reach, most[above] + reach
                need = (most[nodes] >= low[nodes, None]) & (least[nodes] <= high[nodes, None]) if not root else np.ones((1, len(c)), bool)
                if need.mean() > MANY:
                    least[nodes] = most[nodes] = anchors[nodes] @ c.T
                    scored += need.size
                else:
                    rows, columns = np.nonzero(need)
                    least[nodes[rows], columns] = most[nodes[rows], columns] = np.einsum("ij,ij->i", anchors[nodes[rows]], c[columns])
                    scored += len(rows)
                for r, node in enumerate(nodes.tolist()):
                    columns = np.flatnonzero(need[r])
                    found(node, begin + columns, least[node, columns])
    return scored


def _exact(score: int) -> tuple[int, str | None, str | None]:
    """The score clipped to 64 bits, a key that sorts, and the digits; both None within 64 bits."""
    big = order_key(score)
    return int(min(max(score, -(2**63)), 2**63 - 1)), big, None if big is None else str(score)


_SCORE = (pa.int64(), pa.string(), pa.string())


def positives_of(ids: np.ndarray, anchors: np.ndarray, beat: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, k: int, down: bool = False) -> list[list[tuple[int, int]]]:
    """Of each anchor its k best (-score, id) among rows of its label with other ids."""
    best: list[list[tuple[int, int]]] = [[] for _ in ids]
    low = beat.astype(float)

    def found(i: int, columns: np.ndarray, scores: np.ndarray) -> None:
        own = row_ids[columns] != ids[i]
        if scores.dtype != object:
            own &= scores >= low[i]
        best[i] = best_of(best[i], scores[own], row_ids[columns][own], k)
        if len(best[i]) == k and scores.dtype != object:
            low[i] = max(low[i], -best[i][-1][0])

    scan(anchors, rows, low, np.full(len(ids), np.inf), found, down)
    return best


def negatives_of(ids: np.ndarray, labels: list, anchors: np.ndarray, windows: list[list[tuple[int, int]]], row_ids: np.ndarray, row_labels: np.ndarray, rows: np.ndarray, k: int, down: bool = False) -> list[list[list[tuple[int, int]]]]:
    """Of each anchor and each of its windows (least, most) the k best (-score, id) of other labels within it."""
    best: list[list[list[tuple[int, int]]]] = [[[] for _ in w] for w in windows]
    edge = [[lo for lo, _ in w] for w in windows]
    as_float = lambda x: float(min(max(x, -(10**300)), 10**300))
    low = np.array([as_float(min(e, default=10**300)) for e in edge])
    high = np.array([as_float(max((hi for _, hi in w), default=-(10**300))) for w in windows])

    def found(i: int, columns: np.ndarray, scores: np.ndarray) -> None:
        other = row_labels[columns] != labels[i]
        other &= row_ids[columns] != ids[i]
        scores, at = scores[other], row_ids[columns[other]]
        for j, (_, most) in enumerate(windows[i]):
            some = ((scores >= edge[i][j]) & (scores <= most)).astype(bool)
            if some.any():
                best[i][j] = best_of(best[i][j], scores[some], at[some], k)
                if len(best[i][j]) == k:
                    edge[i][j] = max(edge[i][j], -best[i][j][-1][0])
        if edge[i]:
            low[i] = as_float(min(edge[i]))

    scan(anchors, rows, low, high, found, down)
    return best


def mine(data: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, percent: int = 80, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score: for each anchor and each of its best other
    rows of the same label the best rows of other labels that have at least percent % of the positive's score and at most all of it.

    Scores are inner products of floor(scale * x); ties go to the smaller id. Rows with a null id or label, or a vector that is null or
    holds null or non-finite components, take no part. A shorter vector counts as filled up with zeros. Rows that share an id never find
    each other; equal rows count once as an anchor, different ones with one id each give their own rows, and every row may be found.
    An anchor without rows of its label, or positives without negatives, give no rows; so do no rows. Scores are exact; one
    beyond 64 bits is reported as the nearest number of 64 bits. Other columns are not read.
    """
    spark = data.sparkSession
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        out, path = save(df)
        paths.append(path)
        return out

    rows = data.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull())
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    packed = keep(map_rows(rows, lambda: lambda i, a, t, v: [i, a, t, [pack(x, scale) for x in v]], "vec_id long, anchor boolean, label string, vec binary", None).where("vec IS NOT NULL"))
    tag = F.substring("vec", 1, 1)
    size = F.expr("(length(vec) - 1) div if(substring(vec, 1, 1) = X'68', 2, 8)")
    n, n_anchors, n_wide, n_huge, width = packed.agg(F.count(F.lit(1)), F.count_if("anchor"), F.count_if(tag != F.lit(b"h")), F.count_if(tag == F.lit(b"e")), F.max(size)).first()
    down, plain, width = n_huge > 0, not n_wide, width or 0
    slice_rows = min(MOST_ROWS, max(LEAST_ROWS, -(-n // SLICES)))

    by_hash = (F.xxhash64("vec_id"), "vec_id", "label", "vec")
    sample = packed.orderBy(*by_hash).limit(SAMPLE).collect()  # at most SAMPLE rows
    some = packed.where("anchor").orderBy(*by_hash).limit(SAMPLE).collect()  # at most SAMPLE rows
    near = unpack([r["vec"] for r in some], width, down)
    hubs = pivots_of(near, min(HUBS, max(1, n_anchors // ANCHORS))) if len(near) else near
    sent = spark.sparkContext.broadcast((hubs, unpack([r["vec"] for r in sample], width, down), np.array([r["vec_id"] for r in sample], np.int64), np.array([r["label"] for r in sample], object)))

    def placed():
        hubs, rows, row_ids, row_labels = sent.value

        def place(ids, labels, vecs):
            x = unpack(vecs, width, down)
            away = np.stack([lengths(x - h) for h in hubs], axis=1)
            beat = np.full(len(x), -np.inf)
            for t in set(labels) if plain else ():
                mine, theirs = np.array([u == t for u in labels]), row_labels == t
                if theirs.sum() > positives:
                    scores = x[mine] @ rows[theirs].T
                    scores[np.asarray(ids)[mine][:, None] == row_ids[theirs]] = -np.inf
                    beat[mine] = np.partition(scores, -positives, axis=1)[:, -positives]
            return [ids, labels, vecs, beat.tolist(), away.argmin(axis=1).tolist(), away.min(axis=1).tolist()]

        return place

    anchors = packed.where("anchor").select("vec_id", "label", "vec").distinct()
    anchors = keep(map_rows(anchors, placed, "vec_id long, label string, vec binary, beat double, hub int, away double", None).withColumn("akey", F.xxhash64("vec_id", "label", "vec")))

    counts = packed.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("m")).where("m > 0")
    counts = counts.select("label", F.ceil(F.col("m") / ANCHORS).alias("parts"), F.ceil(F.col("n") / slice_rows).alias("slices"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")).join(counts, ["label", "salt"])
    piece = lambda name, c, *by: F.pmod(F.xxhash64(F.lit(name), *by), c)
    held = salted(packed).select("label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), piece("slice", F.col("slices"), "vec_id").alias("slice"), "vec_id", "vec", F.lit(None).cast("long").alias("akey"), F.lit(None).cast("double").alias("beat"))
    asked = salted(anchors).select("label", piece("part", F.col("parts"), "akey").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), "vec_id", "vec", "akey", "beat")

    def split(t: pa.Table) -> tuple[pa.Table, pa.Table]:
        is_row = t.column("akey").is_null()
        return t.filter(pc.invert(is_row)), t.filter(is_row)

    def find_positives(t: pa.Table) -> pa.Table:
        a, c = split(t)
        ids, beat = a.column("vec_id").to_numpy(), a.column("beat").to_numpy()
        best = positives_of(ids, unpack(a.column("vec").to_pylist(), width, down), beat, c.column("vec_id").to_numpy(), unpack(c.column("vec").to_pylist(), width, down), positives, down)
        out = [(i, k, p, *_exact(-s)) for i, k, b in zip(ids.tolist(), a.column("akey").to_pylist(), best, strict=True) for s, p in b]
        kinds = (pa.int64(), pa.int64(), pa.int64(), *_SCORE)
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["anchor_id", "akey", "id", "score", "big", "exact"])

    def ranked(df: DataFrame, k: int, *key: str) -> DataFrame:
        order = W.partitionBy("anchor_id", "akey", *key).orderBy(F.desc("score"), F.desc("big"), "id")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    schema = "anchor_id long, akey long, id long, score long, big string, exact string"
    found = ranked(held.unionByName(asked).groupBy("label", "part", "slice").applyInArrow(find_positives, schema), positives)
    found = found.groupBy("anchor_id", "akey").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score", "exact"))).alias("found"))  # few
    wanting = keep(anchors.join(found.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "akey"]).drop("beat"))

    window = F.col("w.score").cast("double") * percent / 100.0
    of_hub = wanting.select("hub", "akey", "vec_id", "away", F.explode("found").alias("w")).groupBy("hub").agg(F.count_distinct("vec_id", "akey").alias("m"), F.max("away").alias("away"), F.min(window).alias("low"), F.max("w.score").alias("high"))
    of_hub = {r["hub"]: r for r in of_hub.collect()}  # at most HUBS rows
    parts = [-(-of_hub[h]["m"] // ANCHORS) if h in of_hub else 0 for h in range(len(hubs))]

    def routed():
        hubs = sent.value[0]
        known = [h for h, p in enumerate(parts) if p]
        away, low, high = (np.array([float(of_hub[h][c]) for h in known]) for c in ("away", "low", "high"))

        def route(ids, labels, vecs):
            x = unpack(vecs, width, down)
            if plain:
                scores, reach = x @ hubs[known].T, lengths(x)[:, None] * away * (1 + 1e-9) + 1e-6
                meets = (scores + reach >= low - 1) & (scores - reach <= high)
            else:
                meets = np.ones((len(x), len(known)), bool)
            r, h = np.nonzero(meets)
            return [[ids[i] for i in r], [labels[i] for i in r], [vecs[i] for i in r], [known[i] for i in h]]

        return route

    split_of = F.element_at(F.array(*(F.lit(max(1, p)).cast("long") for p in parts)), F.col("hub") + 1) if parts else F.lit(1).cast("long")
    slices = F.lit(max(1, -(-n // slice_rows))).cast("long")
    no = {"akey": "long", "found": wanting.schema["found"].dataType}
    held = map_rows(packed.select("vec_id", "label", "vec"), routed, "vec_id long, label string, vec binary, hub int", None)
    held = held.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), split_of - 1)).alias("part"), piece("slice", slices, "vec_id").alias("slice"), "vec_id", "label", "vec", *(F.lit(None).cast(t).alias(c) for c, t in no.items()))
    asked = wanting.select("hub", piece("part", split_of, "akey").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("slice"), "vec_id", "label", "vec", *no)

    def find_negatives(t: pa.Table) -> pa.Table:
        a, c = split(t)
        ids, each = a.column("vec_id").to_numpy(), a.column("found").to_pylist()
        score = lambda w: int(w["exact"]) if w["exact"] else w["score"]
        windows = [[(-(-percent * score(w) // 100), score(w)) for w in f] for f in each]
        best = negatives_of(ids, a.column("label").to_pylist(), unpack(a.column("vec").to_pylist(), width, down), windows, c.column("vec_id").to_numpy(), np.array(c.column("label").to_pylist(), object), unpack(c.column("vec").to_pylist(), width, down), negatives, down)
        out = [
            (i, k, w["rank"], w["id"], w["score"], x, *_exact(-s))
            for i, k, f, b in zip(ids.tolist(), a.column("akey").to_pylist(), each, best, strict=True)
            for w, list_ in zip(f, b, strict=True)
            for s, x in list_
        ]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *_SCORE)
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["anchor_id", "akey", "nth", "positive_id", "positive_score", "id", "score", "big", "exact"])

    schema = "anchor_id long, akey long, nth int, positive_id long, positive_score long, id long, score long, big string, exact string"
    found = ranked(held.unionByName(asked).groupBy("hub", "part", "slice").applyInArrow(find_negatives, schema), negatives, "nth")
    out, _ = save(found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    for path in paths:
        discard(spark, path)
    return out


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
             s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT * FROM n WHERE rank <= 5
"""
