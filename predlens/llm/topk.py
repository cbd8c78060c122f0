"""Exact top-k search by inner product with dual-tree traversal of cover trees.

Vectors are dealt to cells by the nearest of a few pivots, and large cells to blocks by hash. By a cell's centre and radius the
best product of a query there is bounded, and a sample of the data gives each query a kth score to beat. A query goes to its most
promising blocks first; what they hold raises its kth score, and only then it goes to the other blocks that could still hold a
better row. A block's rows come once, its queries are streamed past them. In a block, queries and data are both indexed by cover
trees, and pairs of nodes are pruned when their centres and covering radii bound all products below the worst kth score of the
query node. The blocks' results meet in one ranking.

Scores are exact integers at any size. A score beyond 64 bits is reported as the nearest 64-bit integer, but ranked by its own
value.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, map_rows, save

#: Rows of the sample that pivots and first scores are taken from; most pivots; least and most rows of a block; queries that
#: meet a block at once, and queries from which on a block is held once more, for another task; the part of all blocks that a query
#: sees first.
SAMPLE, PIVOTS, LEAST_ROWS, MOST_ROWS, QUERIES, MOST_QUERIES, FIRST = 2048, 256, 512, 8192, 4096, 65536, 8
#: Components from 2**400 on are stored divided by 2**600, so that doubles bound products of any finite ones.
LARGE, DOWN = 2.0**400, 600
#: Points of a leaf, most children of a node, and by how much a child's covering radius is smaller.
LEAF, FANOUT, SHRINK = 128, 8, 1.4


def pack(vector: list | None, scale: float) -> bytes | None:
    """floor(scale * x) of each component, as int16 or doubles, or scaled down where one is huge; None for a vector that takes no part."""
    if vector is None or any(x is None for x in vector):
        return None
    x = np.asarray(vector, np.float64)
    if not np.isfinite(x).all():
        return None
    with np.errstate(over="ignore"):
        v = np.floor(x * scale)
    top = np.abs(v).max(initial=0)
    if top < 32768:
        return b"h" + v.astype("<i2").tobytes()
    if top < LARGE:
        return b"d" + v.astype("<f8").tobytes()
    down = [np.ldexp(f, -DOWN) if np.isfinite(f) else float(Fraction(float(c)) * Fraction(scale) / 2**DOWN) for f, c in zip(v, x, strict=True)]
    return b"e" + np.asarray(down, "<f8").tobytes()


def unpack(rows: list[bytes], width: int = 0, down: bool = False) -> np.ndarray:
    """Rows of equal length; shorter ones are filled up with zeros, which add nothing to a product. down: all of them scaled down."""
    each = [np.frombuffer(r, "<i2" if r[:1] == b"h" else "<f8", offset=1) for r in rows]
    out = np.zeros((len(each), max([width, *(len(v) for v in each)])))
    for row, v, r in zip(out, each, rows, strict=True):
        row[: len(v)] = np.ldexp(v.astype(float), -DOWN) if down and r[:1] != b"e" else v
    return out


def products(a: np.ndarray, b: np.ndarray, down: bool = False) -> np.ndarray:
    """Exact inner products: doubles hold the sums while they are below 2**53, beyond that Python's integers do."""
    if not a.size or not b.size or (not down and np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53):
        return a @ b.T
    whole = lambda m: np.array([[int(Fraction(x) * 2**DOWN) if down else int(x) for x in row] for row in m.tolist()], object)
    return whole(a) @ whole(b).T


def as_bound(score: int, down: bool) -> float:
    """A double that is not above an exact score, in the unit of the tree's products."""
    shift = max(0, abs(score).bit_length() - 900)
    value = np.ldexp(float(score >> shift), shift - 2 * DOWN * down)
    return float(value - abs(value) * 1e-12) if down or abs(value) >= 2**53 else float(value)


def order_key(score: int) -> str | None:
    """None within 64 bits, else a text that sorts like the score among those of its sign."""
    if -(2**63) <= score < 2**63:
        return None
    digits = f"{abs(score):d}"
    key = f"{len(digits):05d}{digits}"
    return key if score > 0 else "".join(chr(105 - ord(c)) for c in key) + "~"


def lengths(rows: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows; squares neither overflow nor vanish."""
    top = np.abs(rows).max(axis=1, initial=0)
    some = top[top > 0]
    if not len(some) or (some.max() < 1e150 and some.min() > 1e-150):
        return np.sqrt((rows**2).sum(axis=1))
    return top * np.sqrt(((rows / np.where(top > 0, top, 1)[:, None]) ** 2).sum(axis=1))


class CoverTree:
    """Nodes as arrays: begin and end of a node's points in order, centre, covering radius, children.

    A node's children are chosen farthest first until all its points are within its radius / SHRINK of one, at most FANOUT;
    radii are measured, so bounds hold however the points lie.
    """

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.begin, self.end, self.centre, self.radius, self.children = [], [], [], [], []
        waiting = [(0, len(points), 0, -1)]
        while waiting:
            begin, end, centre, parent = waiting.pop()
            at = self.order[begin:end]
            away = lengths(points[at] - points[centre])
            node = len(self.begin)
            for store, value in zip((self.begin, self.end, self.centre, self.radius, self.children), (begin, end, centre, away.max(initial=0.0), []), strict=True):
                store.append(value)
            if parent >= 0:
                self.children[parent].append(node)
            if end - begin <= LEAF or not self.radius[node]:
                continue
            centres, nearest, owner = [centre], away, np.zeros(len(at), int)
            while len(centres) < FANOUT and (far := int(nearest.argmax()), nearest[far] > self.radius[node] / SHRINK)[1]:
                away = lengths(points[at] - points[at[far]])
                owner[away < nearest] = len(centres)
                nearest = np.minimum(nearest, away)
                centres.append(int(at[far]))
            by = np.argsort(owner, kind="stable")
            self.order[begin:end] = at[by]
            ends = np.cumsum(np.bincount(owner, minlength=len(centres)))
            for i, c in enumerate(centres):
                low = begin + (ends[i - 1] if i else 0)
                if begin + ends[i] > low:
                    waiting.append((int(low), int(begin + ends[i]), c, node))
        self.points = points[self.order]
        self.centres = points[np.array(self.centre, int)] if self.centre else points[:0]
        self.norms = lengths(self.centres)
        self.radius = np.array(self.radius)


def search_block(queries: np.ndarray, query_ids: list[int], beat: np.ndarray, data: np.ndarray, data_ids: list[int], k: int, down: bool = False) -> list[tuple[int, int, int]]:
    """(query id, data id, score): of each query its k best in the block that are not below its score to beat, and ties.

    Equal data vectors are one point of the tree with its k + 1 smallest ids, of which a query needs no more.
    """
    points, same = np.unique(data, axis=0, return_inverse=True)
    ids: list[list[int]] = [[] for _ in points]
    for i, p in sorted(zip(data_ids, same.ravel().tolist(), strict=True)):
        if len(ids[p]) <= k:
            ids[p].append(i)
    q, d = CoverTree(queries), CoverTree(points)
    ids = [ids[i] for i in d.order]
    own = [query_ids[i] for i in q.order]
    worst = beat[q.order].astype(float)
    best: list[list[tuple[int, int]]] = [[] for _ in own]

    def bounds(a: list[int], b: list[int]) -> np.ndarray:
        """Of the products of query nodes with data nodes, with room for rounding."""
        r = d.radius[b]
        top = q.centres[a] @ d.centres[b].T + q.norms[a, None] * r + q.radius[a, None] * (d.norms[b] + r)
        return top + 1e-9 * (q.norms[a, None] + q.radius[a, None]) * (d.norms[b] + r) + (0.0 if down else 1e-6)

    waiting = [(0, 0, np.inf)] if own and len(points) else []
    while waiting:
        a, b, top = waiting.pop()
        if top < worst[q.begin[a] : q.end[a]].min():
            continue
        if q.children[a] or d.children[b]:  # all pairs of children at once, the most promising ones last, so they are next
            below, across = q.children[a] or [a], d.children[b] or [b]
            found = bounds(below, across)
            low = np.array([worst[q.begin[c] : q.end[c]].min() for c in below])
            rows, columns = np.nonzero(found >= low[:, None])
            tops = found[rows, columns]
            waiting += [(below[rows[i]], across[columns[i]], float(tops[i])) for i in np.argsort(tops, kind="stable").tolist()]
            continue
        low, high = q.begin[a], d.begin[b]
        scores = products(q.points[low : q.end[a]], d.points[high : d.end[b]], down)
        tops = np.array([[as_bound(x, down) for x in row] for row in scores.tolist()]) if scores.dtype == object else scores
        for i in np.flatnonzero((tops >= worst[low : q.end[a], None]).any(axis=1)).tolist():
            row, n = scores[i], low + i
            new = [(-int(row[j]), x) for j in np.flatnonzero(tops[i] >= worst[n]).tolist() for x in ids[high + j] if x != own[n]]
            best[n] = sorted(best[n] + new)[:k]
            if len(best[n]) == k:
                worst[n] = max(worst[n], as_bound(-best[n][-1][0], down) if scores.dtype == object else -best[n][-1][0])
    return [(query, x, -s) for query, found in zip(own, best, strict=True) for s, x in found]


def pivots_of(sample: np.ndarray, n: int) -> np.ndarray:
    """At most n points of the sample, farthest first."""
    chosen = [0]
    away = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < n and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def search(data: DataFrame, is_query, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that is_query holds for, the k best other rows by inner product of
    the scaled integer vectors, ties to the smaller id; all of them if they are fewer.

    Rows with a null id, or a vector that is null or holds null or non-finite components, take no part. A shorter vector
    counts as filled up with zeros. Rows that share an id never find each other; of repeated rows each may be found. Other
    columns are not read; no rows give no rows.
    """
    spark = data.sparkSession
    rows = data.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("query"), F.col(vector).alias("v"))
    packed = map_rows(rows, lambda: lambda i, q, v: [i, q, [pack(x, scale) for x in v]], "vec_id long, query boolean, vec binary", None)
    packed, packed_path = save(packed.where("vec IS NOT NULL"))
    huge = F.count_if(F.substring("vec", 1, 1) == F.lit(b"e"))
    n, n_huge = packed.agg(F.count(F.lit(1)), huge).first()
    down = n_huge > 0
    sample = packed.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(SAMPLE).collect()  # at most SAMPLE rows
    block = min(MOST_ROWS, max(LEAST_ROWS, -(-n // 24)))
    vectors = unpack([r["vec"] for r in sample], 0, down)
    pivots = pivots_of(vectors, min(PIVOTS, max(1, n // (2 * block)))) if sample else vectors
    sent = spark.sparkContext.broadcast((pivots, vectors, np.array([r["vec_id"] for r in sample])))

    def cells():
        pivots = sent.value[0]

        def rows(ids, query, vec):
            x = unpack(vec, pivots.shape[1], down)
            p = np.pad(pivots, ((0, 0), (0, x.shape[1] - pivots.shape[1])))
            cell = ((p**2).sum(axis=1) - 2 * (x @ p.T)).argmin(axis=1)  # the nearest, but for rounding
            return [ids, query, vec, cell.tolist(), lengths(x - p[cell]).tolist()]

        return rows

    dealt, dealt_path = save(map_rows(packed, cells, "vec_id long, query boolean, vec binary, cell int, away double", None))
    found = {r["cell"]: r for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect()}  # at most PIVOTS rows
    parts = [-(-found[c]["n"] // block) if c in found else 0 for c in range(len(pivots))]
    slack = 1e-6 if not down else 0.0
    radius = np.array([found[c]["r"] * (1 + 1e-6) + slack if c in found else 0.0 for c in range(len(pivots))])
    cell_of = np.repeat(np.arange(len(parts)), parts)
    part_of = np.concatenate([np.arange(p) for p in parts]) if parts else cell_of
    first = max(1, len(cell_of) // FIRST)

    def route(again: bool):
        """The blocks of each query: its first ones, or the others that can hold a score which is not below its kth."""

        def make():
            pivots, vectors, ids = sent.value

            def rows(query_ids, vec, *kth):
                x = unpack(vec, pivots.shape[1], down)
                fill = lambda m: np.pad(m, ((0, 0), (0, x.shape[1] - m.shape[1])))
                if again:
                    beat = np.array([-np.inf if t is None else t for t in kth[0]])
                else:
                    scores = x @ fill(vectors).T
                    scores -= 1e-9 * lengths(x)[:, None] * lengths(vectors)
                    scores[np.asarray(query_ids)[:, None] == ids] = -np.inf
                    beat = -np.partition(-scores, k - 1, axis=1)[:, k - 1] if scores.shape[1] >= k else np.full(len(x), -np.inf)
                most = x @ fill(pivots).T + lengths(x)[:, None] * radius
                most = (most + 1e-9 * lengths(x)[:, None] * (lengths(fill(pivots)) + radius) + slack)[:, cell_of]
                rank = np.argsort(np.argsort(-most, axis=1, kind="stable"), axis=1)
                wanted = (rank >= first) & (most >= beat[:, None]) if again else rank < first
                q, b = np.nonzero(wanted)
                return [[query_ids[i] for i in q], [vec[i] for i in q], beat[q].tolist(), cell_of[b].tolist(), part_of[b].tolist()]

            return rows

        return make

    asked_schema = "query_id long, vec binary, beat double, cell int, part int"
    queries = dealt.where("query").select("vec_id", "vec")
    split = F.element_at(F.array(*(F.lit(max(1, p)) for p in parts)), F.col("cell") + 1) if parts else F.lit(1)
    held = dealt.select("vec_id", "vec", "cell", F.pmod(F.xxhash64("vec_id", F.lit("part")), split).cast("int").alias("part"))
    width = pivots.shape[1]

    def meet(asked: DataFrame) -> DataFrame:
        """Results (query_id, vec_id, score, big, kth) of queries in their blocks. A block that very many queries ask for is held for
        each MOST_QUERIES of them once, so held rows are never more than an eighth of the queries sent."""
        count = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most PIVOTS rows
        turns = F.element_at(F.array(*(F.lit(max(1, -(-count.get(c, 0) // max(1, MOST_QUERIES * p)))) for c, p in enumerate(parts))), F.col("cell") + 1) if parts else F.lit(1)
        key = ["cell", "part", "turn"]
        left = held.withColumn("turn", F.explode(F.sequence(F.lit(0), turns - 1))).select(*key, F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "vec", F.lit(None).cast("double").alias("beat"))
        right = asked.withColumn("turn", F.pmod(F.xxhash64("query_id"), turns).cast("int")).select(*key, F.lit(1).alias("kind"), F.col("query_id").alias("id"), "vec", "beat")
        n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        both = left.unionByName(right).repartition(n_parts, *key).sortWithinPartitions(*key, "kind")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held_ids, held_vecs = None, [], []

            def answer(ids: list[int], vecs: list[bytes], beat: list[float]) -> pa.RecordBatch:
                rows = unpack([*vecs, *held_vecs], width, down)
                m = len(ids)
                out = search_block(rows[:m], ids, np.array(beat), rows[m:], held_ids, k, down) if held_ids else []
                score = [s for _, _, s in out]
                clipped = [int(min(max(s, -(2**63)), 2**63 - 1)) for s in score]
                columns = [[q for q, _, _ in out], [x for _, x, _ in out], clipped, [order_key(int(s)) for s in score], [as_bound(int(s), down) for s in score]]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()), strict=True)], ["query_id", "vec_id", "score", "big", "kth"])

            for batch in batches:
                cell, part, turn, kind, ids, vecs, beat = (c.to_pylist() for c in batch.columns)
                groups = np.array(list(zip(cell, part, turn, kind, strict=True)), np.int64).reshape(-1, 4)
                cuts = [0, *(np.flatnonzero((groups[1:] != groups[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
                for low, high in zip(cuts, cuts[1:], strict=False):
                    if low == high:
                        continue
                    block = tuple(groups[low, :3])
                    if block != now:
                        now, held_ids, held_vecs = block, [], []
                    if groups[low, 3] == 0:
                        held_ids += ids[low:high]
                        held_vecs += vecs[low:high]
                        continue
                    for at in range(low, high, QUERIES):
                        to = min(high, at + QUERIES)
                        yield answer(ids[at:to], vecs[at:to], beat[at:to])

        return both.mapInArrow(run, "query_id long, vec_id long, score long, big string, kth double")

    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("big"), "vec_id")

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    asked, asked_path = save(map_rows(queries, route(False), asked_schema, None))
    some, some_path = save(best(meet(asked)))
    kth = some.groupBy("query_id").agg(F.max(F.struct("rank", "kth")).alias("x")).where(F.col("x.rank") == k).select("query_id", F.col("x.kth").alias("beat"))
    # queries that share an id are ranked together, so the kth score of all of them bounds each
    rest = queries.join(kth, queries["vec_id"] == kth["query_id"], "left").select("vec_id", "vec", "beat")
    asked2, asked2_path = save(map_rows(rest, route(True), asked_schema, None))
    more = some.drop("rank").unionByName(meet(asked2))
    out, _ = save(best(more).select("query_id", "rank", "vec_id", "score"))
    for path in (packed_path, dealt_path, asked_path, some_path, asked2_path):
        discard(spark, path)
    return out


ORACLE = """
WITH v AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
