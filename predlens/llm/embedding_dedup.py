"""Near-duplicate embeddings by an epsilon grid order join.

Vectors are scaled to length one, so a cosine is a distance, and projected on the leading principal dimensions of a bounded sample.
They are sorted by their cells of a grid on the first of these, whose width is the distance that still links, and then by finer
cells; the sorted sequence is cut into groups of equal size. A join of two intervals of the sequence, a group or more of them, is

* skipped if their boxes or balls are provably farther apart than the distance that links,
* answered at once if all their pairs are provably nearer: each vector has all of the other interval as links,
* else done by its parts. Down to groups that is a join of the table of intervals with itself, level by level; a pair of groups is
  then one task, which goes on by halves. Pairs of the smallest intervals are bounded by the product of the leading dimensions plus
  that of what is left of their lengths, and what this bound leaves is computed in full.

A crowd of copies fills intervals that are provably near, so its pairs are counted but never made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, save
from .components import components, contract

#: Rows of the sample; dimensions of the grid; leading dimensions of boxes and bounds; finer cells of a cell.
SAMPLE, GRID, HEAD, FINER = 2048, 8, 16, 8
#: Groups that the sequence is cut into at least, if they have LEAST_ROWS; most bytes of a group as doubles; intervals of an interval.
GROUPS, LEAST_ROWS, MOST_BYTES, FAN = 12, 1024, 4_000_000, 32
#: Rows of the smallest intervals; links that a task contracts at once.
LEAF, LINKS = 256, 500_000
#: Room for rounding of bounds; a cosine that is nearer to the limit is computed from the vectors as they are.
SLACK, NEAR = 1e-9, 1e-12


def units(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as doubles, shorter ones filled up with zeros, and the same of length one."""
    x = np.zeros((len(rows), width))
    for row, r in zip(x, rows, strict=True):
        v = np.frombuffer(r, "<f4" if r[:1] == b"f" else "<f8", offset=1)
        row[: len(v)] = v
    u = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-320)
    return x, u / np.sqrt((u**2).sum(axis=1, keepdims=True))


def pack(vector: list | None) -> bytes | None:
    """None for a vector that links with nothing: null, zero, or with a null or non-finite component."""
    if vector is None or any(c is None for c in vector):
        return None
    x = np.asarray(vector, np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    with np.errstate(over="ignore"):
        small = x.astype("<f4")
    return b"f" + small.tobytes() if (small == x).all() else b"d" + x.astype("<f8").tobytes()


def basis_of(sample: np.ndarray) -> np.ndarray:
    """The leading principal dimensions as columns."""
    away = sample - sample.mean(axis=0) if len(sample) else sample
    _, q = np.linalg.eigh(away.T @ away)
    return q[:, ::-1][:, :HEAD]


def grid_key(head: np.ndarray, reach: float) -> list[bytes]:
    """Cells of the first dimensions, and then their finer cells, as bytes that sort like the numbers."""
    at = (np.clip(head[:, :GRID], -1, 1) + 1) / max(reach, 0.05)
    cell = np.floor(at)
    finer = np.minimum(np.floor((at - cell) * FINER), FINER - 1)
    return [r.tobytes() for r in np.hstack([cell, finer]).astype(np.uint8)]


def interval(u: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Box of the leading dimensions, centre and radius."""
    centre = u.mean(axis=0)
    return head.min(axis=0), head.max(axis=0), centre, float(np.sqrt(((u - centre) ** 2).sum(axis=1)).max())


class Sequence:
    """Rows of a group in order, and its intervals by halves: begin, end, children, box, centre, radius."""

    def __init__(self, ids: np.ndarray, pos: np.ndarray, vecs: list[bytes], basis: np.ndarray):
        self.ids, self.pos = ids, pos
        self.x, self.u = units(vecs, len(basis))
        head = self.u @ basis
        self.bound = np.hstack([head, np.sqrt(np.maximum(0, 1 - (head**2).sum(axis=1, keepdims=True)))])
        self.parts: list[tuple[int, int, tuple, tuple]] = []
        self._cut(0, len(ids), head)

    def _cut(self, low: int, high: int, head: np.ndarray) -> int:
        at, half = len(self.parts), (low + high) // 2
        self.parts.append(())
        below = (self._cut(low, half, head), self._cut(half, high, head)) if high - low > LEAF else ()
        self.parts[at] = (low, high, below, interval(self.u[low:high], head[low:high]))
        return at


class Join:
    """Links of two sequences, or of one with itself: their number for each row, and edges that join the same components."""

    def __init__(self, a: Sequence, b: Sequence, least: float):
        self.a, self.b, self.least = a, b, least
        self.n = (np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64))
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.compared = 0, 0
        reach = np.sqrt(2 - 2 * least)
        waiting = [(0, 0)]
        while waiting:
            i, j = waiting.pop()
            low, high, below, (lo, hi, centre, radius) = a.parts[i]
            low2, high2, below2, (lo2, hi2, centre2, radius2) = b.parts[j]
            own = a is b and i == j
            gap = np.maximum(0, np.maximum(lo - hi2, lo2 - hi))
            apart = 0.0 if own else float(np.sqrt(((centre - centre2) ** 2).sum()))
            if (gap**2).sum() > reach**2 + SLACK or apart - radius - radius2 > reach + SLACK:
                continue
            if (2 * radius if own else apart + radius + radius2) < reach - SLACK:
                self._all(low, high, low2, high2, own)
            elif below and (not below2 or high - low >= high2 - low2):
                waiting += [(k, m) for k in below for m in below if k <= m] if own else [(k, j) for k in below]
            elif below2:
                waiting += [(i, k) for k in below2]
            else:
                self._leaf(low, high, low2, high2, own)

    def _link(self, u: np.ndarray, v: np.ndarray) -> None:
        self.edges.append((u, v))
        self.held += len(u)
        if self.held > LINKS:
            self.edges = [contract(*(np.concatenate(x) for x in zip(*self.edges, strict=True)))]
            self.held = len(self.edges[0][0])

    def _all(self, low: int, high: int, low2: int, high2: int, own: bool) -> None:
        self.n[0][low:high] += high2 - low2 - own
        if not own:
            (self.n[0] if self.a is self.b else self.n[1])[low2:high2] += high - low
            self._link(self.b.ids[low2:high2], np.full(high2 - low2, self.a.ids[low]))
        self._link(self.a.ids[low:high], np.full(high - low, self.b.ids[low2]))

    def _leaf(self, low: int, high: int, low2: int, high2: int, own: bool) -> None:
        a, b = self.a, self.b
        can = a.bound[low:high] @ b.bound[low2:high2].T >= self.least - SLACK
        if own:
            can = np.triu(can, 1)
        i, j = np.nonzero(can)
        self.compared += len(i)
        if len(i) * 8 > can.size:
            cosine = (a.u[low:high] @ b.u[low2:high2].T)[i, j]
        else:
            cosine = np.einsum("ij,ij->i", a.u[low + i], b.u[low2 + j])
        for k in np.flatnonzero(np.abs(cosine - self.least) < NEAR):
            x, y = a.x[low + i[k]], b.x[low2 + j[k]]
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                exact = (x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y))
            cosine[k] = exact if np.isfinite(exact) else cosine[k]
        linked = cosine >= self.least
        i, j = low + i[linked], low2 + j[linked]
        self.n[0][:] += np.bincount(i, minlength=len(self.n[0]))
        (self.n[0] if a is b else self.n[1])[:] += np.bincount(j, minlength=len(self.n[0] if a is b else self.n[1]))
        if len(i):
            self._link(a.ids[i], b.ids[j])

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for s, n in ((self.a, self.n[0]), *([(self.b, self.n[1])] if self.a is not self.b else [])):
            yield 0, s.pos[n > 0], n[n > 0]
        if self.edges:
            yield 1, *contract(*(np.concatenate(x) for x in zip(*self.edges, strict=True)))


_NODE = "id long, n long, least long, lo array<double>, hi array<double>, centre array<double>, radius double"


def _merged(rows: pd.DataFrame) -> list:
    """n, least id, box and ball of what several intervals hold."""
    n, centres = rows["n"].to_numpy(), np.stack(rows["centre"])
    centre = (centres * n[:, None]).sum(axis=0) / n.sum()
    radius = (np.sqrt(((centres - centre) ** 2).sum(axis=1)) + rows["radius"].to_numpy()).max()
    return [int(n.sum()), int(rows["least"].min()), np.stack(rows["lo"]).min(axis=0), np.stack(rows["hi"]).max(axis=0), centre, float(radius)]


def _grown(nodes: DataFrame) -> DataFrame:
    """Rows of one id merged; an id has at most FAN rows, or those of a group's parts."""

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[key[0], *_merged(rows)]], columns=["id", "n", "least", "lo", "hi", "centre", "radius"])

    return nodes.groupBy("id").applyInPandas(merge, _NODE)


def near_pairs(levels: list[DataFrame], reach: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """Pairs (a, b) of groups that need a comparison, and answered pairs of intervals (level, a, b, n and least of both); a <= b."""
    far, near = (f"{x:.17g}D" for x in (reach**2 + SLACK, reach - SLACK))
    gap = "aggregate(zip_with(zip_with(a.lo, b.hi, (x, y) -> x - y), zip_with(b.lo, a.hi, (x, y) -> x - y), (x, y) -> pow(greatest(x, y, 0D), 2)), 0D, (s, x) -> s + x)"
    apart = "sqrt(aggregate(zip_with(a.centre, b.centre, (x, y) -> pow(x - y, 2)), 0D, (s, x) -> s + x))"
    spark, paths, answered = levels[0].sparkSession, [], None
    pairs = spark.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for level in range(len(levels) - 1, -1, -1):
        nodes = levels[level].withColumn("parent", F.floor(F.col("id") / FAN))
        some = pairs.select(F.col("a").alias("pa"), F.col("b").alias("pb"))
        both = some.join(nodes.alias("a"), F.col("pa") == F.col("a.parent")).join(nodes.alias("b"), (F.col("pb") == F.col("b.parent")) & (F.col("a.id") <= F.col("b.id")))
        same = F.expr("a.id = b.id")
        both = both.withColumn("gap", F.when(same, F.lit(0.0)).otherwise(F.expr(gap))).withColumn("apart", F.when(same, F.lit(0.0)).otherwise(F.expr(apart)))
        both = both.where(f"gap <= {far} AND apart - a.radius - b.radius <= {reach + SLACK:.17g}D")
        tested, path = save(both.selectExpr(f"{level} AS level", "a.id AS a", "b.id AS b", "a.n AS na", "b.n AS nb", "a.least AS ua", "b.least AS ub", f"apart + a.radius + b.radius < {near} AS done"))
        paths.append(path)
        answered = tested.where("done") if answered is None else answered.unionByName(tested.where("done"))
        pairs = tested.where("NOT done").select("a", "b")
    return pairs, answered, paths


def link(data: DataFrame, least: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding", most_rows: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: other vectors whose cosine with it is at least so high, the smallest id that
    such links reach, its own included, and whether that is its own.

    A vector that is null or zero, or holds null or non-finite components, links with nothing. A shorter vector counts as filled up
    with zeros. Rows that share an id are vectors of their own, and of one component only if links join them; equal vectors link. A row
    with a null id is kept and links with nothing. least lies above 0 and below 1. Other columns are not read; no rows give no rows.
    most_rows: rows of a group, for tests.
    """
    spark = data.sparkSession
    reach = float(np.sqrt(2 - 2 * least))
    rows = data.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(v) for v in batch.column(1).to_pylist()], pa.binary())], ["vec_id", "vec"])

    every, every_path = save(rows.mapInArrow(packed, "vec_id long, vec binary"))
    taking = every.where("vec IS NOT NULL AND vec_id IS NOT NULL")
    n, width = taking.agg(F.count(F.lit(1)), F.max(F.expr("(length(vec) - 1) div if(substring(vec, 1, 1) = X'66', 4, 8)"))).first()
    alone = every.where("vec IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not n:
        return alone.withColumn("kept", F.lit(True))
    sample = taking.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(SAMPLE).collect()  # at most SAMPLE rows
    sent = spark.sparkContext.broadcast(basis_of(units([bytes(r["vec"]) for r in sample], width)[1]))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(grid_key(units(vecs, width)[1] @ sent.value, reach), pa.binary())], ["vec_id", "vec", "key"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, part, np.int32)), pa.array(np.arange(at, at + m)), batch.column(0), batch.column(1)], ["part", "at", "vec_id", "vec"])
            at += m

    # equal cells are cut by id, so a crowd is no partition of its own
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = taking.mapInArrow(keyed, "vec_id long, vec binary, key binary").repartitionByRange(n_parts, "key", "vec_id").sortWithinPartitions("key", "vec_id", "vec")
    placed, placed_path = save(order.mapInArrow(numbered, "part int, at long, vec_id long, vec binary"))
    sizes = dict(placed.groupBy("part").count().collect())  # a row for each partition
    begin, begins = 0, []
    for p in sorted(sizes):
        begins.append((p, begin))
        begin += sizes[p]
    group_rows = most_rows or int(min(max(LEAF, MOST_BYTES // (8 * width)), max(LEAST_ROWS, -(-n // GROUPS))))
    begins = F.broadcast(spark.createDataFrame(begins, "part int, begin long"))
    placed = placed.join(begins, "part").select((F.col("begin") + F.col("at")).alias("pos"), "vec_id", "vec").withColumn("group", F.floor(F.col("pos") / group_rows))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            u = units(batch.column(2).to_pylist(), width)[1]
            head, out = u @ sent.value, []
            for g in np.unique(group):
                own = group == g
                out.append([int(g), int(own.sum()), int(ids[own].min()), *(x.tolist() if isinstance(x, np.ndarray) else x for x in interval(u[own], head[own]))])
            kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 3, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "n", "least", "lo", "hi", "centre", "radius"])

    paths = [every_path, placed_path]
    levels, n_nodes = [], -(-n // group_rows)
    below = placed.select("group", "vec_id", "vec").mapInArrow(summed, _NODE)
    while True:
        nodes, path = save(_grown(below))
        levels.append(nodes)
        paths.append(path)
        if n_nodes <= FAN:
            break
        below, n_nodes = nodes.withColumn("id", F.floor(F.col("id") / FAN)), -(-n_nodes // FAN)
    pairs, answered, pair_paths = near_pairs(levels, reach)
    paths += pair_paths

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("pos", "ascending")])
        at, sides = rows.column("group").to_numpy(), []
        for g in sorted({key[0].as_py(), key[1].as_py()}):
            own = rows.filter(pa.array(at == g))
            sides.append(Sequence(own.column("vec_id").to_numpy(), own.column("pos").to_numpy(), own.column("vec").to_pylist(), sent.value))
        found = [(np.full(len(u), kind, np.int32), u, v) for kind, u, v in Join(sides[0], sides[-1], least).rows()]
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] or [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        return pa.table({k: pa.array(c) for k, c in zip(("kind", "u", "v"), columns, strict=True)})

    asked = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("group"))
    found, found_path = save(placed.join(asked, "group").groupBy("a", "b").applyInArrow(meet, "kind int, u long, v long"))
    paths.append(found_path)
    # answered pairs: what each interval has in all, dealt down to its groups; its rows are of one component with its least one
    side = answered.selectExpr("level", "a AS id", "if(a = b, nb - 1, nb) AS add", "ua AS root").unionByName(answered.where("a <> b").selectExpr("level", "b AS id", "na AS add", "ub AS root"))
    whole = side.groupBy("level", "id").agg(F.sum("add").alias("add"), F.min("root").alias("root"))
    span = F.pow(F.lit(float(FAN)), F.col("level")).cast("long")
    whole = whole.withColumn("group", F.explode(F.sequence(F.col("id") * span, (F.col("id") + 1) * span - 1)))
    of_group = whole.groupBy("group").agg(F.sum("add").alias("add"), F.collect_set("root").alias("roots"))  # at most one root a level
    in_whole = placed.join(of_group, "group")
    edges = found.where("kind = 1").select("u", "v").unionByName(answered.where("ua <> ub").selectExpr("ua AS u", "ub AS v"))
    edges = edges.unionByName(in_whole.select(F.col("vec_id").alias("u"), F.explode("roots").alias("v")))
    roots, roots_path = components(edges)
    n_links = found.where("kind = 0").select(F.col("u").alias("pos"), F.col("v").alias("n")).unionByName(in_whole.select("pos", F.col("add").alias("n")))
    n_links = n_links.groupBy("pos").agg(F.sum("n").alias("n_links"))
    out = placed.select("pos", "vec_id").join(n_links, "pos", "left").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    out, _ = save(out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
    for path in (*paths, roots_path):
        discard(spark, path)
    return out


ORACLE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
             AND len([x FOR x IN embedding IF x <> 0]) > 0),
u AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM v),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.9),
n AS (SELECT u AS vec_id, count(*) AS n_links FROM l GROUP BY u),
r AS (WITH RECURSIVE reach(vec_id, root) AS (SELECT u, u FROM (SELECT DISTINCT u FROM l) UNION SELECT l.v, r.root FROM reach r JOIN l ON l.u = r.vec_id)
      SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(r.component_id, e.vec_id) AS component_id, coalesce(r.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.vec_id = e.vec_id LEFT JOIN r ON r.vec_id = e.vec_id
"""
