"""Connected components over an edge table: contraction within partitions, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, save


#: Edges that one task contracts.
EDGES = 1_000_000


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node but the smallest of its component among these edges, and that smallest one."""
    names, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for ends in (root[a], root[b], a, b):
            np.minimum.at(new, ends, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    child = np.flatnonzero(root != np.arange(len(names)))
    return names[child], names[root[child]]


def _contracted(edges: DataFrame, n: int) -> tuple[DataFrame, str]:
    """n edges (u, v) as stars of each partition; a task holds about EDGES of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if parts:
            u, v = contract(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return save(edges.coalesce(-(-n // EDGES) or 1).mapInArrow(run, "u long, v long"))


def _check(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, root) for every node of edges (u, v) but the roots, which are the smallest of their component; and its path.

    Each partition's edges become stars first, so few steps are left; up to EDGES edges are done by that. A step groups by node with
    partial minima and joins them back, so a node of very many edges is no group in one task. Each pair of steps is one job, written
    to the shared folder; the driver sees counts and a checksum.
    """
    spark = edges.sparkSession
    now, path = save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    seen, before = _check(now), None
    while seen != before:
        stars, stars_path = _contracted(now, seen[0])
        discard(spark, path)
        if seen[0] <= EDGES:
            now, path = stars, stars_path
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, path = save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(spark, stars_path)
        seen, before = _check(now), seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")), path
