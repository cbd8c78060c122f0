"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document is the set of its word shingles. Documents with equal sets are one node. A signature holds 128 minima; each of
32 trees sorts all nodes by its own order of the minima. Candidates are looked for in three steps, each on what the one before
has left in different components:

1. A node's next neighbour in each order, if they share a prefix of five; the likeliest partner first.
2. All pairs within a run of equal prefix, where the run is small. Longer runs are cut by longer prefixes until they are small,
   so the depth adapts to each region.
3. Runs that are still large at a prefix of five and hold several components are regions. Their nodes meet the best linked node of
   the region. What is left of a large region, nodes outside its largest component, goes through a prefix filter: two sets that are
   similar enough share one of the rarest shingles of each, so nodes meet by those, of like sizes only, and are confirmed in full. Pages
   of one template have rare shingles of their own, and few meet. Where rare shingles are shared by so many that this would be
   dearer, as among variants of one text, and in smaller regions, nodes outside the largest component meet all nodes of the region, block by
   block, with exact set intersections inside a task that gives back no more links than join components.

So of two similar documents that share a prefix of five in any of the 32 orders, a link is never lost, however crowded a region
is; for similarity 0.8 the chance to share none is 3e-6, computed as if orders were independent. The third step costs the pairs that
share a rare shingle, or the nodes outside a region's largest component times the nodes of the region, whichever is less.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, map_rows, save, scratch_dir
from .components import components

#: Minima of a signature; trees, the minima between the beginnings of two trees, and the minima that a tree sorts by.
HASHES, TREES, STEP, DEPTH = 128, 32, 4, 16
#: Shared prefixes by which runs are told, from that of a candidate on; nodes of a run of which all pairs are looked at; parts
#: that the rows of a run are dealt to.
PREFIXES, SMALL, SALTS = (5, 8, 16), 16, 8
#: Nodes, and bytes of their sets, of the two sides of a block of a crowded region.
OUTSIDE, OUTSIDE_BYTES, INSIDE, INSIDE_BYTES = 256, 4_000_000, 1024, 16_000_000
#: Pairs of a region from which on its rare shingles are looked at, and the part of them that makes these worth it.
PREFIX_FROM, WORTH = 4_000_000, 20
#: Similarity of linked documents, in percent.
SIMILAR = 80
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: runs of `width` words, or all words if there are fewer.

    Words are what stands between ASCII white space, with A-Z lower-cased.
    """
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    width_here = min(width, len(h))
    out = np.full(len(h) - width_here + 1, width_here, np.uint64)
    for i in range(width_here):
        out = (out ^ h[i : i + len(out)]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def minima(hashes: np.ndarray) -> np.ndarray:
    """HASHES minima of a set under multiplicative hashes, as 16-bit values."""
    factors = np.random.default_rng(9).integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        np.minimum(least, np.multiply.outer(factors, hashes[i : i + 4096]).min(axis=1), out=least)
    return (least >> np.uint64(20)).astype(np.uint16)


def signatures(docs: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, and of documents with words the 128-bit hash of the set and the signature."""
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def make():
        import xxhash

        def rows(ids, texts):
            sets = [shingles(t, width) for t in texts]
            return [
                ids,
                [len(s) for s in sets],
                [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                [minima(s).astype(">u2").tobytes() if len(s) else None for s in sets],
            ]

        return rows

    return map_rows(docs.select(doc_id, text), make, f"doc_id {kind}, n_shingles long, same binary, sig binary", text)


def _trees(nodes: DataFrame) -> DataFrame:
    """tree, key (DEPTH minima in the tree's order), id, and root if nodes have it: a row for each node and tree."""
    order = np.array([[(t * STEP + d) % HASHES for d in range(DEPTH)] for t in range(TREES)])
    names = [c for c in ("id", "root") if c in nodes.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint16).reshape(-1, HASHES)
            keys = np.ascontiguousarray(sig[:, order]).view(f"S{2 * DEPTH}")  # big-endian bytes stay as they are
            raw = keys.tobytes()
            n = batch.num_rows * TREES
            key = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * (2 * DEPTH)), pa.py_buffer(raw)])
            own = [pa.array(np.repeat(c.to_numpy(zero_copy_only=False), TREES)) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), batch.num_rows)), key, *own], ["tree", "key", *names])

    return nodes.select("sig", *names).mapInArrow(run, "tree int, key binary, " + ", ".join(f"{c} long" for c in names))


def _neighbours(rows: DataFrame) -> DataFrame:
    """Pairs of neighbours that share a prefix in sorted partitions, as a < b, and the first and last row of each partition (tree,
    key, id), whose other neighbours are in another one."""
    none, size = ["a", "b", "tree", "key", "id"], PREFIXES[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, key, ids = np.empty(0, np.int32), np.empty((0, DEPTH), np.uint16), np.empty(0, np.int64)
        first = True

        def end(at: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 2, pa.array(tree[at:][:1]), pa.array([key[at].tobytes()], pa.binary()), pa.array(ids[at:][:1])], none)

        for batch in batches:
            if not batch.num_rows:
                continue
            tree = np.concatenate([tree[-1:], batch.column(0).to_numpy(zero_copy_only=False)])
            key = np.concatenate([key[-1:], np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, DEPTH)])
            ids = np.concatenate([ids[-1:], batch.column(2).to_numpy(zero_copy_only=False)])
            if first:
                yield end(0)
                first = False
            close = (tree[:-1] == tree[1:]) & (key[:-1, :size] == key[1:, :size]).all(axis=1)
            if close.any():
                a, b = ids[:-1][close], ids[1:][close]
                m = len(a)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64())], none)
        if not first:
            yield end(-1)

    return rows.mapInArrow(run, "a long, b long, tree int, key binary, id long")


def neighbours(nodes: DataFrame) -> tuple[DataFrame, str]:
    """(a, b, hits) with a < b, and the path: pairs that are neighbours in so many orders of the forest."""
    order = ["tree", "key", "id"]
    found, path = save(_neighbours(_trees(nodes.select("sig", "id")).repartitionByRange(*order).sortWithinPartitions(*order)))
    # two rows of each partition meet their neighbours in one more sorted pass
    borders = found.where("a IS NULL").select(*order).distinct().coalesce(1).sortWithinPartitions(*order)
    pairs = found.where("a IS NOT NULL").select("a", "b").unionByName(_neighbours(borders).where("a IS NOT NULL").select("a", "b"))
    out, out_path = save(pairs.where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits")))
    discard(nodes.sparkSession, path)
    return out, out_path


def _bucketed(sets: DataFrame, stack: ExitStack) -> DataFrame:
    """sets (id, set) as a table in the shared folder, bucketed by id so that the joins of all turns don't shuffle it again; the stack
    drops it."""
    spark = sets.sparkSession
    name = f"predlens_{uuid.uuid4().hex}"
    path, n = f"{scratch_dir(spark)}/{name}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    stack.callback(discard, spark, path)
    stack.callback(spark.sql, f"DROP TABLE IF EXISTS {name}")
    sets.write.bucketBy(n, "id").sortBy("id").option("path", path).saveAsTable(name)
    return spark.table(name)


def confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""

    def make():
        def rows(a, b, left, right):
            keep = []
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= similar * (len(both) - common):
                    keep.append(i)
            return [[a[i] for i in keep], [b[i] for i in keep]]

        return rows

    left = sets.select(F.col("id").alias("a"), F.col("set").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("right"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return map_rows(both, make, "a long, b long", "left")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right.

    Tokens that many sets on the right hold are columns of a matrix product, the others are counted along their postings.
    """
    n, m = len(left), len(right)
    out = np.zeros((n, m), np.int32)
    held, holder = np.concatenate(right), np.repeat(np.arange(m), [len(s) for s in right])
    order = np.argsort(held, kind="stable")
    held, holder = held[order], holder[order]
    asked, asker = np.concatenate(left), np.repeat(np.arange(n), [len(s) for s in left])
    begin, end = np.searchsorted(held, asked), np.searchsorted(held, asked, "right")
    times = end - begin
    often = times > max(32, m // 16)
    rare = np.flatnonzero((times > 0) & ~often)
    cuts = np.searchsorted(np.cumsum(times[rare]), np.arange(0, times[rare].sum(), 4_000_000), "right") if len(rare) else []
    for at in np.split(rare, cuts):
        if len(at):
            t = times[at]
            place = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t) + np.repeat(begin[at], t)
            out += np.bincount(np.repeat(asker[at], t) * m + holder[place], minlength=n * m).reshape(n, m).astype(np.int32)
    tokens, column = np.unique(begin[often], return_inverse=True)
    for low in range(0, len(tokens), 2048):
        some = tokens[low : low + 2048]
        a, b = np.zeros((n, len(some)), np.float32), np.zeros((m, len(some)), np.float32)
        here = (column >= low) & (column < low + 2048)
        a[asker[often][here], column[here] - low] = 1
        for i, first in enumerate(some.tolist()):
            b[holder[first : np.searchsorted(held, held[first], "right")], i] = 1
        out += (a @ b.T).astype(np.int32)
    return out


def joining(ids: list[np.ndarray], roots: list[np.ndarray], near: np.ndarray) -> list[tuple[int, int]]:
    """Of the links from left (rows of near) to right those that join components: at most one less than there are components."""
    names, code = np.unique(np.concatenate(roots), return_inverse=True)
    label, left, right = np.arange(len(names)), code[: len(roots[0])], code[len(roots[0]) :]
    out = []
    for i in np.flatnonzero(near.any(axis=1)).tolist():
        at = np.flatnonzero(near[i])
        others, first = np.unique(label[right[at]], return_index=True)
        own = label[left[i]]
        out += [(int(ids[0][i]), int(ids[1][at[f]])) for o, f in zip(others.tolist(), first.tolist(), strict=True) if o != own]
        label[np.isin(label, others)] = own
    return out


def _crowded(dense: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Links (a, b) that join the components of each region. dense: id, region, root, outside
    and met: the nodes outside meet those to be met, in blocks that hashes of both deal them to, so no key is hot."""
    rows = dense.join(sets, "id")
    bytes_of = lambda c: F.sum(F.when(c, F.length("set")).otherwise(0))
    size = rows.groupBy("region").agg(F.count_if("outside").alias("n_out"), F.count_if("met").alias("n"), bytes_of(F.col("outside")).alias("b_out"), bytes_of(F.col("met")).alias("b"))
    blocks = lambda n, most, size, bytes_: F.greatest(F.ceil(F.col(n) / most), F.ceil(F.col(size) / bytes_)).cast("int")
    size = size.where("n_out > 0 AND n > 0").select("region", blocks("n_out", OUTSIDE, "b_out", OUTSIDE_BYTES).alias("outs"), blocks("n", INSIDE, "b", INSIDE_BYTES).alias("ins"))
    rows = rows.join(size, "region")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = rows.where("outside").select("region", "id", "root", "set", own("outs").alias("out"), each("ins").alias("in"))
    asked = rows.where("met").select("region", "id", "root", "set", own("ins").alias("in"), each("outs").alias("out"))
    asking, asked = asking.toDF(*asking.columns), asked.toDF(*asked.columns)
    key = ["region", "out", "in"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            a, b = ([np.frombuffer(s, np.uint64) for s in side["set"]] for side in (left, right))
            common = intersections(a, b)
            size = np.add.outer([len(s) for s in a], [len(s) for s in b])
            roots = [side["root"].to_numpy() for side in (left, right)]
            near = (100 * common >= similar * (size - common)) & (roots[0][:, None] != roots[1])
            found = joining([side["id"].to_numpy() for side in (left, right)], roots, near)
        return pd.DataFrame([(min(p), max(p)) for p in found], columns=["a", "b"]).astype("int64")

    return asking.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(meet, "a long, b long").distinct()


def _tokens(rows: DataFrame) -> DataFrame:
    """region, id, token: a row for each shingle of rows (region, id, set)."""

    def make():
        def each(regions, ids, sets):
            tokens = [np.frombuffer(s, np.int64) for s in sets]
            times = [len(t) for t in tokens]
            return [np.repeat(np.array(regions, np.int64), times), np.repeat(np.array(ids, np.int64), times), np.concatenate([np.empty(0, np.int64), *tokens])]

        return each

    return map_rows(rows.select("region", "id", "set"), make, "region long, id long, token long", "set")


def rare_shingles(dense: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """region, token, id, root, outside, size, short: the rarest shingles of each node (region, id, root, outside). Two sets that are similar enough
    have one in common that is among the short ones of the smaller set: it has so few shingles more than both must share, which is a share of
    the sizes' sum. Rare is what few nodes of the region have; ties go by the shingle."""
    rows = dense.join(sets, "id")
    tokens = _tokens(rows).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    counts = tokens.groupBy("region", "token").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # some are in every set of the region
    held = tokens.join(counts, ["region", "token", "salt"]).groupBy("region", "id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t"))
    size = F.size("t")
    first = size - F.ceil(size * similar / 100.0) + 1
    held = held.select("region", "id", size.alias("size"), F.posexplode(F.slice("t", F.lit(1), first.cast("int"))).alias("nth", "x"))
    short = F.col("nth") <= F.col("size") - F.ceil(F.col("size") * (2 * similar) / (100.0 + similar))
    return held.select("region", "id", "size", "x.token", short.alias("short")).join(dense.select("id", "root", "outside"), "id")


def rare_pairs(postings: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) that share a rare shingle, are in different components, and of sizes that can be similar enough; one is outside."""
    side = lambda rows, p: rows.select("region", "token", *(F.col(c).alias(p + c) for c in ("id", "root", "outside", "size")))
    both = side(postings.where("short"), "a_").join(side(postings, "b_"), ["region", "token"])
    both = both.where("(a_size < b_size OR a_size = b_size AND a_id < b_id) AND a_root <> b_root AND (a_outside OR b_outside)")
    both = both.where(100 * F.col("a_size") >= similar * F.col("b_size"))
    return both.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()


class _Linker:
    """The growing components: labels (node, root), links and the pairs that have been compared."""

    def __init__(self, sets: DataFrame, similar: int, stack: ExitStack):
        self.sets, self.similar, self.stack, self.spark = sets, similar, stack, sets.sparkSession
        self.labels = self.links = self.tried = None

    def save(self, df: DataFrame) -> DataFrame:
        out, path = save(df)
        self.stack.callback(discard, self.spark, path)
        return out

    def roots(self, df: DataFrame, node: str, root: str) -> DataFrame:
        """df with the root of each node."""
        found = df.join(self.labels.toDF(node, "_root"), node, "left")
        return found.withColumn(root, F.coalesce("_root", node)).drop("_root")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose nodes are in different components."""
        return self.roots(self.roots(pairs, "a", "ra"), "b", "rb").where("ra <> rb").drop("ra", "rb")

    def untried(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self.tried, ["a", "b"], "left_anti")

    def compare(self, chosen: DataFrame) -> bool:
        """Compares the chosen pairs and merges the components that the links among them join; whether there are any."""
        tested = self.save(chosen.select("a", "b"))
        if self.labels is not None and tested.isEmpty():
            return False
        self.tried = tested if self.tried is None else self.tried.unionByName(tested)
        return self.merge(confirmed(tested, self.sets, self.similar))

    def merge(self, found: DataFrame) -> bool:
        new_links = self.save(found)
        self.links = new_links if self.links is None else self.links.unionByName(new_links)
        if self.labels is None:
            edges = new_links.toDF("u", "v")
        else:
            edges = self.roots(self.roots(new_links, "a", "u"), "b", "v").select("u", "v")
        new, path = components(edges)
        self.stack.callback(discard, self.spark, path)
        if self.labels is None:
            self.labels = new
            return True
        if new.isEmpty():
            return False
        old = self.labels.join(new.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        self.labels = self.save(old.unionByName(new.join(self.labels.select("node"), "node", "left_anti")))
        return True


def _small_runs(linker: _Linker, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different components in small runs of rows (tree, key, id, root), and (id, lead) of the runs that are large at
    the shortest prefix; lead is the smallest id of the run. The rows of a run are dealt to SALTS parts."""
    pairs, large = [], None
    for depth in PREFIXES:
        own = rows.select("tree", F.substring("key", 1, 2 * depth).alias("run"), "key", "id", "root")
        size = own.groupBy("tree", "run").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.min("id").alias("lead"))
        size = size.where("low < high").select("tree", "run", "n", "lead", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        own = own.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        mixed = linker.save(own.join(size, ["tree", "run", "salt"]).drop("salt"))
        members = mixed.where(F.col("n") <= SMALL).groupBy("tree", "run").agg(F.sort_array(F.collect_list(F.struct("id", "root"))).alias("m"))
        first = members.select("m", F.posexplode("m").alias("i", "x"))
        each = first.select("x", F.explode(F.slice("m", F.col("i") + 2, SMALL)).alias("y")).where("x.root <> y.root")
        pairs.append(each.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))
        rows = mixed.where(F.col("n") > SMALL)
        if large is None:
            large = rows.select("id", "lead")
        if rows.isEmpty():
            break
    out = pairs[0]
    for more in pairs[1:]:
        out = out.unionByName(more)
    return out.distinct(), large


def _regions(linker: _Linker, large: DataFrame) -> None:
    """Compares what is still apart in large runs (id, lead): runs that share nodes are a region."""
    edges = linker.save(large.distinct())
    if edges.isEmpty():
        return
    joined, path = components(edges.toDF("u", "v"))
    linker.stack.callback(discard, linker.spark, path)
    nodes = edges.select("id").distinct().join(joined.toDF("id", "region"), "id", "left")
    nodes = linker.save(nodes.select("id", F.coalesce("region", "id").alias("region")))

    def placed() -> DataFrame:
        """id, region, root, outside: whether it is not in the region's largest component."""
        own = linker.roots(nodes, "id", "root")
        count = own.groupBy("region", "root").agg(F.count(F.lit(1)).alias("n"))
        largest = count.groupBy("region").agg(F.max(F.struct("n", "root")).alias("x")).select("region", F.col("x.root").alias("most"))
        return own.join(largest, "region").select("id", "region", "root", (F.col("root") != F.col("most")).alias("outside"))

    # the best linked node of each region
    ends = linker.links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    hubs = nodes.join(ends, "id").groupBy("region").agg(F.max(F.struct("n", "id")).alias("x")).select("region", F.col("x.id").alias("hub"))
    met = linker.roots(nodes, "id", "root").join(hubs, "region").withColumns({"outside": F.col("id") != F.col("hub"), "met": F.col("id") == F.col("hub")})
    linker.merge(_crowded(linker.save(met.drop("hub")), linker.sets, linker.similar))
    dense = linker.save(placed())
    sizes = linker.save(dense.groupBy("region").agg(F.count_if("outside").alias("n_out"), F.count(F.lit(1)).alias("n")).where("n_out > 0"))
    blocks = sizes.select("region")
    large = sizes.where(F.col("n_out") * F.col("n") > PREFIX_FROM)
    if not large.isEmpty():
        postings = linker.save(rare_shingles(dense.join(large.select("region"), "region"), linker.sets, linker.similar))
        met = postings.groupBy("region", "token").agg(F.count_if("short").cast("double").alias("short"), F.count(F.lit(1)).alias("m"))
        cost = met.groupBy("region").agg(F.sum(F.col("short") * (F.col("m") - 1)).alias("cost"))
        cheap = linker.save(large.join(cost, "region").where(F.col("cost") * WORTH <= F.col("n_out") * F.col("n")).select("region"))
        linker.compare(linker.untried(rare_pairs(postings.join(cheap, "region"), linker.similar)))
        blocks = blocks.join(cheap, "region", "left_anti")
        dense = linker.save(placed())
    linker.merge(_crowded(dense.join(blocks, "region").withColumn("met", F.lit(True)), linker.sets, linker.similar))


def link(docs: DataFrame, width: int = 5, similar: int = SIMILAR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id that is reachable), kept (it is the row's own).

    A null or empty text, or one without words, is an empty set: n_shingles 0, linked with nothing. A null id takes no part:
    its component is null and it is kept. Rows that share an id are one document; if their sets differ, the one of the smallest
    hash is linked for all of them. Very long texts are compared whole; other columns are not read; no rows give no rows. Integer
    ids only. The result is a table in the shared folder; all others that were written on the way are deleted.
    """
    spark = docs.sparkSession
    with ExitStack() as stack:

        def kept(df: DataFrame) -> DataFrame:
            out, path = save(df)
            stack.callback(discard, spark, path)
            return out

        own = kept(signatures(docs, width, doc_id, text))
        ids = own.where("same IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "same", "sig")
        several = ids.groupBy("id").agg(F.min("same").alias("low"), F.max("same").alias("high")).where("low <> high").select("id", "low")
        torn = not several.isEmpty()
        if torn:
            own = own.join(several.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("same", F.when(F.col("same").isNotNull(), F.coalesce("low", "same")))
            ids = ids.join(several, "id", "left").where("low IS NULL OR same = low")
        nodes = ids.groupBy("same").agg(F.min(F.struct("id", "sig")).alias("x"))
        nodes = kept(nodes.select("same", F.col("x.id").alias("id"), F.col("x.sig").alias("sig")))
        left, path = neighbours(nodes)
        stack.callback(discard, spark, path)
        involved = left.select(F.explode(F.array("a", "b")).alias("id")).distinct()

        def make():
            import xxhash

            def rows(ids, texts):
                sets = [shingles(t, width).tobytes() for t in texts]
                return [ids, [xxhash.xxh3_128_digest(s) for s in sets], sets]

            return rows

        # merged at any size: a broadcast of the ids would only do while they are few, and each bucket comes from one task
        texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(involved.hint("merge"), "id", "left_semi")
        texts = texts if torn else texts.where("text IS NOT NULL").dropDuplicates(["id"])
        sets = map_rows(texts, make, "id long, same binary, set binary").where(F.length("set") > 0)
        if torn:
            sets = sets.groupBy("id").agg(F.min(F.struct("same", "set")).alias("x")).select("id", "x.set")
        linker = _Linker(_bucketed(sets.select("id", "set"), stack), similar, stack)
        # each node's likeliest partner first, twice: what that links needs no more comparisons
        best = F.max(F.struct("hits", F.xxhash64("a", "b"), "a", "b")).alias("x")
        for _ in range(2):
            ends = left.select("*", F.explode(F.array("a", "b")).alias("node"))
            linker.compare(ends.groupBy("node").agg(best).select("x.a", "x.b").distinct())
            left = kept(linker.untried(linker.apart(left)))
        still = linker.roots(nodes.select("id", "sig").join(involved, "id", "left_semi"), "id", "root")
        pairs, large = _small_runs(linker, _trees(still.select("sig", "id", "root")))
        linker.compare(linker.untried(pairs))
        _regions(linker, large)
        group = linker.roots(nodes.select("same", "id"), "id", "root").select("same", "root")
        kind = own.schema["doc_id"].dataType
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("root").cast(kind), F.col("doc_id")))
        out = own.join(group, "same", "left").select("doc_id", "n_shingles", component.alias("component_id"))
        return save(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))[0]


def keep_one(docs: DataFrame, width: int = 5, similar: int = SIMILAR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component, the one of the smallest id; columns as they are."""
    key, = fresh(docs, "_gone")
    gone = link(docs, width, similar, doc_id, text).where("NOT kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone.hint("merge"), docs[doc_id] == gone[key], "left_anti")
