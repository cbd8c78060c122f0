"""Mixing sources to target weights as a time-varying curriculum.

Every source has a schedule of its weight over training time, from 0 to 1. Its integral, scaled to the source's target,
is the words demanded by that time. The documents of a source are laid one after the other in an order by hash, again and
again up to the cap; inverting the cumulative demand at a copy's middle gives its position, and the copies of all sources
are range-sorted by position. The plan counts words up to the target, rounded down, within the last copy too. The mixed corpus
holds whole copies: the one that crosses the target is there if that comes nearer to it, so a source's words differ from its target by
half a document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, fresh, save

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources by name, again and again; for each, its share of attention at knots of training time.
WEIGHTS = (5, 2, 1)
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)))
#: A source, and so each document, is repeated at most so often.
CAP = 3


def when_demanded(share: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """The time by which a schedule of linear pieces has demanded the given share (0 to 1) of its integral."""
    pieces, total = [], 0.0
    for (t0, a), (t1, b) in zip(schedule, schedule[1:], strict=False):
        area = (a + b) / 2 * (t1 - t0)
        pieces.append((t0, t1, a, b, total, area))
        total += area
    out = None
    for t0, t1, a, b, before, area in reversed(pieces):
        part = (share * F.lit(total) - F.lit(before)) / F.lit(area)
        time = F.lit(t0) + F.lit(t1 - t0) * (part * F.lit(a + b)) / (F.lit(a) + F.sqrt(F.lit(a * a) + part * F.lit(b * b - a * a)))
        out = time if out is None else F.when(share * F.lit(total) <= F.lit(before + area), time).otherwise(out)
    return out


def plan(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, cap: int = CAP, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with the columns size, source_size, target, taken, copies (array of copy, take, position) and position (of the
    first copy); and the names these have, which differ where docs has such columns.

    Null text or id, repeated rows: each row counts by its own size; null sources are one source, the last. A document
    without words takes none and has no position. Very long texts count whole. No rows give no rows. The order within a source is by md5 of the id, cut
    into 4096 buckets: sums of buckets are scanned first, then each bucket by itself, so no task has to hold a source.
    """
    return _planned(docs, F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"), F.xxhash64(text), weights, schedules, cap, doc_id, source)


def _planned(docs: DataFrame, words: Column, tie_by: Column, weights=WEIGHTS, schedules=SCHEDULES, cap: int = CAP, doc_id: str = "doc_id", source: str = "source") -> tuple[DataFrame, dict[str, str]]:
    names = dict(zip(want := ("size", "source_size", "target", "taken", "copies", "position"), fresh(docs, *want), strict=True))
    src, md5, bucket, before, inner, kind, tie = fresh(docs, "_src", "_md5", "_bucket", "_before", "_inner", "_kind", "_tie")
    size = names["size"]
    rows = docs.withColumns({
        size: words,
        src: F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), source)),
        md5: F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))),
        tie: tie_by,
    }).withColumn(bucket, F.substring(md5, 1, 3))
    # at most 4096 rows a source, written so that texts are read for them once
    sums, _ = save(rows.groupBy(src, bucket).agg(F.sum(size).alias("n")))
    # one row a source; their number is that of the sources, not of the documents
    each = sums.groupBy(src).agg(F.sum("n").alias("s"))
    each = each.withColumn(kind, (F.row_number().over(W.orderBy(src)) - 1) % len(weights))
    each = each.withColumn("w", F.element_at(F.array(*(F.lit(w) for w in weights)), F.col(kind) + 1)).withColumn("most", F.col("s") * cap)
    order = W.orderBy(F.col("most").cast("double") / F.col("w"), src)
    rest = (F.sum("s").over(W.partitionBy()) - F.sum("most").over(order.rowsBetween(W.unboundedPreceding, 0)) + F.col("most")).cast("double")
    level = rest / F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    each = each.withColumns({"level": level, "nth": F.row_number().over(order)})
    fits = F.when(F.col("level") <= F.col("most").cast("double") / F.col("w"), F.struct("nth", "level"))
    each = each.withColumn("at", F.min(fits).over(W.partitionBy())["level"])
    each = each.select(src, kind, F.col("s").alias(names["source_size"]), F.least(F.col("most").cast("double"), F.col("w") * F.col("at")).alias(names["target"]))
    offsets = sums.withColumn(before, F.sum("n").over(W.partitionBy(src).orderBy(bucket)) - F.col("n")).drop("n").join(each, src)
    within = W.partitionBy(src, bucket).orderBy(md5, doc_id, tie, size).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn(inner, F.sum(size).over(within) - F.col(size)).join(offsets, [src, bucket])
    target, whole = F.col(names["target"]), F.col(names["source_size"])
    copies = []
    for i in range(cap):
        start = whole * i + F.col(before) + F.col(inner)
        take = F.greatest(F.lit(0), F.least(F.col(size), F.floor(target) - start))
        share = (start.cast("double") + take.cast("double") / 2) / target
        time = None
        for k, s in reversed(list(enumerate(schedules))):
            time = when_demanded(share, s) if time is None else F.when(F.col(kind) == k, when_demanded(share, s)).otherwise(time)
        copies.append(F.struct(F.lit(i).alias("copy"), take.alias("take"), F.when(take > 0, time).alias("position")))
    rows = rows.withColumn(names["copies"], F.filter(F.array(*copies), lambda c: c["take"] > 0))
    rows = rows.withColumn(names["taken"], F.aggregate(names["copies"], F.lit(0).cast("long"), lambda a, c: a + c["take"]))
    rows = rows.withColumn(names["position"], F.get(names["copies"], F.lit(0))["position"])
    return rows.select(*docs.columns, *names.values()), names


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mixed corpus with the columns of docs: a row for each whole copy, range-sorted by position. Of a copy that the plan takes words
    from in part, at least half must be taken."""
    rows, names = plan(docs, doc_id=doc_id, source=source, text=text, **options)
    c, = fresh(rows, "_c")
    rows = rows.withColumn(c, F.explode(names["copies"]))
    rows = rows.where(F.col(f"{c}.take") * 2 >= F.col(names["size"]))
    rows = rows.repartitionByRange(F.col(f"{c}.position"), F.col(doc_id)).sortWithinPartitions(F.col(f"{c}.position"), F.col(doc_id))
    return rows.select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, position of every document, range-sorted by position."""
    light, path = save(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n"), F.xxhash64("text").alias("hash")))
    rows, names = _planned(light, F.col("n"), F.col("hash"))
    out = rows.select("doc_id", *(F.col(names[n]).alias(n) for n in ("size", "source_size", "target", "taken", "position")))
    done, _ = save(out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id"))
    discard(docs.sparkSession, path)
    return done


def _sql_time(share: str, schedule) -> str:
    out, total, pieces = None, 0.0, []
    for (t0, a), (t1, b) in zip(schedule, schedule[1:], strict=False):
        area = (a + b) / 2 * (t1 - t0)
        pieces.append((t0, t1, a, b, total, area))
        total += area
    d = lambda x: f"CAST({x!r} AS DOUBLE)"
    for t0, t1, a, b, before, area in reversed(pieces):
        part = f"(({share} * {d(total)} - {d(before)}) / {d(area)})"
        time = f"({d(t0)} + {d(t1 - t0)} * ({part} * {d(a + b)}) / ({d(a)} + sqrt({d(a * a)} + {part} * {d(b * b - a * a)})))"
        out = time if out is None else f"CASE WHEN {share} * {d(total)} <= {d(before + area)} THEN {time} ELSE {out} END"
    return out


ORACLE = f"""
WITH d AS (SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY source),
k AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind FROM s),
w AS (SELECT *, CASE kind WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, s * 3 AS most FROM k),
l AS (SELECT *, row_number() OVER o AS nth,
      CAST(sum(s) OVER () - sum(most) OVER o + most AS DOUBLE) / sum(w) OVER (ORDER BY CAST(most AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY CAST(most AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT source, kind, s AS source_size, least(CAST(most AS DOUBLE), w * (SELECT min_by(level, nth) FROM l WHERE level <= CAST(most AS DOUBLE) / w)) AS target FROM l),
c AS (SELECT d.*, kind, source_size, target,
      sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, [greatest(0, least(size, CAST(floor(target) AS BIGINT) - source_size * i - start)) FOR i IN [0, 1, 2]] AS takes FROM c),
f AS (SELECT *, CAST(list_sum(takes) AS BIGINT) AS taken, (CAST(start AS DOUBLE) + CAST(takes[1] AS DOUBLE) / 2) / target AS share FROM e)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN takes[1] > 0 THEN CASE kind WHEN 0 THEN {_sql_time("share", SCHEDULES[0])} WHEN 1 THEN {_sql_time("share", SCHEDULES[1])} ELSE {_sql_time("share", SCHEDULES[2])} END END AS position
FROM f
"""
