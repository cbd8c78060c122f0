"""Joins and groups along time: the last report before a scan, scans within intervals, and sessions.

Times are cut into spans of a fixed length, and a key's rows are dealt by span, so a key with very many rows is many groups.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How much longer the spans of each length are than those before, and the number of lengths; the end of time, in microseconds.
SPANS, LEVELS, OPEN = 16, 5, 253_402_300_800_000_000


def _micros(c: Column | str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def span_of(time: Column | str, seconds: float) -> Column:
    """Number of the span of so many seconds that a time lies in."""
    return F.floor(_micros(time) / F.lit(int(seconds * 1_000_000))).cast("long")


def asof_join(rows: DataFrame, reports: DataFrame, on: list[str], time: str, report_time: str, columns: list[str], span: float = 30 * 86400, at_once: bool = True, order: tuple[str, ...] = (), within: float | None = None) -> DataFrame:
    """rows with the columns of the last report of their key at or before their time; at_once=False: before it.

    Rows without such a report have nulls, and so have those with a null key or time; reports with a null time or key are none.
    Of reports of one time the last by order counts. within: a report is too old after so many seconds.

    Rows and reports are one table, dealt by key and span and sorted once; the last report is carried forward in each part. What a part
    inherits, the last report of all earlier spans, comes from one row for each key and span that has reports.
    """
    some = reports.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*on, report_time)))
    report = F.struct(F.col(report_time).cast("timestamp").alias("_at"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.struct(*columns).alias("_v"))
    reported = some.select(*on, F.col(report_time).cast("timestamp").alias("_time"), F.lit(0 if at_once else 1).alias("_kind"), report.alias("_report"), F.lit(None).cast(rows.schema).alias("_row"))
    asked = rows.select(*on, F.col(time).cast("timestamp").alias("_time"), F.lit(1 if at_once else 0).alias("_kind"), F.lit(None).cast(reported.schema["_report"].dataType).alias("_report"), F.struct(*rows.columns).alias("_row"))
    reported = reported.withColumn("_span", span_of("_time", span))
    # a report holds until the next span that has one: spans from its own on, to that of the next
    last = reported.groupBy(*on, "_span").agg(F.max("_report").alias("_last"))
    inherited = last.select(*on, F.col("_span").alias("_from"), F.lead("_span").over(W.partitionBy(*on).orderBy("_span")).alias("_to"), "_last")
    both = reported.unionByName(asked.withColumn("_span", span_of("_time", span)))
    order_ = W.partitionBy(*on, "_span").orderBy("_time", "_kind", "_report").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("_in", F.last("_report", ignorenulls=True).over(order_)).where("_row IS NOT NULL")
    # spans that rows lie in, each with the last span of reports before it
    spans = asked.select(*on, span_of("_time", span).alias("_span")).distinct().withColumn("_known", F.lit(False))
    marks = spans.unionByName(inherited.select(*on, F.col("_from").alias("_span"), F.lit(True).alias("_known"), "_last"), allowMissingColumns=True)
    before = W.partitionBy(*on).orderBy("_span").rangeBetween(W.unboundedPreceding, -1)
    carried = marks.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).where("NOT _known").select(*on, "_span", "_carried")
    keys = [*on, "_span"]
    out = both.alias("l").join(carried.alias("r"), [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys], "left")
    found = F.coalesce("_in", "_carried")
    if within is not None:
        found = F.when(_micros("_time") - _micros(found["_at"]) <= int(within * 1_000_000), found)
    return out.withColumn("_found", found).select("_row.*", *(F.col(f"_found._v.{c}").alias(c) for c in columns))


def periods(reports: DataFrame, on: list[str], time: str, is_open: Column) -> DataFrame:
    """begin and end of the periods of a key in which reports are open: from the first one to the next that is not, whose time is the
    end, or null. Reports of equal times count as open if any is; those without a time go. A key has few reports."""
    at = reports.where(F.col(time).isNotNull()).groupBy(*on, F.col(time).cast("timestamp").alias("begin")).agg(F.max(F.coalesce(is_open, F.lit(False))).alias("_open"))
    w = W.partitionBy(*on).orderBy("begin")
    marked = at.withColumn("_was", F.coalesce(F.lag("_open").over(w), F.lit(False))).where(F.col("_open") != F.col("_was"))
    return marked.withColumn("end", F.lead("begin").over(w)).where("_open").select(*on, "begin", "end")


def _of_level(level: Column, span: Column) -> Column:
    return F.struct(level.alias("_level"), span.alias("_span"))


def pieces_of(intervals: DataFrame, on: list[str], begin: str, end: str, columns: list[str], span: float) -> DataFrame:
    """The spans that cover each interval: its key as _k0 and so on, the interval as _i, _level and _span."""
    unit = int(span * 1_000_000)
    cut = intervals.where(F.col(begin).isNotNull()).select(*on, F.struct(_micros(begin).alias("t0"), F.coalesce(_micros(end), F.lit(OPEN)).alias("t1"), F.struct(*columns).alias("v")).alias("_i")).where("_i.t0 < _i.t1")
    cut = cut.withColumns({"_low0": F.floor(F.col("_i.t0") / unit), "_high0": F.floor((F.col("_i.t1") - 1) / unit)})
    none, covers = F.array().cast("array<bigint>"), []
    sequence = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(none)
    for k in range(LEVELS):
        low, high = F.col(f"_low{k}"), F.col(f"_high{k}")  # spans of this length that are to be covered, none if low > high
        if k == LEVELS - 1:
            own = sequence(low, high)
        else:
            up, down = F.col(f"_low{k + 1}"), F.col(f"_high{k + 1}")  # spans of the next length wholly within them
            whole_up, whole_down = F.ceil(low / SPANS), F.floor((high + 1) / SPANS) - 1
            fits = (low <= high) & (whole_up <= whole_down)
            cut = cut.withColumns({f"_low{k + 1}": F.when(fits, whole_up).otherwise(F.lit(1)), f"_high{k + 1}": F.when(fits, whole_down).otherwise(F.lit(0))})
            own = F.when(up <= down, F.concat(sequence(low, up * SPANS - 1), sequence((down + 1) * SPANS, high))).otherwise(sequence(low, high))
        covers.append(F.transform(own, functools.partial(_of_level, F.lit(k))))
    return cut.select(*on, "_i", F.explode(F.flatten(F.array(*covers))).alias("_p")).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(on)), "_i", "_p._level", "_p._span")


def interval_join(rows: DataFrame, intervals: DataFrame, on: list[str], time: str, begin: str, end: str, columns: list[str], span: float = 86400) -> DataFrame:
    """rows with the columns of every interval of their key that holds their time, begin <= time < end.

    An interval without an end is open; one without a begin, or that ends where it begins or before, holds nothing. A null key or time
    is in none; a row in no interval goes, one in several comes once for each.

    An interval is cut into spans of growing length, each SPANS times the one before, by the longest spans that fit, so a long one is few pieces.
    A row looks at the span of each length that it lies in. They meet by equality of key, length and span; the exact test follows.
    """
    unit, pieces = int(span * 1_000_000), pieces_of(intervals, on, begin, end, columns, span)
    looks = F.array(*(F.struct(F.lit(k).alias("_level"), F.floor(_micros(time) / (unit * SPANS**k)).alias("_span")) for k in range(LEVELS)))
    keys = [f"_k{i}" for i in range(len(on))]
    asked = rows.where(F.col(time).isNotNull()).select(F.struct(*rows.columns).alias("_row"), *(F.col(c).alias(k) for c, k in zip(on, keys, strict=True)), _micros(time).alias("_t"), F.explode(looks).alias("_p"))
    asked = asked.select("_row", *keys, "_t", "_p._level", "_p._span")
    met = asked.join(pieces, [*keys, "_level", "_span"]).where((F.col("_t") >= F.col("_i.t0")) & (F.col("_t") < F.col("_i.t1")))
    return met.select("_row.*", *(F.col(f"_i.v.{c}").alias(c) for c in columns))


def sessions(rows: DataFrame, on: list[str], time: str, gap: float = 1800.0, span: float = 86400) -> DataFrame:
    """begin, end (time of the last row) and n of each session of a key: rows of which none is more than gap seconds after the one before.

    A null key is a key, rows without a time go. Rows of a key are joined into runs within each span, and then the runs of the key;
    so a key with very many rows is many groups, and few rows are left where it is one.
    """
    limit = int(gap * 1_000_000)

    def joined(runs: DataFrame, *key: str) -> DataFrame:
        """Runs (t0, t1, n) of a key that do not overlap, joined where the next begins within the gap."""
        w = W.partitionBy(*key).orderBy("t0", "t1")
        new = F.coalesce((F.col("t0") - F.lag("t1").over(w) > limit).cast("int"), F.lit(1))
        nth = runs.withColumn("_new", new).withColumn("_nth", F.sum("_new").over(w))
        return nth.groupBy(*key, "_nth").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("n").alias("n"))

    at = _micros(time)
    points = rows.where(F.col(time).isNotNull()).select(*on, span_of(time, span).alias("_span"), at.alias("t0"), at.alias("t1"), F.lit(1).cast("long").alias("n"))
    out = joined(joined(points, *on, "_span").drop("_span", "_nth"), *on)
    return out.select(*on, F.timestamp_micros("t0").alias("begin"), F.timestamp_micros("t1").alias("end"), "n")


def stream_sessions(stream: DataFrame, on: list[str], time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """The same sessions of a stream: the engine keeps the open ones of each key, and gives one out when the watermark has passed
    its last row by the gap. A row that comes later than that is dropped and counted (jobs.late_rows)."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = rows.groupBy(*on, F.session_window(time, gap).alias("_s")).agg(F.max(time).alias("end"), F.count(F.lit(1)).alias("n"))
    return out.select(*on, F.col("_s.start").alias("begin"), "end", "n")
