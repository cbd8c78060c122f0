"""Statistics as plans on aggregated rows: exact AUC by score histogram, and the p-value of Student's t."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def auc(df: DataFrame, by: list[str], score: str, positive: Column, least: int = 3, ranges: int = 0) -> DataFrame:
    """by, n, positives, auc (4 digits) of every group; null unless it has `least` positives and as many negatives.

    Rows are counted by group and score first, so the ranking runs over distinct scores only. Ties count half. Where scores are
    rounded when they are made, a group holds at most as many rows here as it has scores; for scores with very many distinct
    values, ranges > 1 ranks each range of a group's scores by itself, on top of what lies below the range.
    """
    pos = F.count_if(F.coalesce(positive, F.lit(False)))
    bins = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(pos.alias("p"), F.count(F.lit(1)).alias("n"))
    if ranges > 1:
        bins = below_in_ranges(bins, by, score, ranges)
    else:
        below = (W.partitionBy(*by) if by else W.partitionBy(F.lit(1))).orderBy(score).rowsBetween(W.unboundedPreceding, -1)
        bins = bins.withColumn("less", F.coalesce(F.sum(F.col("n") - F.col("p")).over(below), F.lit(0)))
    won = F.sum((F.col("p") * (F.col("less") * 2 + F.col("n") - F.col("p"))).cast("decimal(38,0)" if ranges > 1 else "long"))
    out = bins.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("p").alias("positives"), won.alias("won"))
    rest = F.col("n") - F.col("positives")
    value = F.round(F.col("won").cast("double") / (F.lit(2.0) * F.col("positives") * rest), 4)
    return out.select(*by, "n", "positives", F.when((F.col("positives") >= least) & (rest >= least), value).alias("auc"))


#: Parts that the rows of a group are dealt to where they meet the group's cuts.
SALTS = 16


def in_ranges(bins: DataFrame, by: list[str], score: str, ranges: int) -> DataFrame:
    """Adds _range, 0 to ranges - 1: a part of the group's scores, cut at approximate quantiles of its rows, so that parts hold about
    equally many. Equal scores are in one part. Where a part begins does not matter for what is computed from it."""
    cuts = bins.groupBy(*by).agg(F.percentile_approx(score, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("_cuts"))
    salts = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salts = salts.toDF(*(f"_by{i}" for i in range(len(by))), "_cuts", "_of")
    dealt = bins.withColumn("_salt", F.pmod(F.xxhash64(score), F.lit(SALTS)).cast("int"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)] + [F.col("_salt") == F.col("_of")]
    out = dealt.join(salts, same, "left").withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(score))))
    return out.select(*bins.columns, "_range")


def below_in_ranges(bins: DataFrame, by: list[str], score: str, ranges: int) -> DataFrame:
    """Adds less, the negatives (n - p) of the group with lower scores, by prefix sums in two levels: over the ranges of a group, and
    within each range."""
    dealt = in_ranges(bins, by, score, ranges)
    negatives = F.sum(F.col("n") - F.col("p"))
    totals = dealt.groupBy(*by, "_range").agg(negatives.alias("_all"))
    over = (W.partitionBy(*by) if by else W.partitionBy(F.lit(1))).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    totals = totals.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_range").alias("_of"), F.coalesce(F.sum("_all").over(over), F.lit(0)).alias("_under"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)] + [F.col("_range") == F.col("_of")]
    within = W.partitionBy(*by, "_range").orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    out = dealt.join(totals, same).withColumn("less", F.col("_under") + F.coalesce(negatives.over(within), F.lit(0)))
    return out.select(*bins.columns, "less")


#: Points of the quadrature for the p-value, even; steps by which the gamma function's argument is raised before its series is used.
POINTS, RAISED = 600, 32
#: The series of gamma(x + 1/2) / gamma(x) / sqrt(x) in powers of 1 / x.
GAMMA_RATIO = (1.0, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304)


def _fold(values: Column, term, start: float, add: bool) -> Column:
    return F.aggregate(values, F.lit(start), lambda s, i: s + term(i) if add else s * term(i))


def p_value(t: Column, degrees: Column) -> Column:
    """Two-sided p-value of Student's t in built-in functions; a null or NaN gives null, an infinite t gives 0.

    With t = sqrt(v) * tan(a), the density is a power of the cosine of a, which Simpson's rule sums at a fixed number of points. From
    eight degrees on what lies beyond t = 40 is less than 1e-9. The normalising ratio of gamma functions comes from its series,
    after raising the argument. Errors are below 1e-9.
    """
    t, v = F.abs(t.cast("double")), degrees.cast("double")
    x = v / 2
    top = x + RAISED
    series = sum((F.lit(c) / F.pow(top, F.lit(float(k))) for k, c in enumerate(GAMMA_RATIO)), F.lit(0.0))
    steps = F.sequence(F.lit(0), F.lit(RAISED - 1))
    ratio = _fold(steps, lambda k: (x + k) / (x + k + 0.5), 1.0, False) * F.sqrt(top) * series  # gamma(x + 1/2) / gamma(x)
    angle = F.atan(F.when(v >= 8, F.least(t, F.lit(40.0))).otherwise(t) / F.sqrt(v))
    weight = lambda i: F.when((i == 0) | (i == POINTS), 1.0).otherwise(F.when(i % 2 == 1, 4.0).otherwise(2.0))
    area = _fold(F.sequence(F.lit(0), F.lit(POINTS)), lambda i: weight(i) * F.pow(F.cos(angle * i / POINTS), v - 1), 0.0, True) * angle / (3 * POINTS)
    p = F.greatest(F.lit(0.0), F.lit(1.0) - area * ratio * (2 / math.sqrt(math.pi)))
    return F.when(t.isNull() | F.isnan(t) | F.isnan(v) | (v <= 0), F.lit(None).cast("double")).when(t == float("inf"), 0.0).otherwise(p)


