"""Hypotheses in plain words, and the tests they stand for: a group against the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, HYPOTHESES, Config
from ..functions import columns as C
from ..functions import stats


def parse(questions: DataFrame, column: str = "question", patterns=HYPOTHESES) -> DataFrame:
    """Adds axis and value; null where no pattern matches."""
    return questions.withColumn("_h", C.hypothesis(column, patterns)).withColumns({"axis": F.col("_h.axis"), "value": F.col("_h.value")}).drop("_h")


def sides(records: DataFrame, tests: list[tuple[str, str]], cfg: Config = DEFAULT) -> DataFrame:
    """axis, value, in_group, score, and what the records of that side with that score add up to: _rows, _n (with a confidence), its sums _sum and
    _squares, and for the AUC _labels (with a score) and _positives. A null is in the rest; axes that are missing are left out.

    Records are counted by score, label and the sides they are on before they are dealt to the tests, so each is read once.
    """
    there = [(a, v) for a, v in tests if a in records.columns]
    inside = lambda a, v: F.coalesce(F.lower(F.col(a).cast("string")), F.lit("nan")) == v.lower()
    conf, score, one = F.col("confidence_score") / 10, F.col("mel_prob"), F.count(F.lit(1))
    rows = records.select(F.array(*(inside(a, v) for a, v in there)).alias("_in"), score.alias("score"), F.coalesce(F.col("human_label") == cfg.positive, F.lit(False)).alias("_y"), conf.alias("_c"))
    bins = rows.groupBy("_in", "score", "_y").agg(one.alias("_rows"), F.count("_c").alias("_n"), F.sum("_c").alias("_sum"), F.sum(F.col("_c") * F.col("_c")).alias("_squares"))
    each = F.array(*(F.struct(F.lit(a).alias("axis"), F.lit(v).alias("value"), F.get("_in", F.lit(i)).alias("in_group")) for i, (a, v) in enumerate(there)))
    known = F.when(F.col("score").isNotNull(), F.col("_rows")).otherwise(0)
    out = bins.withColumn("_t", F.explode(each)).select("_t.*", "score", "_rows", "_n", "_sum", "_squares", known.alias("_labels"), F.when(F.col("_y"), known).otherwise(0).alias("_positives"))
    added = ("_rows", "_n", "_sum", "_squares", "_labels", "_positives")
    return out.groupBy("axis", "value", "in_group", "score").agg(*(F.sum(c).alias(c) for c in added))


def test(records: DataFrame, tests: list[tuple[str, str]], cfg: Config = DEFAULT, with_p: bool = True, least: int = 3) -> DataFrame:
    """Pooled two-sample t-test of the confidence, and the AUC of both sides, for each (axis, value).

    Groups of under five records, null scores counted, are an error; an AUC needs `least` positives and as many others. with_p adds
    p_value and significant. All comes from the sides by score, a row for each distinct score of a side.
    """
    below = W.partitionBy("axis", "value", "in_group").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    negatives = F.col("_labels") - F.col("_positives")
    rows = sides(records, tests, cfg).withColumn("_less", F.coalesce(F.sum(negatives).over(below), F.lit(0)))
    rows = rows.withColumn("_won", F.col("_positives") * (2 * F.col("_less") + negatives))
    on = lambda c, s: F.sum(F.when(F.col("in_group") if s == "a" else ~F.col("in_group"), F.col(c)))
    out = rows.groupBy("axis", "value").agg(*(F.coalesce(on(c, s), F.lit(0)).alias(f"{c}{s}") for s in "ab" for c in ("_rows", "_n", "_sum", "_squares", "_labels", "_positives", "_won")))
    for s in "ab":
        n, total = F.col(f"_n{s}"), F.col(f"_sum{s}")
        out = out.withColumns({f"_m{s}": F.when(n > 0, total / n), f"_v{s}": F.when(n > 1, F.greatest(F.col(f"_squares{s}") - total * total / n, F.lit(0.0)) / (n - 1))})
    degrees = F.col("_na") + F.col("_nb") - 2
    pooled = ((F.col("_na") - 1) * F.col("_va") + (F.col("_nb") - 1) * F.col("_vb")) / F.when(degrees > 0, degrees)
    scale = F.sqrt(pooled * (F.lit(1.0) / F.nullif("_na", F.lit(0)) + F.lit(1.0) / F.nullif("_nb", F.lit(0))))
    apart = F.col("_ma") - F.col("_mb")
    out = out.withColumns({"_t": F.when(scale > 0, apart / scale).when(apart != 0, F.lit(float("inf")) * F.signum(apart)), "_d": degrees.cast("double")})
    enough = (F.col("_rowsa") >= 5) & (F.col("_rowsb") >= 5)
    value = lambda c: F.when(enough, c)

    def auc(s: str) -> Column:
        p, rest = F.col(f"_positives{s}"), F.col(f"_labels{s}") - F.col(f"_positives{s}")
        return F.when((p >= least) & (rest >= least), F.round(F.col(f"_won{s}").cast("double") / (F.lit(2.0) * p * rest), 4))

    columns = [
        "axis", "value", F.col("_rowsa").alias("n_group"), F.col("_rowsb").alias("n_rest"), value(F.round("_ma", 4)).alias("mean_conf_group"), value(F.round("_mb", 4)).alias("mean_conf_rest"),
        value(F.when(F.col("_ma") < F.col("_mb"), "lower").otherwise("higher")).alias("direction"), value(F.round("_t", 4)).alias("t_statistic"),
        value(auc("a")).alias("mel_auc_group"), value(auc("b")).alias("mel_auc_rest"), F.when(~enough, "not enough samples").alias("error"),
    ]
    if with_p:
        out = out.withColumn("_p", F.when(enough, stats.p_value(F.col("_t"), F.col("_d"))))
        columns += [F.round("_p", 4).alias("p_value"), (F.col("_p") < 0.05).alias("significant")]
    return out.select(*columns)


def answer(questions: DataFrame, records: DataFrame, cfg: Config = DEFAULT, patterns=HYPOTHESES) -> DataFrame:
    """Questions with their axis, value and the result of the test; the tests are those of the patterns, not one a question."""
    tests = list(dict.fromkeys((a, v) for _, a, v in patterns))
    return parse(questions, patterns=patterns).join(test(records, tests, cfg), ["axis", "value"], "left")
