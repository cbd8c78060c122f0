"""Column functions: everything that works on one row, as built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, FULL_NAMES, HYPOTHESES, ICD10, ICD10_DEFAULT, SNOMED, TREATMENTS, Config


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def lookup(key: Column | str, table: dict) -> Column:
    """table[key]; null for a key that it lacks."""
    pairs = [x for k, v in table.items() if v is not None for x in (F.lit(k), strings(v) if isinstance(v, list) else F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), col(key))


# probabilities


def softmax(logits: Column | str, temperature: float = 1.0) -> Column:
    """Probabilities of an array of logits divided by the temperature, shifted by their maximum; for one use in a row.
    score.with_softmax does the same in steps that stay in generated code."""
    powers = F.transform(logits, lambda x: F.exp((x.cast("double") - F.array_max(logits)) / F.lit(temperature)))
    halves = F.transform(F.array(powers), lambda e: F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, x: a + x).alias("s")))
    return F.flatten(F.transform(halves, lambda h: F.transform(h["e"], lambda x: x / h["s"])))


def first_max(values: Column | str, names) -> Column:
    """Name of the largest value; of equal ones the first."""
    return F.get(strings(names), (F.array_position(values, F.array_max(values)) - 1).cast("int"))


def confidence_score(probs: Column | str) -> Column:
    return F.round(F.array_max(probs) * 10, 2)


def prob_map(probs: Column | str, names) -> Column:
    return F.map_from_arrays(strings(names), F.transform(probs, lambda p: F.round(p, 4)))


def top_gap(probs: Column | str) -> Column:
    """Largest minus second largest; 1 if there are fewer than two."""
    ordered = F.sort_array(probs, asc=False)
    return F.when(F.size(probs) < 2, F.lit(1.0)).otherwise(F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1)))


def entropy(probs: Column | str) -> Column:
    """-sum p ln p over p > 0."""
    return F.aggregate(F.filter(probs, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log(p))


def ranked(probs: Column | str) -> Column:
    """Entries of a class -> probability map, the most probable first, then by class."""
    entries = F.transform(F.map_entries(probs), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("key"), e["value"].alias("value")))
    return F.transform(F.array_sort(entries), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


# decisions


def qa_flag(probs: Column | str, pred: Column | str, label: Column | str, cfg: Config = DEFAULT) -> Column:
    """Conflict with a label at high confidence, else ambiguous, else low confidence, else OK. An empty label is none."""
    has = F.coalesce(F.length(label) > 0, F.lit(False))
    conflict = has & (col(label) != col(pred)) & (confidence_score(probs) >= cfg.conflict_score)
    out = F.when(col(probs).isNull(), "ERROR").when(conflict, "ANNOTATION_CONFLICT").when(top_gap(probs) * 10 < cfg.ambiguous_gap, "AMBIGUOUS")
    return out.when(F.array_max(probs) < cfg.floor, "LOW_CONFIDENCE").otherwise("OK")


def verdict(pred: Column | str, positive: Column, confidence: Column, cfg: Config = DEFAULT) -> Column:
    """struct(verdict, priority) from unrounded values."""
    made = lambda v, p: F.struct(F.lit(v).alias("verdict"), p.alias("priority"))
    urgent = F.when((col(pred) == cfg.positive) | (positive > cfg.positive_urgent), 1).otherwise(2)
    flagged = col(pred).isin(*cfg.cancer) | (positive >= cfg.positive_flag)
    review = col(pred).isin(*cfg.review) | (confidence < cfg.floor)
    return F.when(flagged, made("CANCER_FLAGGED", urgent)).when(review, made("REVIEW_REQUIRED", F.lit(3))).otherwise(made("NORMAL", F.lit(4)))


def full_name(pred) -> Column:
    return lookup(pred, FULL_NAMES)


def icd10(pred) -> Column:
    return F.coalesce(lookup(pred, ICD10), F.lit(ICD10_DEFAULT))


def snomed(pred) -> Column:
    return lookup(pred, SNOMED)


def treatments(pred) -> Column:
    return F.coalesce(lookup(pred, TREATMENTS), F.array().cast("array<string>"))


def plain_summary(verdict: Column | str, pred: Column | str, confidence: Column | str) -> Column:
    words = F.initcap(F.replace(col(verdict), F.lit("_"), F.lit(" ")))
    return F.format_string("%s — %s detected with %.1f%% confidence.", words, full_name(pred), col(confidence) * 100)


# curation


def remap(label: Column | str, table: dict) -> Column:
    """Unified label; null if the raw one is unknown or stands for dropping."""
    return lookup(label, table)


def onehot_label(names) -> Column:
    """Name of the first largest of the class columns; null where none is above 0."""
    values = F.array(*(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names))
    return F.when(F.array_max(values) > 0, first_max(values, names))


def diagnosis_key(c: Column | str) -> Column:
    return F.replace(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(" "), F.lit("_"))


def diagnosis_label(diagnosis: Column | str, target: Column | str, table: dict) -> Column:
    """The mapped diagnosis; by target 1 or 0 if the table lacks it; null if it is mapped to nothing."""
    key = diagnosis_key(diagnosis)
    known = key.isin(*table)
    return F.when(known, lookup(key, table)).when(col(target) == 1, "MEL").when(col(target) == 0, "NV")


def class_index(label: Column | str, names) -> Column:
    """Number of a label from 0; null if unknown."""
    at = F.array_position(strings(names), col(label))
    return F.when(at > 0, (at - 1).cast("int"))


def age_band(age: Column | str) -> Column:
    """Right-closed bands from 0 to 120; null outside."""
    a = col(age)
    return F.when(a <= 0, None).when(a <= 30, "<30").when(a <= 45, "30-45").when(a <= 60, "45-60").when(a <= 75, "60-75").when(a <= 120, "75+")


# text


def clean_name(name: Column | str) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def base_name(path: Column | str) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def keyword_hits(text: Column | str, words) -> Column:
    """How many of the words stand anywhere in the lower-cased text."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return reduce(lambda a, b: a + b, (F.contains(low, F.lit(w)).cast("int") for w in words))


def relevance(title: Column | str, abstract: Column | str, words) -> Column:
    text = F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.coalesce(col(abstract), F.lit("")))
    return F.round(keyword_hits(text, words) / F.lit(float(len(words))), 3)


def excerpt(text: Column | str, n: int = 300) -> Column:
    return F.substring(text, 1, n)


def title_key(title: Column | str, n: int = 60) -> Column:
    return F.substring(F.lower(title), 1, n)


def patient_key(lesion: Column | str, image: Column | str) -> Column:
    """The lesion id, or the image where there is none, so unknown patients stay apart."""
    return F.coalesce(F.nullif(col(lesion), F.lit("")), col(image))


def intent(question: Column | str, data, knowledge) -> Column:
    return F.when(keyword_hits(question, data) >= keyword_hits(question, knowledge), "data").otherwise("knowledge")


def hypothesis(question: Column | str, patterns=HYPOTHESES) -> Column:
    """struct(axis, value) of the first pattern that the lower-cased question matches; null if none does."""
    low = F.lower(question)
    return F.coalesce(*(F.when(F.rlike(low, F.lit(p)), F.struct(F.lit(a).alias("axis"), F.lit(v).alias("value"))) for p, a, v in patterns))


def messages(*rules: tuple[Column, Column | str]) -> Column:
    """Messages whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(c, m if isinstance(m, Column) else F.lit(m)) for c, m in rules)))
