"""Scoring: logits to probabilities, verdicts, codes and exports; and batch scoring with a model of the caller's."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..config import DEFAULT, Config
from ..functions import columns as C


def with_softmax(df: DataFrame, logits: str, k: int, temperature: float = 1.0, out: str = "probs") -> DataFrame:
    """Adds probabilities of k logits.

    In three projections, each of which the next uses more than once, so the optimizer keeps them apart and every exponential
    is computed once, in generated code. The generator of one row ends the reach of filters on what is derived from the
    probabilities: pushed below, they would compute them anew at each use.
    """
    i = range(k)
    steps = df.withColumn("_m", F.array_max(logits))
    steps = steps.withColumn("_e", F.array(*(F.exp((F.get(logits, F.lit(j)).cast("double") - F.col("_m")) / F.lit(temperature)) for j in i)))
    steps = steps.withColumn("_s", reduce(lambda a, b: a + b, (F.get("_e", F.lit(j)) for j in i)))
    steps = steps.withColumn("_p", F.array(*(F.get("_e", F.lit(j)) / F.col("_s") for j in i)))
    return steps.select(*(c for c in df.columns if c != out), F.explode(F.array("_p")).alias(out))


def predict(df: DataFrame, logits: str = "logits", temperature: float = 1.0, cfg: Config = DEFAULT) -> DataFrame:
    """Adds probs (array), pred_class, confidence_score (0 to 10) and mel_prob (of the positive class, 4 digits)."""
    at = cfg.classes.index(cfg.positive)
    out = with_softmax(df, logits, len(cfg.classes), temperature)
    return out.withColumns({"pred_class": C.first_max("probs", cfg.classes), "confidence_score": C.confidence_score("probs"), "mel_prob": F.round(F.get("probs", F.lit(at)), 4)})


def triage(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Adds verdict, priority and what a scan result reports, from probs and pred_class."""
    at = cfg.classes.index(cfg.positive)
    positive, top = F.get("probs", F.lit(at)), F.array_max("probs")
    out = df.withColumn("_v", C.verdict("pred_class", positive, top, cfg)).withColumns({"verdict": F.col("_v.verdict"), "priority": F.col("_v.priority")}).drop("_v")
    return out.withColumns({"confidence": F.round(top, 4), "mel_score": F.round(positive, 4), "cancer_prob": F.round(F.get("probs", F.lit(0)), 4)})


def with_codes(df: DataFrame, pred: str = "pred_class") -> DataFrame:
    """Adds full name, diagnosis codes and treatments: fixed tables of a few rows, folded into the expression."""
    return df.withColumns({"pred_class_full": C.full_name(pred), "icd10": C.icd10(pred), "snomed": C.snomed(pred), "treatment_recs": C.treatments(pred)})


def scan_results(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Everything a scan result holds but ids and times: verdict, codes, summary and the probabilities as a map."""
    out = with_codes(triage(df, cfg))
    return out.withColumns({"plain_summary": C.plain_summary("verdict", "pred_class", F.array_max("probs")), "probs": C.prob_map("probs", cfg.classes)})


def to_fhir(scans: DataFrame, title: str = "Dermoscopy AI analysis", extension: str = "urn:melanoma-score") -> DataFrame:
    """scan_id and the scan as a DiagnosticReport in JSON."""
    code = F.struct(F.lit("http://hl7.org/fhir/sid/icd-10").alias("system"), F.coalesce("icd10", F.lit("L98.9")).alias("code"), F.coalesce("pred_class_full", F.lit("")).alias("display"))
    report = F.struct(
        F.lit("DiagnosticReport").alias("resourceType"),
        F.col("scan_id").alias("id"),
        F.lit("final").alias("status"),
        F.struct(F.lit(title).alias("text")).alias("code"),
        F.format_string("%s: %s (%.1f%%)", "verdict", "pred_class_full", F.coalesce("confidence", F.lit(0.0)) * 100).alias("conclusion"),
        F.array(F.struct(F.array(code).alias("coding"))).alias("conclusionCode"),
        F.col("timestamp").cast("string").alias("issued"),
        F.array(F.struct(F.lit(extension).alias("url"), F.col("mel_score").alias("valueDecimal"))).alias("extension"),
    )
    return scans.select("scan_id", F.to_json(report).alias("report"))


def within_size(files: DataFrame, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Files up to the size limit, and the rejects with a reason."""
    fits = F.col("length") <= cfg.max_bytes
    return files.where(fits), files.where(~fits).withColumn("error", F.lit("file too large"))


def score_batch(df: DataFrame, make_predict_fn, inputs: list[str], batch_size: int = 64, cfg: Config = DEFAULT, shapes: list[list[int] | None] | None = None) -> DataFrame:
    """Logits by a model of the caller's, in Arrow batches; make_predict_fn loads it once in a worker, shapes are those of array inputs.

    A row with a null input, or whose logits are missing or not finite, becomes an error row and the batch goes on. The input is read
    once: in place of a null the model gets zeros of the shape, and what it makes of them is dropped.
    """
    run = predict_batch_udf(make_predict_fn, return_type=ArrayType(DoubleType()), batch_size=batch_size, input_tensor_shapes=shapes)

    def filled(c: str, shape: list[int] | None) -> Column:
        kind = df.schema[c].dataType
        if isinstance(kind, ArrayType):
            return F.coalesce(F.col(c), F.array_repeat(F.lit(0).cast(kind.elementType), reduce(lambda a, b: a * b, shape or [1])))
        return F.coalesce(F.col(c), F.lit("").cast(kind) if kind.typeName() in ("string", "binary") else F.lit(0).cast(kind))

    there = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in inputs))
    out = df.withColumn("logits", run(*(filled(c, s) for c, s in zip(inputs, shapes or [None] * len(inputs), strict=True))))
    out = out.withColumn("logits", F.when(there, F.col("logits")))
    good = (F.size("logits") == len(cfg.classes)) & ~F.exists("logits", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = out.withColumn("error", F.when(~F.coalesce(good, F.lit(False)), "no prediction"))
    return out.withColumn("logits", F.when(F.col("error").isNull(), F.col("logits")))
