"""The QA pipeline: ordered stages over one written table of records, with a run log."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import DEFAULT, Config
from ..operators import active, calibrate, drift, fairness, hypothesis, ingest_qc, papers, qa
from ..sources.io import append_run, claim, exists, run_log, shared_dir

Stage = Callable[[dict[str, DataFrame]], DataFrame]


def next_run(spark: SparkSession, name: str, log: str) -> int:
    """Number of an agent's next run, by its lines in the run log; claimed by an empty file beside the log, which only one of two runs at
    once can make, so the other takes the next number."""
    n = run_log(spark, log).where(F.col("agent") == name).count() + 1 if exists(spark, log) else 1
    while not claim(spark, f"{log.rstrip('/')}-runs/{name}/{n}"):
        n += 1
    return n


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_stage(spark: SparkSession, name: str, stage: Stage, tables: dict[str, DataFrame], log: str | None = None) -> DataFrame | None:
    """Executes a stage: its rows are written to the shared folder and read back. Then appends a line to the run log, whether it
    succeeded or not, and gives its table, or None after an error."""
    out, status, error, began = None, "success", None, time.time()
    try:
        out = written(stage(tables))
    except Exception as e:
        status, error = "error", str(e)[:500]
    if log:
        count = next_run(spark, name, log)
        line = [(name, count, datetime.now(UTC).replace(tzinfo=None), status, error, f'{{"elapsed_s": {time.time() - began:.3f}}}')]
        append_run(spark.createDataFrame(line, schemas.RUN_LOG), log)
    return out


def stages(cfg: Config = DEFAULT, tests: list[tuple[str, str]] | None = None, with_papers: bool = False) -> dict[str, Stage]:
    """The monitors by name, in order; the last two are optional."""
    out: dict[str, Stage] = {
        "verification": lambda t: qa.flag_counts(t["records"], ["batch_id"]),
        "active_learning": lambda t: active.queue(active.uncertainty(t["records"])),
        "drift": lambda t: drift.report(t["records"], ["batch_id"], cfg),
        "fairness": lambda t: fairness.by_axes(t["records"], cfg=cfg),
        "calibration": lambda t: calibrate.report(t["records"], cfg=cfg),
    }
    if tests:
        out["hypothesis"] = lambda t: hypothesis.test(t["records"], tests, cfg)
    if with_papers:
        out["literature"] = lambda t: papers.rank(t["papers"], "title")
    return out


def run(records: DataFrame, log: str | None = None, files: DataFrame | None = None, cfg: Config = DEFAULT, plan: dict[str, Stage] | None = None, extra: dict[str, DataFrame] | None = None) -> dict[str, DataFrame | None]:
    """Tables of all stages. With checked files, records whose file would be removed are left out, and nothing runs if no file is
    ready. The records are written once for the branches, each of which reads its own columns of them, in splits of any number."""
    spark, out = records.sparkSession, {}
    if files is not None:
        out["ingest"] = ingest_qc.report(files)
        if out["ingest"].first()["ready_count"] == 0:
            return out
        records = ingest_qc.ready(records, files)
    records = written(records)
    tables = {"records": records, **(extra or {})}
    out["records"] = records
    for name, stage in (plan or stages(cfg)).items():
        out[name] = run_stage(spark, name, stage, tables, log)
    return out


def status(log: DataFrame) -> DataFrame:
    """A row for each agent: runs, last run, its status, and errors."""
    return log.groupBy("agent").agg(
        F.count(F.lit(1)).alias("runs"), F.max("timestamp").alias("last_run"), F.max_by("status", F.struct("timestamp", "run_count")).alias("last_status"), F.count_if(F.col("status") == "error").alias("errors")
    )
