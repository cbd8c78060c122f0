"""Helpers shared by the operators of this subpackage: shared-folder tables, and Arrow maps over whole texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Bytes of text handed to one call of a map function; a longer text is a slice of its own.
SLICE_BYTES = 1_000_000


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one of a local session; on a
    cluster that would lose data, so it is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="predlens-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def save(df: DataFrame) -> tuple[DataFrame, str]:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends here and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/predlens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of save() that no pending plan reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., list[list]]], schema: str | StructType, text: str | None = "text") -> DataFrame:
    """Maps slices of rows in Arrow batches. make() runs once per task and returns f(*columns) -> list of result columns.

    Slices hold about SLICE_BYTES bytes of the column named by text, so a batch of very long texts is not
    unpacked at once. Columns come as Python lists with None for null.
    """
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)
    at = df.columns.index(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            n, begin = batch.num_rows, 0
            step = n
            if at is not None and n:
                step = max(1, int(n * SLICE_BYTES / max(1, batch.column(at).nbytes)))
            while begin < n:
                part = batch.slice(begin, step)
                begin += step
                columns = f(*(part.column(i).to_pylist() for i in range(part.num_columns)))
                yield pa.RecordBatch.from_arrays([pa.array(v, type=t.type) for v, t in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, kind)


_MADE: dict = {}


def per_worker(key: str, make: Callable):
    """make() once for a key in each Python worker, whose tasks then share what it keeps; the last key's value only."""
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = make()
    return _MADE[key]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that df has no column of (case-insensitive): extra columns of the caller never clash."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: str) -> "F.Column":
    """True for the fourth of documents whose labels no model may see: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
