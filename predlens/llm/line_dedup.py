"""Line dedup by overlapping three-line windows, in DataFrame functions only.

A window is three consecutive lines that are not all blank; blank lines (spaces only) are equal to each other. Of equal
windows anywhere in the table the first counts, by document id and line number; the lines that any later one covers go.
What two later windows cover together goes once, so runs of repeated windows merge. Each line that goes has an equal
line at an earlier place, so some first place of every line stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, save

#: Lines of a window; parts that the places of a common window are dealt to.
WINDOW, SALTS = 3, 8
#: Size, estimated, of the places to cut up to which they are sent to every task; above it both sides are sorted and merged.
SENT_BYTES = 16_000_000


def _windows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, copy (hash of the text), at (line number), h1, h2 for every window: each line is hashed twice, and so is the window."""
    lines = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("doc"),
        F.xxhash64(text).alias("copy"),
        F.transform(F.split(text, "\n", -1), lambda x: F.when(F.trim(x) == "", "").otherwise(x)).alias("lines"),
    ).select(
        "doc",
        "copy",
        F.transform("lines", lambda x: F.when(x == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x))).alias("h"),
        F.transform("lines", lambda x: F.xxhash64(F.lit("second"), x)).alias("g"),
    )
    count = F.size("h") - (WINDOW - 1)
    parts = [F.slice(c, i + 1, F.greatest(count, F.lit(0))) for c in ("h", "g") for i in range(WINDOW)]
    rows = lines.where(count > 0).select("doc", "copy", F.posexplode(F.arrays_zip(*(p.alias(f"l{i}") for i, p in enumerate(parts)))).alias("at", "w"))
    each = [F.col("w")[n] for n in rows.schema["w"].dataType.names]
    some = each[0] != 0
    for c in each[1:WINDOW]:
        some = some | (c != 0)
    return rows.where(some).select("doc", "copy", "at", F.xxhash64(*each[:WINDOW]).alias("h1"), F.xxhash64(*each[WINDOW:]).alias("h2"))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text's kept lines, and two more columns: n_lines and n_removed.

    Null text: stays null, no lines. Empty text: one blank line, stays. Under three lines, or a null id: stays as it is.
    Rows with one id and equal texts are one place, so neither removes lines of the other. A document whose lines all go
    has an empty text. Very long texts are treated whole, other columns stay as they are, no rows give no rows. A document's line
    numbers come together in one row, as its text does; equal windows never do: their places are dealt to SALTS parts.
    """
    n_lines, n_removed, key, copy, starts, lines, kept = fresh(docs, "n_lines", "n_removed", "_doc", "_copy", "_starts", "_lines", "_kept")
    spark = docs.sparkSession
    windows, path = save(_windows(docs, doc_id, text))
    place = F.struct("doc", "copy", "at")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select("h1", "h2", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = windows.withColumn("salt", F.pmod(F.xxhash64("doc", "at"), F.lit(SALTS)).cast("int"))
    later = dealt.join(first, ["h1", "h2", "salt"]).where(place != F.col("first"))
    by_doc, _ = save(later.groupBy(F.col("doc").alias(key), F.col("copy").alias(copy)).agg(F.collect_set("at").alias(starts)))
    discard(spark, path)
    n, places = by_doc.agg(F.count(F.lit(1)), F.sum(F.size(starts))).first()
    by_doc = F.broadcast(by_doc) if 48 * n + 8 * (places or 0) <= SENT_BYTES else by_doc.hint("merge")
    joined = docs.join(by_doc, (docs[doc_id] == by_doc[key]) & (F.xxhash64(docs[text]) == by_doc[copy]), "left")
    covered = F.flatten(F.transform(starts, lambda p: F.array(*(p + i for i in range(WINDOW)))))
    size = F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0))
    done = joined.withColumn(lines, F.when(F.col(starts).isNotNull(), F.split(text, "\n", -1)))
    done = done.withColumn(kept, F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered))
    clean = F.when(F.col(starts).isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col(lines), i)), "\n"))
    gone = F.when(F.col(starts).isNull(), 0).otherwise(F.size(lines) - F.size(kept))
    return done.select(
        *(clean.alias(c) if c == text else docs[c] for c in docs.columns),
        F.when(F.col(text).isNull(), 0).otherwise(size).cast("long").alias(n_lines),
        gone.cast("long").alias(n_removed),
    )


ORACLE = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
y AS (SELECT doc_id, pos, line, CASE WHEN trim(line) = '' THEN '' ELSE line END AS a FROM x),
z AS (SELECT doc_id, pos, a, lead(a) OVER p AS b, lead(a, 2) OVER p AS c FROM y WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
w AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth FROM z
      WHERE c IS NOT NULL AND (a <> '' OR b <> '' OR c <> '')),
gone AS (SELECT DISTINCT doc_id, pos + i AS pos FROM w, (VALUES (0), (1), (2)) AS o(i) WHERE nth > 1),
kept AS (SELECT y.doc_id, string_agg(y.line, chr(10) ORDER BY y.pos) AS text, count(*) AS n
         FROM y LEFT JOIN gone g ON g.doc_id = y.doc_id AND g.pos = y.pos WHERE g.pos IS NULL GROUP BY y.doc_id)
SELECT o.doc_id, CASE WHEN o.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(len(d.l), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(d.l), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed
FROM documents o LEFT JOIN d ON d.doc_id = o.doc_id LEFT JOIN kept k ON k.doc_id = o.doc_id
"""
