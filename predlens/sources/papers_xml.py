"""Landed paper XML by a table function: good records, and those that are rejected with the reason.

Files are split at the end of a record by Spark's text reader, so a large file is many tasks' work and is never held whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ARTICLE, ENTRY = "PubmedArticle", "entry"
FIELDS = "pmid string, title string, journal string, year string, abstract_excerpt string, url string, error string, record string"
#: Characters of an abstract that a paper carries, and of a rejected record that its reject carries.
EXCERPT, SHOWN = 300, 2000


def _text(node: ElementTree.Element, path: str) -> str | None:
    found = node.find(path)
    return None if found is None else "".join(found.itertext())


def article(node: ElementTree.Element) -> tuple:
    pmid, body = _text(node, "MedlineCitation/PMID"), "MedlineCitation/Article"
    url = None if pmid is None else f"https://pubmed.ncbi.nlm.nih.gov/{pmid}/"
    return pmid, _text(node, f"{body}/ArticleTitle"), _text(node, f"{body}/Journal/Title"), _text(node, f"{body}/Journal/JournalIssue/PubDate/Year"), (_text(node, f"{body}/Abstract/AbstractText") or "")[:EXCERPT], url


def entry(node: ElementTree.Element) -> tuple:
    clean = lambda c: None if (t := _text(node, c)) is None else " ".join(t.split())
    return None, clean("title"), None, None, (clean("summary") or "")[:EXCERPT], _text(node, "id")


def _without_space(node: ElementTree.Element) -> ElementTree.Element:
    """Tags without their name space."""
    for e in node.iter():
        e.tag = e.tag.rpartition("}")[2]
    return node


class PapersOf:
    """eval(text up to the end of a record, its tag): a row for each record that begins there. The last one ends there; an earlier one has no
    end and is rejected, as is one that is no XML or has no title."""

    def eval(self, text: str, tag: str) -> Iterator[tuple]:
        begins = [i for i in _places(text, f"<{tag}") if text[i + len(tag) + 1 : i + len(tag) + 2] in (">", " ", "\t", "\n", "\r")]
        for i, begin in enumerate(begins):
            last = i == len(begins) - 1
            record = text[begin:] + f"</{tag}>" if last else text[begin : begins[i + 1]]
            paper, error = (None,) * 6, "the record has no end"
            if last:
                try:
                    paper, error = (article if tag == ARTICLE else entry)(_without_space(ElementTree.fromstring(record))), None
                except ElementTree.ParseError as e:
                    error = f"no XML: {e}"
                if error is None and not paper[1]:
                    error = "no title"
            yield *paper, error, record[:SHOWN] if error else None


def _places(text: str, part: str) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def _records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    # a truncated file's rest is a record without an end, which is no XML unless only the end is missing
    texts = spark.read.option("lineSep", f"</{tag}>").text(path).where(F.col("value").contains(f"<{tag}"))
    made = F.udtf(PapersOf, returnType=StructType.fromDDL(FIELDS))
    return texts.lateralJoin(made(F.col("value").outer(), F.lit(tag))).select(*(c.split(" ")[0] for c in FIELDS.split(", ")))


def read(spark: SparkSession, path: str, query: str = "", tag: str = ARTICLE) -> tuple[DataFrame, DataFrame]:
    """Papers of article XML or of an Atom feed (tag=ENTRY), and the rejects: error, the reason, and the record's beginning."""
    rows = _records(spark, path, tag)
    source = "pubmed" if tag == ARTICLE else "arxiv"
    papers = rows.where("error IS NULL").select(F.lit(source).alias("source"), "pmid", "title", "journal", "year", "abstract_excerpt", "url", F.lit(query).alias("query"))
    return papers, rows.where("error IS NOT NULL").select("error", "record")
