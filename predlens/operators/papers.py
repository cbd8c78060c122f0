"""Papers: relevance by keywords, one row a title, the best first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import PAPER_KEYWORDS
from ..functions import columns as C
from .curate import first_wins


def union(*feeds: DataFrame) -> DataFrame:
    """Feeds with different fields, and the place of a feed as feed_no."""
    out = None
    for i, feed in enumerate(feeds):
        feed = feed.withColumn("feed_no", F.lit(i))
        out = feed if out is None else out.unionByName(feed, allowMissingColumns=True)
    return out


def with_relevance(papers: DataFrame, keywords=PAPER_KEYWORDS) -> DataFrame:
    return papers.withColumn("relevance", C.relevance("title", "abstract_excerpt", keywords))


def first_by_title(papers: DataFrame, *order: str) -> DataFrame:
    """The first paper of each title by its first sixty characters, lower-cased; papers without a title go."""
    keyed = papers.where(F.length("title") > 0).withColumn("title_key", C.title_key("title"))
    return first_wins(keyed, "title_key", *order)


def rank(papers: DataFrame, *order: str, keywords=PAPER_KEYWORDS, n: int = 20) -> DataFrame:
    """The n most relevant papers, each title once."""
    return with_relevance(first_by_title(papers, *order), keywords).orderBy(F.desc("relevance"), *order).limit(n)


def totals(papers: DataFrame) -> DataFrame:
    return papers.agg(F.count(F.lit(1)).alias("total"), F.countDistinct(C.title_key("title")).alias("unique"), F.countDistinct("query").alias("queries"))


def first_by_window(papers: DataFrame, window: str = "window", *order: str) -> DataFrame:
    """The first paper of each title within each window, by the order; one aggregate, so a stream keeps a row for each title of a
    window. Papers without a title go."""
    keyed = papers.where(F.length("title") > 0).withColumn("title_key", C.title_key("title"))
    kept = [c for c in keyed.columns if c not in (window, "title_key")]
    out = keyed.groupBy(window, "title_key").agg(F.min_by(F.struct(*kept), F.struct(*order)).alias("first"))
    return out.select(window, "first.*")


def rank_within(papers: DataFrame, by: str, *order: str, keywords=PAPER_KEYWORDS, n: int = 20) -> DataFrame:
    """The n most relevant papers of each group, with rank from 1. Ranked in parts of a group first, so no group meets in one task."""
    scored = with_relevance(papers, keywords).withColumn("_part", F.pmod(F.xxhash64("title"), F.lit(32)))
    down = (F.desc("relevance"), *(F.asc(c) for c in order))
    some = scored.withColumn("rank", F.row_number().over(W.partitionBy(by, "_part").orderBy(*down))).where(F.col("rank") <= n)
    return some.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*down))).where(F.col("rank") <= n).drop("_part")
