"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents and unlabelled ones train linear numpy classifiers on words and beginnings of words. Their risk is estimated from both
sets and the class prior: prior * loss(toxic as toxic) + max(0, loss(unlabelled as clean) - prior * loss(toxic as clean)).
Where a batch's second part falls below zero, the step goes against it, so the classifier can't fit the unlabelled away.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, held_out, map_rows, per_worker, save

#: Most confirmed and unlabelled documents that are learned from; classifiers; the score from which a document is toxic; the highest prior.
POSITIVE, UNLABELLED, MODELS, LIMIT, MOST_PRIOR = 4000, 12000, 3, 0.3, 0.5
#: Most candidates for features, the most frequent ones; least number and share of confirmed documents that have one, and how many
#: times as frequent it must be among them as among the unlabelled.
CANDIDATES, LEAST, LEAST_SHARE, LIFT = 50_000, 4, 0.005, 4
#: Beginnings of longer words, in characters, that are features too; each also by whether it comes so often in a text. Words
#: that a worker keeps looked up.
PREFIXES, TIMES, KEPT = (5, 6, 7), (1, 2, 4), 500_000
EPOCHS, BATCHES, RATE, SHRINK = 40, 8, 0.05, 1e-4
words_of = re.compile(r"\w+").findall


def parts(word: str) -> list[str]:
    """A word and its beginnings, which are marked by a star."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


class Features:
    """Finds the features of texts: "name#n" is a word or beginning that comes n times or more."""

    def __init__(self, names: list[str] | None):
        self.number = None if names is None else {f: i for i, f in enumerate(names)}
        self.wanted = None if names is None else {f.rpartition("#")[0] for f in names}
        self.found: dict[str, list[str]] = {}

    def of(self, text: str | None) -> list:
        """Names of all features of a text, or numbers of those given, in order."""
        bag: dict[str, int] = {}
        if len(self.found) > KEPT:
            self.found.clear()
        found, wanted = self.found, self.wanted
        for word, n in Counter(words_of(text.lower())).items() if text else ():
            own = found.get(word)
            if own is None:
                own = found[word] = [p for p in parts(word) if wanted is None or p in wanted]
            for p in own:
                bag[p] = bag.get(p, 0) + n
        names = [f"{p}#{k}" for p, n in bag.items() for k in TIMES if n >= k]
        return names if self.number is None else sorted(self.number[f] for f in names if f in self.number)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def risk(w: np.ndarray, p, u, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The clean part of the risk of a batch, and the gradients of the toxic and of the clean part. A batch is (feature numbers,
    row of each, number of rows)."""
    n = len(w) - 1
    zp, zu = (np.bincount(m[1], w[m[0]], m[2]) + w[n] for m in (p, u))
    gradient = lambda m, each: np.append(np.bincount(m[0], each[m[1]], n), each.sum())
    clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    as_clean = gradient(u, sigmoid(zu) / u[2]) - prior * gradient(p, sigmoid(zp) / p[2])
    return clean, prior * gradient(p, (sigmoid(zp) - 1) / p[2]), as_clean


def matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    return np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], n: int, prior: float, seed: int) -> np.ndarray:
    """n weights and a bias, from documents as lists of feature numbers; logistic loss, Adam steps."""
    rng = np.random.default_rng(seed)
    w = np.zeros(n + 1)
    w[n] = np.log(prior / (1 - prior))
    mean, square, t = np.zeros(n + 1), np.zeros(n + 1), 0
    for _ in range(EPOCHS):
        for p_at, u_at in zip(np.array_split(rng.permutation(len(positive)), BATCHES), np.array_split(rng.permutation(len(unlabelled)), BATCHES), strict=True):
            if not len(p_at) or not len(u_at):
                continue
            clean, toxic, as_clean = risk(w, matrix([positive[i] for i in p_at]), matrix([unlabelled[i] for i in u_at]), prior)
            g = toxic + as_clean if clean >= 0 else -as_clean
            g[:n] += SHRINK * w[:n]
            t += 1
            mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
            w -= RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> tuple[list[str], np.ndarray]:
    """Features and, for each classifier, their weights and a bias.

    Held-out documents and labels are left out. An id that is labelled more than once is toxic if any of its labels says so. The prior is the share of toxic
    ids among the labelled ones, MOST_PRIOR at most: beyond that unlabelled text would tell nothing about what is clean. The samples are the
    first by a hash of the id, bounded by POSITIVE and UNLABELLED whatever the size of the tables; a classifier is trained in
    one task on all confirmed and its share of the unlabelled ones. Equal texts are learned from once, so a table in another order gives
    the same classifiers.
    """
    spark = docs.sparkSession
    labels_known = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    labels_known = labels_known.groupBy(doc_id).agg(F.max((F.col(toxic) == 1).cast("int")).alias(toxic))
    prior = labels_known.agg(F.avg(F.col(toxic).cast("double"))).first()[0] or 0.0
    if prior <= 0:
        return [], np.zeros((0, 1))
    prior = min(prior, MOST_PRIOR)
    draw = F.xxhash64(doc_id, F.lit("fit"))
    some = lambda df, n: df.select(doc_id).distinct().orderBy(draw, doc_id).limit(n)
    texts = docs.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    ids = some(labels_known.where(F.col(toxic) == 1), POSITIVE).withColumn("kind", F.lit(1)).unionByName(some(texts, UNLABELLED).withColumn("kind", F.lit(0)))
    sample = texts.select(doc_id, text).join(F.broadcast(ids), doc_id).select("kind", F.xxhash64(text, F.lit("part")).alias("key"), F.col(text).alias("text"))
    sample, path = save(sample.distinct())  # by text alone, so neither copies nor the order of rows matter

    def frequencies(names=None):
        def make():
            of = Features(names and names.value).of

            def count(texts):
                found = Counter(names.value[f] if names else f for t in texts for f in of(t))
                return [list(found), list(found.values())]

            return count

        return make

    def counted(kind: int, name: str, names=None) -> DataFrame:
        found = map_rows(sample.where(F.col("kind") == kind).select("text"), frequencies(names), "word string, n long")
        return found.groupBy("word").agg(F.sum("n").alias(name))

    sizes = {r[0]: r[1] for r in sample.groupBy("kind").count().collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    often = counted(1, "p").where(F.col("p") >= max(LEAST, LEAST_SHARE * n_p)).orderBy(F.desc("p"), "word").limit(CANDIDATES).toPandas()
    sent = spark.sparkContext.broadcast(often["word"].tolist())  # at most CANDIDATES
    table = often.merge(counted(0, "u", sent).toPandas(), on="word", how="left").fillna({"u": 0})
    p, u = table["p"] / max(1, n_p), table["u"] / max(1, n_u)
    words = sorted(table.loc[p > LIFT * np.maximum(u, 1 / max(1, n_u)), "word"])
    sent = spark.sparkContext.broadcast(words)

    def features():
        of = Features(sent.value).of
        return lambda kinds, keys, texts: [kinds, keys, [of(t) for t in texts]]

    rows = map_rows(sample.select("kind", "key", "text"), features, "kind int, key long, features array<int>")
    models = F.array(*(F.lit(i) for i in range(MODELS)))
    rows = rows.withColumn("model", F.explode(F.when(F.col("kind") == 1, models).otherwise(F.array(F.pmod("key", F.lit(MODELS)).cast("int")))))
    n = len(words)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(size=pdf["features"].map(len)).sort_values(["key", "kind", "size"], kind="stable")
        p, u = ([np.asarray(f, np.int64) for f in pdf.loc[pdf["kind"] == k, "features"]] for k in (1, 0))
        return pd.DataFrame({"model": [key[0]], "w": [train(p, u, n, prior, int(key[0])).tolist()]})

    weights = rows.groupBy("model").applyInPandas(one, "model int, w array<double>").orderBy("model").collect()
    discard(spark, path)
    return words, np.array([r["w"] for r in weights])


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> DataFrame:
    """One row per input row: doc_id, held_out, score (mean probability of the classifiers), predicted (1 from LIMIT on).

    A null or empty text has no words and gets the score of the bias. Without a toxic label to learn from all scores are 0.
    Very long texts are read whole; equal texts, and so repeated rows, get equal scores; a null id is not held out; other columns are
    not read; no rows give no rows.
    """
    words, weights = fit(docs, labels, doc_id, text, toxic)
    sent = docs.sparkSession.sparkContext.broadcast((words, weights))
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    own = uuid.uuid4().hex

    def make():
        words, weights = sent.value
        of, bias = per_worker(own, lambda: Features(words)).of, weights[:, -1]

        def rows(ids, held, texts):
            out = []
            for t in texts:
                out.append(float(sigmoid(weights[:, of(t)].sum(axis=1) + bias).mean()) if len(bias) else 0.0)
            return [ids, held, out, [int(s >= LIMIT) for s in out]]

        return rows

    return map_rows(docs.select(doc_id, held_out(doc_id).alias("held_out"), text), make, "doc_id " + kind + ", held_out boolean, score double, predicted int", text)
