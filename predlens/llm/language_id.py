"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of a public vocabulary. A word's probability is the sum over all ways of
cutting it into pieces, by the forward algorithm; a text's is the product over its words. Piece probabilities are learned
by expectation-maximisation on the words of labelled documents, again over all segmentations.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, held_out, map_rows, per_worker, save

#: Labelled documents of each language that are learned from, about; rounds of learning.
FIT_ROWS, ROUNDS = 800, 2
#: Scores that a worker keeps, one for each word and language; words that it keeps at least.
KEPT, LEAST_KEPT = 2_000_000, 10_000
#: Probability of a character that is no piece; what is added to a piece's count.
UNKNOWN, PRIOR = 1e-7, 0.05
MARK = "▁"
runs = re.compile(r"[^\W\d_]+").findall
#: A text of at least so many letters is in no known language if its mean log probability a letter is below that of letters drawn
#: evenly from an alphabet of this size.
LETTERS, ALPHABET = 20, 60


def letters(text: str) -> list[str]:
    """Words of a text: runs of letters in the sense of str.isalpha. The pattern's runs may hold other numeric characters, as ½."""
    found = runs(text)
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [w for f in found for w in "".join(c if c.isalpha() else " " for c in f).split()]


def pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece model that stand for text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
    found = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i)}
    return sorted(p for p in found if p)


class Lattice:
    """Sums over the segmentations of words. prob has a row for each piece, then one for the missing and one for the unknown."""

    def __init__(self, index: dict[str, int], prob: np.ndarray):
        self.index, n = index, len(index)
        self.longest = max(map(len, index), default=1)
        self.missing, self.unknown = n, n + 1
        self.prob = np.vstack([prob, np.zeros((1, prob.shape[1])), np.full((1, prob.shape[1]), UNKNOWN)])

    def arcs(self, words: list[str], end: int) -> list[tuple[int, np.ndarray]]:
        """Pieces of the words that end at a place: (length, row of each word's piece)."""
        get, out = self.index.get, []
        for n in range(1, min(end, self.longest) + 1):
            other = self.unknown if n == 1 else self.missing
            ids = np.array([get(w[end - n : end], other) for w in words])
            if n == 1 or (ids != other).any():
                out.append((n, ids))
        return out

    def forward(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language. Every eighth place the sums are scaled, so long words don't underflow."""
        out = np.empty((len(words), self.prob.shape[1]))
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, at in by_length.items():
            own = [MARK + words[i] for i in at]
            sums: list[np.ndarray | None] = [np.ones((len(at), out.shape[1]))]
            logs = np.zeros((len(at), out.shape[1]))
            for end in range(1, length + 2):
                here = np.zeros_like(logs)
                for n, ids in self.arcs(own, end):
                    here += sums[end - n] * self.prob[ids]
                sums.append(here)
                if end > self.longest:
                    sums[end - self.longest - 1] = None
                if end % 8 == 0:
                    scale = here.copy()
                    logs += np.log(scale)
                    for k in range(max(0, end - self.longest), end + 1):
                        sums[k] = sums[k] / scale
            out[at] = np.log(sums[-1]) + logs
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected number of each piece in words with counts, in the one language of prob.

        Sums are held as logarithms, so long words don't underflow. Backwards each place's count is shared among the pieces that
        end there, by their part of its sum.
        """
        out = np.zeros(len(self.prob))
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        with np.errstate(divide="ignore"):
            log_p = np.log(self.prob[:, 0])
        for length, at in by_length.items():
            own = [MARK + words[i] for i in at]
            arcs, logs = [], [np.zeros(len(at))]
            for end in range(1, length + 2):
                arcs.append(self.arcs(own, end))
                terms = np.array([logs[end - n] + log_p[ids] for n, ids in arcs[-1]])
                top = terms.max(axis=0)
                logs.append(top + np.log(np.exp(terms - top).sum(axis=0)))
            mass = [np.zeros(len(at)) for _ in range(length + 1)] + [counts[at].astype(float)]
            for end in range(length + 1, 0, -1):
                for n, ids in arcs[end - 1]:
                    flow = mass[end] * np.exp(logs[end - n] + log_p[ids] - logs[end])
                    out += np.bincount(ids, flow, len(out))
                    mass[end - n] += flow
        return out[: len(self.index)]


def fit(docs: DataFrame, vocabulary: list[str], rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities, learned from about `rows` documents of each language, chosen by a hash of the id.

    Documents that are held out, or lack text or language, are left out. All languages that are left are learned. The driver gets a row
    for each language, then the counts of pieces by language: their size is set by vocabulary and languages, not by the documents (the
    model holds 8 bytes for each piece and language).
    """
    spark = docs.sparkSession
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(doc_id))
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((len(vocabulary), 0))
    share = F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, rows / counts[k]))))
    draw = F.pmod(F.xxhash64(doc_id, F.lit("fit")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = known.where(draw < F.element_at(share, F.col(lang))).select(lang, text)

    def words():
        def count(langs, texts):
            found: dict[str, Counter] = {}
            for g, t in zip(langs, texts, strict=True):
                found.setdefault(g, Counter()).update(w for w in letters(t.lower()))
            rows = [(g, w, n) for g, c in found.items() for w, n in c.items()]
            return list(zip(*rows, strict=True)) or [[], [], []]

        return count

    table, path = save(map_rows(sample, words, "lang string, word string, n long", text).groupBy("lang", "word").agg(F.sum("n").alias("n")))
    prob = np.full((len(vocabulary), len(langs)), 1 / len(vocabulary))
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast((vocabulary, langs, prob))

        def step(sent=sent):
            vocabulary, langs, prob = sent.value
            index = {p: i for i, p in enumerate(vocabulary)}

            def expect(groups, words, counts):
                groups, counts, out = np.array(groups), np.array(counts, float), []
                for k, g in enumerate(langs):
                    at = np.flatnonzero(groups == g)
                    if len(at):
                        each = Lattice(index, prob[:, k : k + 1]).expected([words[i] for i in at], counts[at])
                        some = np.flatnonzero(each > 1e-9)
                        out += [(k, int(i), float(each[i])) for i in some]
                return list(zip(*out, strict=True)) or [[], [], []]

            return expect

        found = map_rows(table.repartition("word"), step, "lang int, piece int, n double", None).groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        total = np.full(prob.shape, PRIOR)
        total[found["piece"], found["lang"]] += found["n"]
        prob = total / total.sum(axis=0)
        sent.unpersist()
    discard(spark, path)
    return langs, prob


class Scorer:
    def __init__(self, vocabulary: list[str], langs: list[str], prob: np.ndarray):
        self.langs, self.lattice = langs, Lattice({p: i for i, p in enumerate(vocabulary)}, prob)
        self.kept = max(LEAST_KEPT, KEPT // max(1, len(langs)))
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.logs = np.empty((1024, len(self.langs)))

    def learn(self, words: list[str]) -> None:
        if len(self.rows) + len(words) > self.kept:
            self.forget()
        begin = len(self.rows)
        while begin + len(words) > len(self.logs):
            self.logs = np.concatenate([self.logs, np.empty_like(self.logs)])
        self.logs[begin : begin + len(words)] = self.lattice.forward(words)
        self.rows.update(zip(words, range(begin, begin + len(words)), strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Languages, scores, and whether the letters are likely in the language at all."""
        bags = [Counter(letters(t.lower())) if t else Counter() for t in texts]
        seen = set().union(*bags)
        if new := [w for w in seen if w not in self.rows]:
            self.learn(new if len(self.rows) + len(new) <= self.kept else list(seen))
        names, scores, likely = [], [], []
        for bag in bags:
            if not bag or not self.langs:
                names.append("und")
                scores.append(0.0)
                likely.append(False)
                continue
            rows = self.rows
            total = np.fromiter(bag.values(), float, len(bag)) @ self.logs[[rows[w] for w in bag]]
            odds = np.exp(total - total.max())
            best = int(odds.argmax())
            names.append(self.langs[best])
            scores.append(float(odds[best] / odds.sum()))
            size = sum(len(w) * n for w, n in bag.items())
            likely.append(bool(size < LETTERS or total[best] >= -np.log(ALPHABET) * (size + bag.total())))
        return names, scores, likely


def identify(docs: DataFrame, vocabulary: str, rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (the language's share of the probability of all).

    Learned on docs itself, see fit(). A text that is null or has no letter is `und` with score 0, and so is every text if no
    language is known. Only letters count, with case folded. Very long texts and words are scored whole; equal texts give
    equal results; of equal languages the first by name wins; a null id is not held out; other columns are not read.
    """
    known = pieces(vocabulary)
    langs, prob = fit(docs, known, rows, doc_id, text, lang)
    sent = docs.sparkSession.sparkContext.broadcast((known, langs, prob))
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    own = uuid.uuid4().hex

    def make():
        predict = per_worker(own, lambda: Scorer(*sent.value)).predict
        return lambda ids, held, texts: [ids, held, *predict(texts)[:2]]

    return map_rows(docs.select(doc_id, held_out(doc_id).alias("held_out"), text), make, f"doc_id {kind}, held_out boolean, lang_pred string, score double", text)


def keep_identified(docs: DataFrame, vocabulary: str, least: float = 0.5, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without the rows whose text has no letter, no language with at least the given score, or letters that are likely in none
    (see LETTERS); columns as they are. If no language could be learned, only rows without letters go."""
    known = pieces(vocabulary)
    langs, prob = fit(docs, known, doc_id=doc_id, text=text, lang=lang)
    sent = docs.sparkSession.sparkContext.broadcast((known, langs, prob))
    at, own = docs.columns.index(text), uuid.uuid4().hex

    def make():
        predict = per_worker(own, lambda: Scorer(*sent.value)).predict

        def rows(*columns):
            if langs:
                keep = [i for i, (g, s, good) in enumerate(zip(*predict(columns[at]), strict=True)) if g != "und" and s >= least and good]
            else:
                keep = [i for i, t in enumerate(columns[at]) if t and letters(t)]
            return [[c[i] for i in keep] for c in columns]

        return rows

    return map_rows(docs, make, docs.schema, text)
