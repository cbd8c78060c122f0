"""Phrase collocations by Toivonen's sampling algorithm over contiguous phrases of up to five words.

1. A part of the documents, dealt by hash, is mined level by level at a lowered threshold: its phrases are the proposal.
2. One pass over all documents counts the proposal and its negative border together. A phrase is in the border if it is not
   proposed but its first and last k - 1 words are; since only phrases that occur can be frequent, the border is never built, each
   place of the texts tells whether its phrase belongs to either.
3. A frequent phrase outside the proposal is a failure of the border: longer phrases around it may be frequent and not counted.
   Such phrases are proposed too, and a further pass counts what is new in the border. It takes new phrases as proposed as well
   and so also counts the longer ones around those, however long; a pass that fails is repeated, until nothing does. Then every
   frequent phrase has been counted, over all documents.

The proposal is known to tasks as a Bloom filter of bounded size. A false positive only means that a phrase is taken as proposed,
with all that follows from it, so the result does not depend on the filter. Passes count 64-bit hashes, which bounds the counts of
phrases from above, and add up a part of a second hash of what is proposed, which tells whether a hash is that of one phrase alone. The
words of proposed phrases are found in the sample, in a document that each was seen in. A last pass over all documents finds those of
the others, by both hashes; where phrases share the first one, they are counted once more by both.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, save

#: Words of a phrase at most; one of so many documents is in the sample; part of the expected count that proposes a phrase.
LONGEST, SAMPLE, LOWERED = 5, 8, 0.5
#: Bits of a block of the filter, blocks at most (32 MB in all), bits set for a phrase, and bits a phrase from which blocks are counted.
BLOCK_BITS, MOST_BLOCKS, SET_BITS, BITS_A_PHRASE = 1 << 16, 1 << 12, 3, 16
#: Bytes of text that are counted at once, and phrases that a task remembers to have named.
CHUNK, NAMED = 4_000_000, 1_000_000
#: Bits of the second hash that are added up; their sum is exact for up to 2**39 occurrences of a phrase.
SUMMED = np.uint64(2**24 - 1)
#: Salts of a ranking that would meet in one task a language.
SALTS = 32

_BREAK, _NEXT = b"\xff", b"\xfe"  # end of a piece, and of a document; neither stands in UTF-8 text
#: A-Z to lower case, ends of pieces to _BREAK, tabs to blanks.
_TABLE = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + _BREAK * 10 + b" ")
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_digest = xxhash.xxh3_128_digest


class Bloom:
    """A blocked Bloom filter over 64-bit hashes: the upper bits tell the block, the others the bits within it."""

    def __init__(self, blocks: int, rows: list[tuple[int, bytes]]):
        self.bits = np.zeros((blocks, BLOCK_BITS // 8), np.uint8)
        for block, bits in rows:
            self.bits[block] = np.frombuffer(bits, np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        block, out = (h >> np.uint64(48)) % np.uint64(len(self.bits)), np.ones(len(h), bool)
        for i in range(SET_BITS):
            at = (h >> np.uint64(16 * i)) % np.uint64(8 * self.bits.shape[1])
            out &= (self.bits[block, at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def bloom_of(hashes: DataFrame) -> Bloom:
    """The filter of the hashes h: blocks are made by tasks; the driver gets at most MOST_BLOCKS of 8 KB."""
    blocks = int(min(MOST_BLOCKS, max(1, hashes.count() * BITS_A_PHRASE // BLOCK_BITS + 1)))
    places = F.array(*(F.shiftrightunsigned("h", 16 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for i in range(SET_BITS)))
    dealt = hashes.select((F.shiftrightunsigned("h", 48) % blocks).cast("int").alias("block"), F.explode(places).alias("at"))
    each = dealt.groupBy("block").agg(F.collect_set("at").alias("at"))  # at most BLOCK_BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in batch.column(1):
                bits = np.zeros(BLOCK_BITS, np.uint8)
                bits[np.asarray(at.values)] = 1
                out.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["block", "bits"])

    return Bloom(blocks, [(r[0], bytes(r[1])) for r in each.mapInArrow(run, "block int, bits binary").collect()])


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, list]]:
    """(language, text, ids of its documents) of about CHUNK bytes, cut where pieces end; columns are language, text and, if there, id. A
    piece is never cut."""
    waiting: dict[str, tuple[list[bytes], list]] = {}
    held = 0
    for batch in batches:
        for lang, text, *own in zip(*batch.columns, strict=True):
            lang, text, own = lang.as_py(), text.as_py().encode("utf-8", "surrogatepass").translate(_TABLE), own[0].as_py() if own else None
            while len(text) > CHUNK and (cut := text.find(_BREAK, CHUNK)) >= 0:
                yield lang, text[:cut], [own]
                text = text[cut + 1 :]
            texts, ids = waiting.setdefault(lang, ([], []))
            texts.append(text)
            ids.append(own)
            held += len(text)
            if held >= CHUNK:
                yield from ((k, _NEXT.join(v), i) for k, (v, i) in waiting.items())
                waiting, held = {}, 0
    yield from ((k, _NEXT.join(v), i) for k, (v, i) in waiting.items())


class Words:
    """The words of a chunk: distinct ones, the code of each place, whether it is a word or ends a piece, and hashes of each place's word."""

    def __init__(self, lang: str, text: bytes, bits: int = 64):
        # no white space is left but blanks, so split() cuts words as the definition does
        places = np.array(text.replace(_BREAK, b" \xff ").replace(_NEXT, b" \xfe ").split() or [_BREAK], object)
        self.code, self.names = pd.factorize(places)
        seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
        self.hash = np.frombuffer(b"".join(map(_digest, self.names, itertools.repeat(seed))), "<u8").reshape(-1, 2)
        self.word = np.asarray((self.names != _BREAK) & (self.names != _NEXT))[self.code]
        self.mask = np.uint64(2**bits - 1)
        self.first = (self.hash[:, 0] & self.mask)[self.code]

    def document(self, at: np.ndarray) -> np.ndarray:
        """Number of the document in the chunk, of each place."""
        return np.cumsum(np.asarray(self.names == _NEXT)[self.code])[at]

    def second(self, at: np.ndarray, k: int) -> np.ndarray:
        """The second hash of the phrases of k words at these places."""
        each, out = self.hash[:, 1], np.zeros(len(at), np.uint64)
        for i in range(k):
            out = out * _STEP[1] + each[self.code[at + i]]
        return out

    def phrases(self, filters: list[Bloom], closed_to: int = LONGEST, longest: int = LONGEST):
        """(k, places, first hashes, known, new) for each length, of the places whose phrase a filter proposes or has in its negative border.

        known: the last filter proposes it. new: it is in reach of the last filter, and was not of an earlier one. With earlier
        filters what is new counts as proposed; beyond closed_to all in the border does. A filter proposes what an earlier one does, its
        false positives too: these were no failures, and phrases around one of them and a failure are only in reach by both.
        """
        at, h = np.flatnonzero(self.word), None
        proposed = [np.zeros(len(self.code) + 1, bool) for _ in filters]  # the phrases of the last length, by their first place
        for k in range(1, longest + 1):
            if k == 1:
                h, reach = self.first[at], [np.ones(len(at), bool) for _ in filters] or [np.ones(len(at), bool)]
            else:
                reach = [p[at] & p[at + 1] for p in proposed]
                keep = np.logical_or.reduce(reach)
                at, h, reach = at[keep], h[keep], [r[keep] for r in reach]
                h = (h * _STEP[0] + self.first[at + k - 1]) & self.mask
            new = reach[-1].copy()
            for r in reach[:-1]:
                new &= ~r
            known, has = [], np.zeros(len(h), bool)
            for r, f in zip(reach, filters, strict=False):
                has = has | f.has(h)
                known.append(r if k > closed_to else r & has)
            yield k, at, h, known[-1] if known else new, new
            for i, now in enumerate(known):
                proposed[i][:] = False
                proposed[i][at] = now | new if i and i == len(known) - 1 else now


def counted(docs: DataFrame, filters: list[Bloom], least: int = 1, bits: int = 64) -> DataFrame:
    """h, n, c for the phrases of least or more words that are new with the last filter. n is below zero for those that it proposes; c
    is the sum of their second hashes' SUMMED bits, and 0 for others."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text, _ in chunks(batches):
            words = Words(lang, text, bits)
            for k, at, h, known, new in words.phrases(sent.value):
                if k < least or not new.any():
                    continue
                at, h, known = at[new], h[new], known[new]
                order = np.argsort(h)
                first = np.flatnonzero(np.r_[True, h[order[1:]] != h[order[:-1]]])
                n = np.diff(np.r_[first, len(h)])
                second = np.zeros(len(h), np.int64)
                second[known] = (words.second(at[known], k) & SUMMED).view(np.int64)
                c = np.add.reduceat(second[order], first)
                first = order[first]
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(np.where(known[first], -n, n)), pa.array(c)], ["h", "n", "c"])

    return docs.mapInArrow(run, "h long, n long, c long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def proposed(sample: DataFrame, filters: list[Bloom], least: int, longest: int, closed_to: int, bits: int = 64) -> DataFrame:
    """h, n, id for the phrases of least to longest words in the sample (lang, text, id): how often, and a document that has it."""
    sent = sample.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text, ids in chunks(batches):
            words, ids = Words(lang, text, bits), np.array(ids, np.int64)
            for k, at, h, _, new in words.phrases(sent.value, closed_to, longest):
                if k >= least and new.any():
                    h, first, n = np.unique(h[new], return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(ids[words.document(at[new][first])])], ["h", "n", "id"])

    return sample.mapInArrow(run, "h long, n long, id long").groupBy("h").agg(F.sum("n").alias("n"), F.min("id").alias("id"))


def named_in_sample(sample: DataFrame, filters: list[Bloom], wanted: DataFrame, bits: int = 64) -> DataFrame:
    """h, g, lang, k, phrase: phrases of the wanted hashes (h, id) in the document of each."""
    sent = sample.sparkSession.sparkContext.broadcast(filters)
    asked = sample.join(wanted.groupBy("id").agg(F.collect_list("h").alias("hs")), "id").select("lang", "text", "hs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text, hs in zip(*batch.columns, strict=True):
                words = Words(lang.as_py(), text.as_py().encode("utf-8", "surrogatepass").translate(_TABLE), bits)
                hs, rows = np.asarray(hs.values).view(np.uint64), []
                for k, at, h, _, _ in words.phrases(sent.value):
                    at, h = at[has := np.isin(h, hs)], h[has]
                    found = zip(h.view(np.int64).tolist(), words.second(at, k).view(np.int64).tolist(), words.names[words.code[at[:, None] + np.arange(k)]].tolist(), strict=True)
                    rows += [(*key, lang.as_py(), k, b" ".join(row).decode("utf-8", "surrogatepass")) for key, row in {(a, b): row for a, b, row in found}.items()]
                columns, kinds = list(zip(*rows, strict=True)) or [()] * 5, (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["h", "g", "lang", "k", "phrase"])

    return asked.mapInArrow(run, "h long, g long, lang string, k int, phrase string").distinct()


def named(docs: DataFrame, filters: list[Bloom], frequent: Bloom, bits: int = 64) -> DataFrame:
    """h, g, k, phrase, words, lang: the phrases at the places that were counted whose hash is frequent; k = 0 for a number of words.

    A task names a phrase when it meets it first, so rows are at most the phrases of each task.
    """
    sent = docs.sparkSession.sparkContext.broadcast((filters, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (before, wanted), seen = sent.value, set()
        for lang, text, _ in chunks(batches):
            words = Words(lang, text, bits)
            columns: list[list] = [[0], [0], [0], [""], [int(words.word.sum())]]
            for k, at, h, _, _ in words.phrases(before):
                has = wanted.has(h)
                at, h = at[has], h[has]
                g = words.second(at, k)
                order = np.lexsort((g, h))
                at, h, g = at[order], h[order], g[order]
                first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]) if len(h) else order
                keys = list(zip(h[first].view(np.int64).tolist(), g[first].view(np.int64).tolist(), strict=True))
                keep = [i for i, key in enumerate(keys) if key not in seen]
                seen.update(keys[i] for i in keep)
                codes = words.code[at[first[keep]][:, None] + np.arange(k)] if keep else np.zeros((0, k), int)
                columns[0] += [keys[i][0] for i in keep]
                columns[1] += [keys[i][1] for i in keep]
                columns[2] += [k] * len(keep)
                columns[3] += [b" ".join(row).decode("utf-8", "surrogatepass") for row in words.names[codes].tolist()]
                columns[4] += [0] * len(keep)
            if len(seen) > NAMED:
                seen = set()
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), pa.array([lang] * len(columns[0]), pa.string())], ["h", "g", "k", "phrase", "words", "lang"])

    return docs.mapInArrow(run, "h long, g long, k int, phrase string, words long, lang string")


def counted_by_both(docs: DataFrame, filters: list[Bloom], shared: Bloom, bits: int = 64) -> DataFrame:
    """h, g, f: exact counts of the phrases at the places that were counted whose first hash is in shared."""
    sent = docs.sparkSession.sparkContext.broadcast((filters, shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, wanted = sent.value
        for lang, text, _ in chunks(batches):
            words = Words(lang, text, bits)
            for k, at, h, _, _ in words.phrases(before):
                has = wanted.has(h)
                if has.any():
                    yield pa.RecordBatch.from_arrays([pa.array(h[has].view(np.int64)), pa.array(words.second(at[has], k).view(np.int64))], ["h", "g"])

    return docs.mapInArrow(run, "h long, g long").groupBy("h", "g").agg(F.count(F.lit(1)).alias("f"))


def frequent_phrases(docs: DataFrame, least: int = 100, doc_id: str = "doc_id", lang: str = "lang", text: str = "text", bits: int = 64) -> tuple[DataFrame, dict]:
    """lang, k, phrase, f, n (words of the language) of all phrases of up to LONGEST words that occur at least so often; and what
    was done: hashes proposed, border failures of each pass, first hashes that phrases share. bits: of the first hash, fewer in tests."""
    spark = docs.sparkSession
    texts = docs.where(F.col(text).isNotNull())
    columns = [F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")]
    rows, part = texts.select(*columns), texts.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(doc_id), F.col(text)), F.lit(SAMPLE)) == 0).select(*columns)
    enough = max(1, int(LOWERED * least / SAMPLE))
    paths: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        out, path = save(df)
        paths.append(path)
        return out

    part, proposal = kept(part.withColumn("id", F.monotonically_increasing_id())), None
    for low, high, closed_to in ((1, 1, 0), (2, 2, 1), (3, LONGEST, 2)):  # words, pairs, and longer ones that hold only such pairs
        filters = [bloom_of(proposal)] if high > 1 else []
        found = kept(proposed(part, filters, low, high, closed_to, bits).where(F.col("n") >= enough).select("h", "id"))
        proposal = found if proposal is None else proposal.unionByName(found)
    seen, proposal = proposal.groupBy("h").agg(F.min("id").alias("id")), proposal.select("h")
    done = {"proposed": proposal.count(), "failures": []}
    filters, frequent = [], None
    while True:
        filters.append(bloom_of(proposal))
        again = frequent is not None
        found = kept(counted(rows, filters, 2 if again else 1, bits).where(F.abs("n") >= least))
        # after a failure all that is new counts as proposed, so nothing new can fail
        failed = found.where("n > 0").select("h") if not again else found.limit(0).select("h")
        frequent = found if frequent is None else frequent.unionByName(found)
        done["failures"].append(failed.count())
        if not done["failures"][-1]:
            break
        proposal = proposal.unionByName(failed)
    frequent = kept(frequent.groupBy("h").agg(F.max(F.abs("n")).alias("f"), F.max("c").alias("c"), (F.max("n") < 0).alias("known"), F.count(F.lit(1)).alias("m")))
    by_name = lambda names: names.where("k > 0").groupBy("h", "g").agg(F.min("lang").alias("lang"), F.min("k").alias("k"), F.min("phrase").alias("phrase"))
    known = frequent.where("known AND m = 1")
    some = named_in_sample(part, filters, known.join(seen, "h").select("h", "id"), bits).join(known, "h")
    alone = kept(some.where(F.col("c") == F.col("f") * F.col("g").bitwiseAND(F.lit(int(SUMMED)))))
    # two phrases of one hash can't both have the sum of their own, but for a sum that is so by chance
    alone = alone.join(alone.groupBy("h").agg(F.count(F.lit(1)).alias("_m")).where("_m = 1"), "h").select("h", "g", "lang", "k", "phrase", "f")
    rest = kept(frequent.join(alone.select("h"), "h", "left_anti").select("h", "f"))
    names = kept(named(rows, filters, bloom_of(rest.select("h")), bits))
    phrases = kept(by_name(names).join(rest, "h").unionByName(alone))
    done["named"] = alone.count()
    shared = phrases.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h")
    done["shared"] = shared.count()
    if done["shared"]:
        exact = counted_by_both(rows, filters, bloom_of(shared), bits).join(shared, "h").withColumnRenamed("f", "exact")
        phrases = phrases.join(exact, ["h", "g"], "left").withColumn("f", F.coalesce("exact", "f")).where(F.col("f") >= least)
    totals = names.where("k = 0").groupBy("lang").agg(F.sum("words").alias("n"))
    out, _ = save(phrases.join(totals, "lang").select("lang", "k", "phrase", "f", "n"))
    for path in paths:
        discard(spark, path)
    return out, done


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the phrases of 2 to LONGEST words that occur at least so often, scored by their
    weakest cut into two parts, floor(1000 * a * n / (l * r)); of each language the first ones.

    a, l and r are the occurrences of the phrase and of the two parts, n all words of the language. Of cuts with equal scores the
    first counts. A phrase goes if a longer frequent one that holds it occurs as often; whatever holds it so often, one of the
    phrases that are one word longer does too. Text is lower-cased in A-Z only; null and empty texts hold no word, a null language is
    "und", repeated rows count each, the id only deals the sample. Exact up to 10**15 words of a language. A text is cut where pieces end, a task holds
    a piece whole. No rows, or none so frequent, give no rows.
    """
    all_phrases, _ = frequent_phrases(docs, least, doc_id, lang, text)
    words = F.split("phrase", " ")
    some = all_phrases.where("k > 1").withColumn("w", words)
    first, rest = F.array_join(F.slice("w", 1, F.col("cut")), " "), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ")
    cuts = some.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select("lang", "k", "phrase", F.col("f").alias("a"), "n", "cut", first.alias("first"), rest.alias("rest"))
    counts = all_phrases.select("lang", "phrase", "f")
    both = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    both = both.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    d = lambda c: f"CAST({c} AS DECIMAL(15,0))"
    both = both.withColumn("score", F.expr(f"(CAST(1000 AS DECIMAL(4,0)) * ({d('a')} * {d('n')})) div ({d('l')} * {d('r')})"))
    scored = both.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"), F.min("a").alias("a"), F.min("n").alias("n"))
    ends = F.array(F.array_join(F.slice("w", 1, F.col("k") - 1), " "), F.array_join(F.slice("w", 2, F.col("k") - 1), " "))
    longer = some.where("k > 2").select("lang", F.explode(ends).alias("phrase"), F.col("f").alias("around"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    left = scored.join(longer, ["lang", "phrase"], "left").where("around IS NULL OR around < a")
    left = left.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    left = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    left = left.withColumn("nth", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("nth") <= top)
    left = left.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return left.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, unnest(pieces) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM p),
x AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
y AS (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM x),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM y),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, count(*) AS n FROM x GROUP BY lang),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, k, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, n.n, c.cut,
             CAST((1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
      FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.cut], ' ')
      JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1 :], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM f q WHERE q.lang = b.lang AND q.f = b.a AND len(q.phrase) > len(b.phrase)
        AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM o QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
