import base64
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from predlens.llm import bpe_codec, license_scan, media, token_counts

RNG = random.Random(1)
PIECES = ["don't", " 's", "ab", "é", "日本", "🙂", " ", "\n", "\t", "  ", "1½", "!?", "'ll", "_", "<|endoftext|>", "▁", "\x1c", "\x85", "Ā"]
TEXTS = [None, "", " ", "\n\n x", "word " * 3000, "a" * 4000, "<|endoftext|>", "x<|endoftext|><|endoftext|>y"] + ["".join(RNG.choices(PIECES, k=RNG.randrange(30))) for _ in range(400)]
SPLITTER = token_counts.Splitter(token_counts.classes(Tokenizer.from_file(P.path("byte_bpe_50k.json")).pre_tokenizer))
SCHEMA = "doc_id long, text string, n_tokens string, feature string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", None) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", None), (None, "ab", None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_token_counts(spark, docs):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = token_counts.token_counts(docs, P.path("byte_bpe_50k.json"))
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "ab" if r.doc_id is None else TEXTS[r.doc_id] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(text.encode()), n > 1024)
    assert token_counts.token_counts(docs.limit(0), P.path("byte_bpe_50k.json")).collect() == []


def test_splitter_classes_agree_with_the_library():
    pre = Tokenizer.from_file(P.path("byte_bpe_50k.json")).pre_tokenizer
    split = token_counts.Splitter(token_counts.classes(pre)).split
    every = [chr(c) for c in [*range(0x3000), *range(0x10000, 0x11000), *range(0x33000, 0x34000), *range(0xE0000, 0xE0200)]]
    for i in range(0, len(every), 64):
        text = "".join(f"x{c}x 1{c}1 {c}!{c}{c} " for c in every[i : i + 64])
        assert [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)] == split([text])[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="'strelvmd aB1 \n!é", max_size=200), min_size=1, max_size=5))
def test_splitter_across_chunks(texts):
    import regex

    out, owner = SPLITTER.split(texts)
    assert out == [p for t in texts for p in regex.findall(P.PATTERN, t)]
    assert list(owner) == [i for i, t in enumerate(texts) for _ in regex.findall(P.PATTERN, t)]


def test_bpe_codec(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe_codec.encode_decode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, keep_ids=True)
    for r in out.collect():
        text = "ab" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe_codec.encode_decode(docs.limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect() == []


def brute_phrases(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(found), min(found)[0] if found else None, max(found)[0] if found else None, ",".join(sorted({x for _, x in found}))


def test_license_scan(spark):
    words = ["cc", "by", "General", "public", "LICENSE", "all", "rights", "reserved", "é", "x1", "mit", "-", "\n"]
    texts = [None, "", "cc by cc by", "CC-BY", "ccby", "All  Rights\nReserved.", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\nx", "spdx-license-identifier: MIT OR"]
    texts += [" ".join(RNG.choices(words, k=RNG.randrange(40))) for _ in range(300)] + ["x " * 50000 + "cc by"]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    out = by_id(license_scan.license_scan(df))
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_phrases(t)
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert out[6].labels == "spdx:apache-2.0,spdx:gpl-2.0-only,spdx:mit,weak-copyleft" and out[7].labels == "spdx-invalid"
    assert license_scan.license_scan(df.limit(0)).collect() == []


@pytest.mark.parametrize(("text", "value"), [
    ("mit", 0), ("gpl-3.0 or mit", 0), ("gpl-3.0 and mit", 2), ("mit and gpl-2.0 or isc", 0), ("mit and (gpl-2.0 or agpl-3.0)", 2), ("gpl-2.0 with x-exception and mit", 1),
    ("(mit", None), ("mit)", None), ("or mit", None), ("", None), ("mit and", None), ("mit or or isc", None),
])
def test_expressions(text, value):
    found = license_scan.evaluate(text)
    assert (found[0] if found else None) == value


def test_media(spark, docs):
    out = media.media_columns(docs, keep_media=True).collect()
    for r in out:
        raw = ("ab" if r.doc_id is None else TEXTS[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload)) and len(payload) % 192 == 0
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert media.decode(bytes(r.media)).tobytes() == payload
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    assert {bytes(r.media[:2]) for r in out} == {b"P6", b"BM"}
    assert media.media_columns(docs.limit(0)).collect() == []


def test_images():
    rng = np.random.default_rng(0)
    for h, w in ((1, 1), (3, 5), (17, 64), (40, 30)):
        px = rng.integers(0, 256, (h, w, 3)).astype(np.uint8)
        assert (media.decode(media.encode_bmp(px)) == px).all() and (media.decode(media.encode_ppm(px)) == px).all()
        cells = media.area_resize(px, 4, 6)
        big = np.kron(px.astype(float).mean(axis=2), np.ones((4, 6)))  # every pixel as 4 x 6 equal parts
        assert cells == pytest.approx(big.reshape(4, h, 6, w).mean(axis=(1, 3)))
    assert media.decode(b"P5 # c\n2 1\n255\n\x01\x02").ravel().tolist() == [1, 2]
    assert media.decode(b"P4\n3 1\n\xa0").ravel().tolist() == [0, 255, 0]
    with pytest.raises(ValueError):
        media.decode(b"P3 1 1 1 1")


@pytest.mark.parametrize("before", ["\ufeff", "\u00a0", "\u201c", "\u8bb8"])
def test_tag_after_a_character_that_is_not_ascii(before):
    labels = license_scan.Scanner().row(f"{before}SPDX-License-Identifier: MIT")[5]
    assert labels == "permissive,spdx:mit"


def test_long_pre_tokens_equal_the_library():
    """One letter, random letters of four, and a long text of one script without blanks: many chunks that wait for each other."""
    path = P.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    merges, vocab, _ = token_counts.read_tokenizer(path)
    machine = token_counts.Machine(merges, vocab, token_counts.classes(own.pre_tokenizer))
    rng = random.Random(2)
    texts = ["a" * 1_000_000, "".join(rng.choices("acgt", k=20_000)), "日本語" * 5_000, "ab" * 3_000 + " x " + "z" * 5_000]
    began = time.perf_counter()
    assert machine.count(texts[:1]).tolist() == [len(own.encode(texts[0], add_special_tokens=False).ids)]
    assert time.perf_counter() - began < 20
    assert machine.count(texts[1:]).tolist() == [len(own.encode(t, add_special_tokens=False).ids) for t in texts[1:]]
