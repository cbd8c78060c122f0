import base64

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from predlens.llm import queries

from ..compare import same
from ..conftest import DATA
from .test_line_and_mix import brute_lines
from .test_models import brute_links


def test_oracles(spark):
    for name, sql in queries.ORACLES.items():
        same(queries.QUERIES[name](spark, DATA), sql, DATA)


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        seen.append((name, docs.collect(), after.collect()))
        docs = after
    stages = {n: (a, b) for n, a, b in seen}
    before, after = stages["language_id"]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}
    before, after = stages["line_dedup"]
    want = {(i, t) for i, t, n, gone in brute_lines([(r.doc_id, r.text) for r in before]) if not gone or t}
    assert {(r.doc_id, r.text) for r in after} == want
    before, after = stages["near_dedup"]
    assert {r.doc_id for r in after} == {i for i, (_, c) in brute_links([(r.doc_id, r.text) for r in before], 5).items() if i == c}
    before, after = stages["mixing"]
    own = {r.doc_id: r.text for r in before}
    assert all(r.text == own[r.doc_id] for r in after)  # copies are whole
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(words(after) - words(before)) <= len({r.source for r in before}) * max(len(t.split()) for t in own.values()) / 2 + 1
    texts, encoded = stages["bpe_encoding"]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted((r.doc_id, enc.encode_ordinary(r.text)) for r in texts) == sorted((r.doc_id, r.ids) for r in encoded)
    assert corpus_pipeline.run(spark, DATA).count() == len(encoded)
