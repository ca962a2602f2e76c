"""Every stage of the pipeline against a plain version of what it should do."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers as pt
from tokenizers import Tokenizer

import corpus_pipeline as P
from quarry.llm.common import staged

from .test_neardup import brute
from .test_secrets import base

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The rows after every stage, the input first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(P.STAGES):
        out.append(staged(stage(spark, out[-1], SF), f"test-stage-{i}"))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_and_columns(steps):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "near duplicates", "benchmark decontamination",
                                        "secret scan", "packing"]
    for df in steps[1:5]:
        assert df.columns == steps[0].columns and df.schema == steps[0].schema


def test_quality_drops_bad_documents_only(spark, steps):
    kept, docs = rows(steps[1]), rows(steps[0])
    assert all(docs[i] == r for i, r in kept.items())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [(i in kept) == bool(q) for i, q in labels.items() if i in docs]
    assert np.mean(right) > 0.97


def test_one_document_of_each_group(steps):
    before, after = rows(steps[1]), rows(steps[2])
    want = {i for i, _, _, kept in brute([(r.doc_id, r.text) for r in before.values()]) if kept}
    assert set(after) == want and all(before[i] == r for i, r in after.items())


def test_benchmark_documents_go(spark, steps):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = rows(steps[2]), rows(steps[3])
    held = {i for i, r in before.items() if any(t in (r.text or "") for t in items)}
    assert set(after) == set(before) - held and all(before[i] == r for i, r in after.items())


def test_secrets_are_masked(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert set(before) == set(after)
    for i, r in after.items():
        if base(before[i].text):
            assert not base(r.text) and r.n_chars == len(r.text)
        elif r.text == before[i].text:
            assert r == before[i]


def test_packing_holds_every_id(steps):
    t = Tokenizer.from_file(str(pt.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    pieces = defaultdict(list)
    for r in steps[5].collect():
        pieces[r.doc_id].append(r)
    docs = rows(steps[4])
    assert set(pieces) == set(docs)
    for i, ps in pieces.items():
        ids, at = np.asarray(t.encode(docs[i].text or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_odd_documents_pass_through(spark, odd_rows):
    """Nulls, blanks, long texts, repeated rows and clashing columns in every stage."""
    from .conftest import frame
    df = frame(spark, odd_rows)
    for _, stage in P.STAGES[1:4]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns and out.count() <= len(odd_rows)
    assert P.sequence_packing(spark, df, SF).count() >= len(odd_rows)
    empty = df.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0
