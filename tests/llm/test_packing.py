import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as pt
import pytest
from tokenizers import Tokenizer

from quarry.llm import packing

from .conftest import frame, prose

ARGS = dict(tokenizer=str(pt.path("byte_bpe_50k.json")), ranks=str(pt.path("byte_bpe_50k.tiktoken")), pattern=pt.PATTERN)


@pytest.fixture(scope="module")
def exact():
    t = Tokenizer.from_file(ARGS["tokenizer"])
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_both_libraries_agree_below_the_bound(exact):
    """Every character of the fast range, in the contexts the pattern tells apart."""
    enc = packing.Encoder(*ARGS.values())
    for c in map(chr, range(0x250)):
        for t in (f"a{c}b", f" {c} ", f"{c}{c}1", f"1{c}'s", f"\n{c}\n\n x", f"x  {c}  "):
            assert enc._fast.encode_ordinary(t) == exact(t), repr(t)
    for t in ("don't we'll I'M", "<|endoftext|> x", "   \n\t  end", "漢字 \U0001f600", "a" * 5000):
        assert enc.ids(t) == exact(t)


def check(rows, got, exact, window=2048):
    """Every id in exactly one piece, sequences gapless, little padding."""
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(exact(t) + [1])
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for i, docs in want.items():
        if len(docs) > 1:  # repeated ids: lengths add up
            assert sum(p.length for p in pieces[i]) == sum(map(len, docs))
            continue
        at, ids = 0, np.asarray(docs[0], "<u4")
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    short = []
    for ps in seqs.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        short += [at] if at < window else []
    assert len(set(short)) == len(short) and all(n & (n - 1) == 0 for n in short)


def test_every_id_once(spark, exact, odd_rows):
    rng = random.Random(8)
    rows = [(1000 + i, prose(rng, rng.choice([3, 40, 400, 2500]))) for i in range(120)] + odd_rows
    df = frame(spark, rows).repartition(6)
    check(rows, packing.pack(df, **ARGS).collect(), exact)
    check(rows, packing.pack(df, window=64, open_windows=2, **ARGS).collect(), exact, 64)


def test_small_and_empty(spark, exact):
    rows = [(1, None)]
    check(rows, packing.pack(frame(spark, rows), **ARGS).collect(), exact)
    assert packing.pack(frame(spark, rows).limit(0), **ARGS).collect() == []


def test_best_fit_and_bound_on_open_windows():
    w = packing._Windows(10, 2, 0)
    ids = lambda n: np.arange(n, dtype=np.uint32)
    w.add(1, ids(6))
    w.add(2, ids(3))   # fits the first window best
    assert [x[0] for x in w.open] == [9]
    w.add(3, ids(5))
    w.add(4, ids(7))   # fits none: the fullest is closed with its head
    assert len(w.open) <= 2
    assert [r[:3] for r in w.rows] == [(1, 0, 6), (2, 0, 3), (4, 0, 1)]


def test_cut_points():
    assert packing.cut_points(2048 + 1300, 2048) == [2048, 3072, 3328, 3344]
    assert packing.cut_points(4096, 2048) == []


def _held(batches):
    """The encoders that a worker holds before the task makes any."""
    import gc
    import pyarrow as pa
    from quarry.llm.packing import Encoder
    n = sum(isinstance(x, Encoder) for x in gc.get_objects())
    for _ in batches:
        pass
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])


def test_waiting_workers_hold_no_encoder(spark):
    """Workers outlive their tasks and wait beside those of later stages."""
    packing.pack(frame(spark, [(1, "a few words"), (2, "and a few more")]), **ARGS).collect()
    held = spark.range(0, 16, 1, 16).mapInArrow(_held, "n long").collect()
    assert [r.n for r in held] == [0] * 16


def test_memory_is_given_back_when_a_task_ends(monkeypatch):
    from quarry.llm import arrays
    ended = []
    monkeypatch.setattr(arrays, "give_back", lambda: ended.append(1))
    task = arrays.lean(lambda batches: (2 * b for b in batches))
    assert list(task(iter([1, 2]))) == [2, 4] and len(ended) == 1
    part = task(iter([1, 2]))
    next(part)
    part.close()  # a reader that stops early
    assert len(ended) == 2
    monkeypatch.undo()
    arrays.give_back()
