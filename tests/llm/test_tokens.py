import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import arrays, tokens


def words(t):
    return (t or "").encode().lower().split()


@pytest.mark.parametrize("limit", [16, 40, 1 << 18])
def test_word_hashes_follow_the_words(monkeypatch, limit):
    monkeypatch.setattr(tokens, "LIMIT", limit)
    rng = random.Random(limit)
    seen = {}
    for _ in range(200):
        docs = [rng.choice([None, "", "".join(rng.choice("ab AÉ\n\t\x0bz\x1c \x85") for _ in range(rng.randrange(60)))])
                for _ in range(rng.randrange(6))]
        h, n = tokens.word_hashes(pa.array(docs, pa.string()))
        assert n.tolist() == [len(words(d)) for d in docs]
        for w, x in zip([w for d in docs for w in words(d)], h.tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_sliced_columns():
    col = pa.array(["a b", None, "c d e", "f"])[1:3]
    h, n = tokens.word_hashes(col)
    assert n.tolist() == [0, 3]
    assert (h == tokens.word_hashes(pa.array(["c d e"]))[0]).all()


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    t = arrays.Tally()
    raw = rng.integers(0, 50, 5000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for part in np.split(raw, 10):
        t.add(part)
    keys, counts = t.take()
    rows = list(arrays.blocks(keys, counts, arrays.shard_of(keys, 7)))
    got = {int(k): int(c) for _, ks, cs in arrays.by_shard(iter(rows)) for k, c in zip(ks, cs)}
    k, c = np.unique(raw, return_counts=True)
    assert got == dict(zip(k.tolist(), c.tolist()))


def test_shard_files(tmp_path):
    path = arrays.write_shard(f"file://{tmp_path}/a", {"keys": np.arange(5, dtype=np.uint64), "c": np.asarray([1], np.uint8),
                                                       "none": np.empty(0, np.uint32)})
    got = arrays.shard(path)
    assert got["keys"].tolist() == list(range(5)) and got["c"].tolist() == [1] and len(got["none"]) == 0
