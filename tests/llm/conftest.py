import random

import pytest
from pyspark.sql import types as T

WORDS = "the of and river stone light carry seven house green water under moon table walk".split()


def prose(rng: random.Random, n: int, vocab: int = 400) -> str:
    out = []
    for i in range(n):
        w = WORDS[rng.randrange(len(WORDS))] if rng.random() < 0.4 else f"w{rng.randrange(vocab)}x"
        w = "".join(chr(97 + int(c)) if c.isdigit() else c for c in w)
        out.append(w.capitalize() if i % 9 == 0 else w)
        if i % 9 == 8:
            out[-1] += "."
    return " ".join(out)


# names that the operators use inside, as columns of the input
CLASHES = ["n", "h", "x", "y", "ids", "part", "rep", "kept", "k1", "value", "_spans", "windows", "pos", "score", "label", "held", "dropped", "spans", "repeats_of"]
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())]
                    + [T.StructField(c, T.StringType()) for c in CLASHES])


def frame(spark, rows):
    """Documents with columns of clashing names; rows: (doc_id, text)."""
    return spark.createDataFrame([(i, t, None, "s", len(t) if t else None) + ("z",) * len(CLASHES) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long text, a very long word,
    repeated rows, equal texts under several ids."""
    rng = random.Random(3)
    base = prose(rng, 60)
    long_text = prose(rng, 30_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one  TWO"), (6, base), (7, base), (7, base),
            (8, base.upper()), (9, long_text), (10, "a" * 300_000 + " b c d e"), (11, "ü ß é x 漢字 \U0001f600 end of text here"),
            (None, base), (None, None), (12, "line\nline\nline\n\nline"), (13, "\x00\x01 odd\x1c bytes\x85 in here\x0b and there")]
