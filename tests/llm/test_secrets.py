import hashlib
import math
import random
import re
from collections import Counter

from quarry.llm import secrets

from .conftest import frame, prose

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ORDER = ["assign", "access", "hex", "entropy"]


def base(t):
    t = t or ""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ORDER.index(s[0])))


def windows(run, width, limit):
    """Spans of the windows at or above the limit, from fresh counts."""
    hot = [i for i in range(len(run) - width + 1)
           if -sum(c / width * math.log2(c / width) for c in Counter(run[i:i + width]).values()) >= limit - 1e-9]
    out = []
    for i in hot:
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], i + width)
        else:
            out.append((i, i + width))
    return out


def test_incremental_entropy_equals_fresh_counts():
    rng = random.Random(1)
    for _ in range(200):
        run = "".join(rng.choice("abcdef0123456789"[:rng.randrange(1, 17)]) for _ in range(rng.randrange(1, 80)))
        limit = rng.choice([1.0, 2.5, 3.0, 3.5])
        assert secrets.hot_windows(run, 20, limit) == windows(run, 20, limit)


def test_base_spans_and_counts(spark, odd_rows):
    rng = random.Random(4)
    bits = ["token=abc", "token=token:\"abcdefgh", "API_KEY: 'Zx9-Zx9.Zx9'", "passwd=short", "AKIA" + "A1" * 8, "AKIA" + "A" * 15,
            "f" * 24, "0123456789abcdef01234567g", "deadbeef" * 9, "seſret=abcdefgh", "toKen=abcdefgh", "SECRET==abcdefg",
            "secret =  \"a+b/c_d\"", "é", "漢", "\U0001f600", "password:password=hunter2x"]
    rows = [(100 + i, " ".join(rng.choice(bits + prose(rng, 4).split()) for _ in range(rng.randrange(30)))) for i in range(150)]
    rows += [(999, "x" * 100_000 + " token = " + "q" * 100_000)]
    df = frame(spark, rows + odd_rows)
    got = sorted(((r.doc_id or 0, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.scan(df).collect()))
    want = []
    for i, t in rows + odd_rows:
        b = base(t)
        n = Counter(k for k, _, _ in b)
        want.append((i or 0, n["assign"], n["access"], n["hex"],
                     hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest()))
    assert got == sorted(want)
    for r in secrets.scan(df).collect():
        spans = [x for x in r.spans.split(",") if x]
        assert sum(not x.startswith("entropy") for x in spans) == r.n_assign + r.n_access + r.n_hex
    assert secrets.scan(df.limit(0)).collect() == []


def spans_of(text, rule=secrets.EntropyRule()):
    allow = re.compile("|".join(f"(?:{p})" for p in rule.allow))
    return secrets.entropy_spans(text, rule, secrets.base_spans(text), allow)


def test_entropy_finds_keys_and_the_allow_list_holds():
    key = "q8Zr2LmX0vTn7BcYw5KdP3sH"
    assert spans_of(f"use {key} here") == [("entropy", 4, 4 + len(key))]
    for text in ("an 123e4567-e89b-12d3-a456-426614174000 id", "plainwordswithoutanydigitsatall",
                 "2024-01-02-2024-01-03-2024", "/usr/local/share/documents/index", "release-notes-for-version-12",
                 "EXAMPLEq8Zr2LmX0vTn7BcYw5Kd", "aaaaaaaaaaaaaaaaaaaaaaaa1"):
        assert spans_of(text) == [], text
    assert spans_of(key, secrets.EntropyRule(allowed_values=frozenset([key]))) == []
    # inside a base span nothing is added
    assert spans_of(f"token={key}") == []


def test_windows_are_judged_by_their_own_class():
    rng = random.Random(7)
    for n in (32, 40, 64):
        for _ in range(200):
            key = "".join(rng.choice("0123456789ABCDEF") for _ in range(n))
            if windows(key, 20, 3.0):
                assert spans_of(f"sig={key}"), key
    key = "q8Zr2LmX0vTn7BcYw5KdP3sH"
    for text in (f"/sample/{key}", f"dummy={key}", f"a/sample/b/{key}"):
        assert [s for s in spans_of(text) if s[2] == len(text)], text
    assert spans_of("/sample/EXAMPLEq8Zr2LmX0vTn7BcYw5Kd") == []


def test_redaction_masks_and_keeps_the_rest(spark):
    rows = [(1, "a token=abcdef123 b"), (2, None), (3, "clean"), (4, "")]
    df = frame(spark, rows)
    out = secrets.redact(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a [assign] b", 2: None, 3: "clean", 4: ""}


TOKEN_CHARS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
HEX_CHARS = set("0123456789abcdefABCDEF")


def kind_of(s):
    if not any(c.isdigit() for c in s):
        return None
    if set(s) <= HEX_CHARS:
        return "hex"
    return "base64" if any(c.islower() for c in s) and any(c.isupper() for c in s) else "alnum"


def explained(s):
    return any(re.fullmatch(p, s) for p in secrets.ALLOW)


def plain_entropy_spans(text, width=20):
    """The rule by its words: every window counted afresh and judged alone."""
    limits = {"hex": 3.0, "alnum": 3.5, "base64": 3.7}
    out, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in TOKEN_CHARS:
            end += 1
        run = text[at:end]
        kind = kind_of(run)
        if len(run) >= width and kind:
            parts, p = [], 0
            for piece in re.split("([=/])", run):
                if piece not in ("", "=", "/") and not explained(piece):
                    parts.append((p, p + len(piece)))
                p += len(piece)
            open_ = parts if explained(run) else [(0, len(run))]
            spans = []
            for i in range(len(run) - width + 1):
                w = run[i:i + width]
                h = -sum(c / width * math.log2(c / width) for c in Counter(w).values())
                if h >= limits[kind_of(w) or kind] - 1e-9:
                    if spans and i <= spans[-1][1]:
                        spans[-1][1] = i + width
                    else:
                        spans.append([i, i + width])
            for s, e in spans:
                inside = any(b <= at + s and at + e <= f for _, b, f in base(text))
                if any(s < f and b < e for b, f in open_) and not inside:
                    out.append(("entropy", at + s, at + e))
        at = end + 1
    return out


def test_entropy_spans_equal_the_rule():
    rng = random.Random(21)
    key = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    every = "".join(sorted(TOKEN_CHARS))
    found = 0
    for _ in range(400):
        pieces = [rng.choice([
            key("0123456789abcdef", rng.randrange(15, 60)), key("0123456789ABCDEF", rng.randrange(15, 60)),
            key(every, rng.randrange(15, 70)), key("ABCDEFGHIJK0123456789", rng.randrange(15, 50)), "release-notes-for-version-12",
            "/usr/sample/" + key(every, 25), "sig=" + key("0123456789ABCDEF", 32), "token: " + key(every, 24), "aaaaaaaaaaaaaaaaaaaaaaaaa1",
            "123e4567-e89b-12d3-a456-426614174000", key("ab1", 40), "2024-01-02-2024-01-03-2024", "é漢"]) for _ in range(rng.randrange(1, 5))]
        text = rng.choice([" ", "\n", ", ", "é"]).join(pieces)
        got = spans_of(text)
        assert got == plain_entropy_spans(text), text
        found += len(got)
    assert found > 200
