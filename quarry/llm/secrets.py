"""Secret scan: fixed patterns plus sliding-window entropy.

The patterns give the base spans (kinds ``assign``, ``access``, ``hex``).  The
entropy scan adds spans of kind ``entropy``: for every maximal run of token
characters, a window of ``window`` characters moves over the run while the
counts of its characters, per character class, are kept up to date; a window
scores when its entropy reaches the limit of the narrowest class that holds it
(of the run's class, if the window has no digit).  Touching scoring windows are
joined to one span.  Left out are entropy spans inside a base span, and in runs
that an allow-list pattern explains those whose parts between ``=`` and ``/``
are explained one by one as well.

Defined results: null and empty texts have no spans; repeated rows are scanned
row by row; offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import lean

# Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "entropy")

RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")

PART = re.compile(r"[^=/]+")  # of a run

# Shapes that look random and are not secret.
ALLOW = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",   # UUIDs
    r"[0-9+/_=-]+",                                          # numbers, dates, rules
    r"[A-Za-z/_=+-]+",                                       # words, paths and rules without digits
    r"([A-Za-z]+[-_/])*[A-Za-z]*[0-9]{1,6}([-_/][A-Za-z]+)*",  # a word chain with one short number
    r"(?i:.*(example|sample|placeholder|dummy|xxxx).*)",
)


@dataclass(frozen=True)
class EntropyRule:
    """``limits``: bits per character that a window's characters of a class
    must reach, if the class fills the window."""
    window: int = 20
    limits: dict = field(default_factory=lambda: {"hex": 3.0, "alnum": 3.5, "base64": 3.7})
    allow: tuple = ALLOW
    allowed_values: frozenset = frozenset()


def _class(run: str) -> str | None:
    """Character class of a run: the narrowest that holds all its characters."""
    digits = any("0" <= c <= "9" for c in run)
    if not digits:
        return None
    if all(c in "0123456789abcdefABCDEF" for c in run):
        return "hex"
    lower, upper = any("a" <= c <= "z" for c in run), any("A" <= c <= "Z" for c in run)
    return "base64" if lower and upper else "alnum"


# places of a character in the counts of its window
_KINDS_OF = {c: tuple(j for j, has in enumerate(("0" <= c <= "9", "a" <= c <= "z", "A" <= c <= "Z",
                                                 c not in "0123456789abcdefABCDEF")) if has)
             for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"}


def hot_windows(run: str, width: int, limit: float, limits: dict | None = None) -> list[tuple[int, int]]:
    """Joined spans of the windows of ``run`` whose entropy is at least
    ``limit`` bits, or with ``limits`` that of the window's own class.  H = log2(w) - sum(c * log2 c) / w; one character enters
    and one leaves per step, so only two counts change."""
    if len(run) < width:
        return []
    xlog = [0.0] + [c * math.log2(c) for c in range(1, width + 2)]
    most = width * (math.log2(width) - limit)
    own = {k: width * (math.log2(width) - v) for k, v in (limits or {}).items()}
    held = [0, 0, 0, 0]  # digits, lower, upper, not hex
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += xlog[c + 1] - xlog[c]
        if i >= width:
            old = run[i - width]
            c = counts[old]
            counts[old] = c - 1
            total += xlog[c - 1] - xlog[c]
        bound = most
        if limits:
            for j in _KINDS_OF[ch]:
                held[j] += 1
            if i >= width:
                for j in _KINDS_OF[run[i - width]]:
                    held[j] -= 1
            digits, lower, upper, other = held
            if digits:
                bound = own["hex" if not other else "base64" if lower and upper else "alnum"]
        if i >= width - 1 and total <= bound + 1e-9:
            s = i - width + 1
            if spans and s <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((s, i + 1))
    return spans


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans, by start and then by kind as listed in ``KINDS``."""
    out = []
    low = text.lower()
    # a match needs one of the keywords; the pattern itself decides
    if any(k in low for k in KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text)
                if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return _sorted(out)


def _sorted(spans: list) -> list:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def entropy_spans(text: str, rule: EntropyRule, base: list, allow: re.Pattern) -> list:
    out = []
    for m in RUN.finditer(text):
        run = m.group()
        kind = _class(run)
        if kind is None or run in rule.allowed_values:
            continue
        open_ = [(0, len(run))]
        if allow.fullmatch(run):
            open_ = [p.span() for p in PART.finditer(run) if not allow.fullmatch(p.group())]
            if not open_:
                continue
        for s, e in hot_windows(run, rule.window, rule.limits[kind], None if kind == "hex" else rule.limits):
            if not any(s < f and b < e for b, f in open_):
                continue
            s, e = s + m.start(), e + m.start()
            if not any(b <= s and e <= f for _, b, f in base):
                out.append(("entropy", s, e))
    return out


def joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan(rule: EntropyRule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow = re.compile("|".join(f"(?:{p})" for p in rule.allow) or r"(?!)")
        for b in batches:
            counts, sha, every = [[], [], []], [], []
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                for kind, c in zip(KINDS, counts):
                    c.append(sum(k == kind for k, _, _ in base))
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                every.append(joined(_sorted(base + entropy_spans(text, rule, base, allow))))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha), pa.array(every)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         rule: EntropyRule = EntropyRule()) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256
    (of the joined base spans) and spans (all spans, ``kind:start:end``)."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(lean(_scan(rule)), "doc_id long, n_assign long, n_access long, n_hex long, "
                                       "base_sha256 string, spans string")


def redacted(text: str, rule: EntropyRule, allow: re.Pattern) -> str:
    """``text`` with every span replaced by ``[kind]``; overlapping spans are
    replaced as one, named after the first."""
    base = base_spans(text)
    spans = _sorted(base + entropy_spans(text, rule, base, allow))
    if not spans:
        return text
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", rule: EntropyRule = EntropyRule()) -> DataFrame:
    """``docs`` with the spans of each text masked; rows without spans, and
    null texts, stay as they are.  All other columns are kept."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow = re.compile("|".join(f"(?:{p})" for p in rule.allow) or r"(?!)")
        for b in batches:
            texts = [None if (v := t.as_py()) is None else redacted(v, rule, allow) for t in b.column(at)]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(lean(run), docs.schema)
