"""Code-snippet column functions.

The Java parser process of a classic pipeline is re-aimed as one ordered
regex per operation, evaluated by ``regexp_extract_all`` inside the JVM:
typed code tokens come out in source order as ``array<struct<kind, token>>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ------------------------------------------------------------- fixed values
CODE_BLOCK_RE = r"(?is)<code[^>]*>(.*?)</code>"
# Ordered alternatives: comment | import | object creation | method call on a
# receiver | declaration (Type name =/;) | unresolved call.
CODE_TOKEN_RE = "|".join([
    r"//[^\n]*|/\*(?s:.*?)\*/",
    r"import\s+(?:static\s+)?[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*(?:\.\*)?",
    r"new\s+[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*",
    r"\.[A-Za-z_$][\w$]*\s*\(",
    r"[A-Z][\w$]*(?:\[\])*\s+[a-z_$][\w$]*\s*[=;]",
    r"[A-Za-z_$][\w$]*\s*\(",
])
CALL_KEYWORDS = ("if", "for", "while", "switch", "catch", "synchronized", "return",
                 "super", "this", "do", "try", "else")
KINDS = ("IM", "VAR", "OC", "MC", "UMC", "COM")
LEX_RE = "|".join([
    r'"(?:[^"\\]|\\.)*"', r"'(?:[^'\\]|\\.)*'",
    r"[A-Za-z_$][\w$]*",
    r"[0-9]+(?:\.[0-9]+)?[lLfFdD]?",
    r"==|!=|<=|>=|&&|\|\||\+\+|--|->|::",
    r"[-+*/%=<>!&|^~?:;,.(){}\[\]@]",
])
# --------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unescape(x: Column) -> Column:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                    ("&amp;", "&")):
        x = F.replace(x, F.lit(ent), F.lit(ch))
    return x


def extract_code_blocks(html) -> Column:
    """Trimmed, non-empty text of every <code> element (entities decoded)."""
    blocks = F.regexp_extract_all(_c(html), F.lit(CODE_BLOCK_RE), 1)
    from .text import strip_ws
    return F.filter(F.transform(blocks, lambda b: strip_ws(unescape(F.regexp_replace(b, "<[^>]*>", "")))),
                    lambda b: b != "")


def _classify(m: Column) -> Column:
    name = F.regexp_extract(m, r"([A-Za-z_$][\w$]*)\s*\($", 1)
    return (F.when(m.startswith("//") | m.startswith("/*"),
                   F.struct(F.lit("COM").alias("kind"),
                            F.trim(F.regexp_replace(m, r"^//|^/\*|\*/$", "")).alias("token")))
            .when(m.startswith("import"),
                  F.struct(F.lit("IM").alias("kind"),
                           F.regexp_replace(m, r"^import\s+(static\s+)?", "").alias("token")))
            .when(m.rlike(r"^new\s"),
                  F.struct(F.lit("OC").alias("kind"), F.regexp_replace(m, r"^new\s+", "").alias("token")))
            .when(m.startswith("."), F.struct(F.lit("MC").alias("kind"), name.alias("token")))
            .when(m.rlike(r"[=;]$"),
                  F.struct(F.lit("VAR").alias("kind"),
                           F.regexp_extract(m, r"^([A-Z][\w$]*)", 1).alias("token")))
            .otherwise(F.struct(F.lit("UMC").alias("kind"), name.alias("token"))))


def code_tokens(code, keep=KINDS, distinct: bool = False) -> Column:
    """Typed tokens of a snippet in source order, kinds in ``keep``;
    ``distinct`` keeps the first occurrence of each (kind, token)."""
    ms = F.regexp_extract_all(_c(code), F.lit(CODE_TOKEN_RE), 0)
    toks = F.transform(ms, _classify)
    kw = F.array(*[F.lit(k) for k in CALL_KEYWORDS])
    keep_arr = F.array(*[F.lit(k) for k in keep])
    toks = F.filter(toks, lambda t: F.array_contains(keep_arr, t["kind"])
                    & ~((t["kind"] == "UMC") & F.array_contains(kw, t["token"]))
                    & (t["token"] != ""))
    return F.array_distinct(toks) if distinct else toks


def code_token_strings(code, keep=KINDS, distinct: bool = True) -> Column:
    """Token values only (prefix stripped), e.g. for in-place replacement."""
    return F.transform(code_tokens(code, keep, distinct), lambda t: t["token"])


def lex_code(code) -> Column:
    """Lexical tokens of a snippet (strings, names, numbers, operators)."""
    return F.regexp_extract_all(_c(code), F.lit(LEX_RE), 0)


def dedupe_sequence(arr) -> Column:
    """Order-preserving distinct."""
    return F.array_distinct(_c(arr))


def replace_code_with_tokens(html) -> Column:
    """T4: every <pre> block is replaced, in place, by its distinct code tokens."""
    pieces = F.split(_c(html), r"(?i)<pre[^>]*>")

    def piece(p, i):
        # the closing tag in any case, as the opening one
        pos = F.instr(F.regexp_replace(p, "(?i)</pre>", "</pre>"), "</pre>")
        code = F.when(pos > 0, p.substr(F.lit(1), pos - 1)).otherwise(p)
        return F.when(i == 0, p).otherwise(F.concat_ws(
            " ", F.array_join(code_token_strings(unescape(F.regexp_replace(code, "<[^>]*>", " "))), " "),
            F.when(pos > 0, p.substr(pos + 6, F.length(p))).otherwise(F.lit(""))))
    return F.array_join(F.transform(pieces, piece), " ")
