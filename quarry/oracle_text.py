"""DuckDB SQL expression builders mirroring ``quarry.functions.text``.

Each builder takes a SQL expression string and returns one.  DuckDB needs the
'g' flag for global replacement and writes group references as \\1.
"""

from __future__ import annotations

from .functions import text as T


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rr(x: str, pat: str, rep: str = " ") -> str:
    return f"regexp_replace({x}, {q(pat)}, {q(rep)}, 'g')"


def strip_markup(x: str) -> str:
    t = rr(x, r"(?is)<script[^>]*>.*?</script>")
    t = rr(t, r"(?is)<style[^>]*>.*?</style>")
    t = rr(t, r"(?s)<!--.*?-->")
    t = rr(t, r"<[^>]*>")
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                    ("&nbsp;", " "), ("&amp;", "&")):
        t = f"replace({t}, {q(ent)}, {q(ch)})"
    return t


def strip_separators(x: str) -> str:
    return rr(x, T.SEP_RE)


def strip_ws(x: str) -> str:
    return rr(x, T.STRIP_RE, "")


def squeeze_whitespace(x: str) -> str:
    return f"trim({rr(x, T.WS_RE)})"


def html_to_text(x: str) -> str:
    return squeeze_whitespace(strip_separators(strip_markup(x)))


def drop_code_blocks(x: str) -> str:
    return rr(x, r"(?is)<pre[^>]*>.*?</pre>")


def punct_count(x: str) -> str:
    return f"(length({x}) - length({rr(x, T.PUNCT_CLASS, '')}))"


def word_count(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, {q(T.WORD_SPLIT)}), lambda s: s <> ''))"


def line_quality(x: str) -> str:
    return f"(CAST({word_count(x)} AS DOUBLE) / CAST(greatest({punct_count(x)}, 1) AS DOUBLE))"


def keep_by_quality(x: str) -> str:
    return f"(length({x}) <= {T.LONG_TEXT} OR {line_quality(x)} >= {T.LINE_QUALITY_THRESHOLD})"


def squeeze_spaces(x: str) -> str:
    return rr(x, " +", " ")


def remove_stacktraces(x: str) -> str:
    return squeeze_spaces(rr(x, T.STACKTRACE_RE))


def remove_long_strings(x: str) -> str:
    return squeeze_spaces(rr(rr(x, T.BINARY_RUN_RE), T.LONG_PACKAGE_RE))


def filter_corpus_text(x: str) -> str:
    return remove_long_strings(remove_stacktraces(x))


def normalize_symbols(x: str) -> str:
    t = rr(x, r"[^ .]{40,}")
    t = rr(t, T.PUNCT_CLASS + "{4,}")
    t = rr(t, T.SYMBOLS_RE)
    t = rr(t, r"([Cc]#)|#", r"\1")
    t = rr(t, r"([Cc]\+\+)|\+", r"\1")
    return squeeze_spaces(t)


def remove_paths(x: str) -> str:
    return rr(x, T.PATH_RE, r"\1\3 ")


def remove_large_tokens(x: str) -> str:
    return rr(x, T.LARGE_TOKEN_RE, "")


def tokenize_software_text(x: str) -> str:
    t = rr(x, r"([a-zA-Z])n't", r"\1 n't")
    return f"regexp_extract_all({t}, {q(T.re2(T.SW_TOKEN_RE))}, 0)"


def _norm_token(t: str) -> str:
    whens = " ".join(f"WHEN {t} = {q(k)} THEN {q(v)}" for k, v in T.CONTRACTIONS.items())
    return f"CASE {whens} ELSE {t} END"


def _droppable(t: str, keep_urls: bool) -> str:
    nums = ", ".join(q(w) for w in T.NUMBER_WORDS)
    rx = T.DROP_RE if keep_urls else T.DROP_URL_RE
    return f"(regexp_matches({t}, {q(rx)}) OR {t} IN ({nums}))"


def normalize_tokens(tokens: str, keep_urls: bool = False) -> str:
    return (f"list_filter(list_transform(list_transform({tokens}, lambda t: lower(t)), "
            f"lambda t: {_norm_token('t')}), lambda t: NOT {_droppable('t', keep_urls)})")


def normalize_text(x: str, keep_urls: bool = False) -> str:
    once = f"array_to_string({normalize_tokens(tokenize_software_text(x), keep_urls)}, ' ')"
    return f"array_to_string({normalize_tokens(tokenize_software_text(once), keep_urls)}, ' ')"


def clean_comment_quotes(x: str) -> str:
    return f"translate({x}, '`', ' ')"


def parse_tags(x: str) -> str:
    inner = rr(x, r"^<|>$", "")
    return f"CASE WHEN length({inner}) = 0 THEN []::VARCHAR[] ELSE string_split({inner}, '><') END"


def emoticon_label(x: str) -> str:
    h = f"regexp_matches({x}, {q(T.HAPPY_RE)})"
    s = f"regexp_matches({x}, {q(T.SAD_RE)})"
    return (f"CASE WHEN {h} AND {s} THEN 'BOTH_HS' WHEN {h} THEN 'HAPPY' "
            f"WHEN {s} THEN 'SAD' ELSE 'NA' END")


def social_tokenize(x: str) -> str:
    return f"regexp_extract_all({x}, {q(T.SOCIAL_TOKEN_RE)}, 0)"


def split_sentences(x: str) -> str:
    t = rr(x, T.SENT_SPLIT_RE, "\\1\n")
    return f"list_filter(list_transform(string_split({t}, chr(10)), lambda s: {strip_ws('s')}), lambda s: s <> '')"


def classifier_tokens(x: str) -> str:
    t = rr(f"lower(trim({x}))", r":[0-9]*\)", ":_xerrx_)")
    return f"regexp_extract_all({t}, {q(T.CLASSIFIER_TOKEN_RE)}, 0)"


# ------------------------------------------------------------------ code
from .functions import code as C  # noqa: E402


def unescape(x: str) -> str:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = f"replace({x}, {q(ent)}, {q(ch)})"
    return x


def extract_code_blocks(x: str) -> str:
    blocks = f"regexp_extract_all({x}, {q(C.CODE_BLOCK_RE)}, 1)"
    return (f"list_filter(list_transform({blocks}, lambda b: {strip_ws(unescape(rr('b', '<[^>]*>', '')))}), "
            "lambda b: b <> '')")


def _classify(m: str) -> str:
    name = f"regexp_extract({m}, {q(r'([A-Za-z_$][\w$]*)\s*\($')}, 1)"
    return (f"CASE WHEN starts_with({m}, '//') OR starts_with({m}, '/*') THEN "
            f"{{'kind': 'COM', 'token': trim({rr(m, r'^//|^/\*|\*/$', '')})}} "
            f"WHEN starts_with({m}, 'import') THEN "
            f"{{'kind': 'IM', 'token': {rr(m, r'^import\s+(static\s+)?', '')}}} "
            f"WHEN regexp_matches({m}, {q(r'^new\s')}) THEN "
            f"{{'kind': 'OC', 'token': {rr(m, r'^new\s+', '')}}} "
            f"WHEN starts_with({m}, '.') THEN {{'kind': 'MC', 'token': {name}}} "
            f"WHEN regexp_matches({m}, '[=;]$') THEN "
            f"{{'kind': 'VAR', 'token': regexp_extract({m}, {q(r'^([A-Z][\w$]*)')}, 1)}} "
            f"ELSE {{'kind': 'UMC', 'token': {name}}} END")


def ordered_distinct(lst: str) -> str:
    return f"list_filter({lst}, lambda od_v, od_i: list_position({lst}, od_v) = od_i)"


def code_tokens(x: str, keep=C.KINDS, distinct: bool = False) -> str:
    ms = f"regexp_extract_all({x}, {q(C.CODE_TOKEN_RE)}, 0)"
    kw = ", ".join(q(k) for k in C.CALL_KEYWORDS)
    kp = ", ".join(q(k) for k in keep)
    toks = (f"list_filter(list_transform({ms}, lambda m: {_classify('m')}), lambda t: "
            f"list_contains([{kp}], t.kind) AND NOT (t.kind = 'UMC' AND list_contains([{kw}], t.token)) "
            "AND t.token <> '')")
    return ordered_distinct(toks) if distinct else toks


def code_token_strings(x: str, keep=C.KINDS, distinct: bool = True) -> str:
    toks = f"list_transform({code_tokens(x, keep, False)}, lambda t: t.token)"
    # distinct over (kind, token) first, as in Spark, then project the token
    if distinct:
        toks = f"list_transform({code_tokens(x, keep, True)}, lambda t: t.token)"
    return toks


def lex_code(x: str) -> str:
    return f"regexp_extract_all({x}, {q(C.LEX_RE)}, 0)"


# ------------------------------------------------------------------ entities
from .functions import ortho as OR  # noqa: E402


def token_type(t: str) -> str:
    u, d = f"regexp_matches({t}, {q(OR.UPPER)})", f"regexp_matches({t}, {q(OR.DIGIT)})"
    lo, o = f"regexp_matches({t}, {q(OR.LOWER)})", f"regexp_matches({t}, {q(OR.OTHER)})"
    fu = f"regexp_matches(left({t}, 1), {q(OR.UPPER)})"
    return (f"CASE WHEN NOT {d} AND NOT {lo} AND NOT {o} THEN 'AllUpper' "
            f"WHEN NOT {u} AND NOT {lo} AND NOT {o} THEN 'AllDigit' "
            f"WHEN NOT {u} AND NOT {d} AND NOT {lo} THEN 'AllSymbol' "
            f"WHEN NOT {lo} AND NOT {o} THEN 'AllUpperDigit' "
            f"WHEN NOT {d} AND NOT {lo} THEN 'AllUpperSymbol' "
            f"WHEN NOT {u} AND NOT {lo} THEN 'AllDigitSymbol' "
            f"WHEN NOT {lo} THEN 'AllUpperDigitSymbol' "
            f"WHEN {fu} THEN 'InitUpper' "
            f"WHEN NOT {d} AND NOT {o} THEN 'AllLetter' "
            f"WHEN NOT {o} THEN 'AllAlnum' ELSE 'NO' END")


def token_shape(t: str) -> str:
    ch = ("CASE WHEN regexp_matches(c, '\\p{Lu}') THEN 'U' WHEN regexp_matches(c, '\\p{Ll}') THEN 'L' "
          "WHEN regexp_matches(c, '\\p{Nd}') THEN 'D' WHEN c IN ('.', '_') THEN '.' "
          "WHEN c IN ('(', '{', '[', '<') THEN '(' WHEN c IN (')', '}', ']', '>') THEN ')' ELSE '-' END")
    return (f"array_to_string(list_transform(list_filter(string_split({t}, ''), lambda c: c <> ''), "
            f"lambda c: {ch}), '')")


def tf(b: str) -> str:
    return f"CASE WHEN {b} THEN 'T' ELSE 'F' END"


def ortho_cols(t: str) -> dict[str, str]:
    cols = {"w": t, "wl": f"lower({t})", "type": token_type(t),
            "dot": tf(f"contains({t}, '.')"), "brac": tf(f"ends_with({t}, '()')"),
            "uscr": tf(f"contains({t}, '_')"),
            "init_cap": tf(f"regexp_matches(left({t}, 1), {q(OR.UPPER)})"),
            "ccase": tf(f"regexp_matches({t}, {q(OR.CAMEL_RE)})"),
            "api_ptrn": tf(f"(regexp_matches({t}, {q(OR.API_CALL_RE)}) OR "
                           f"regexp_matches({t}, {q(OR.API_DOTTED_RE)}))")}
    for p in range(1, 5):
        cols[f"p{p}"] = f"left({t}, {p})"
    for s in range(1, 5):
        cols[f"s{s}"] = f"right({t}, {s})"
    return cols


def replace_code_with_tokens(x: str) -> str:
    """T4 in SQL: split on <pre ...>, each later piece = code tokens + rest."""
    at = "instr(lower(p), '</pre>')"
    code = f"CASE WHEN {at} > 0 THEN substr(p, 1, {at} - 1) ELSE p END"
    toks = code_token_strings(unescape(rr(code, "<[^>]*>", " ")))
    piece = (f"CASE WHEN i = 1 THEN p ELSE concat_ws(' ', array_to_string({toks}, ' '), "
             f"CASE WHEN {at} > 0 THEN substr(p, {at} + 6) ELSE '' END) END")
    return (f"array_to_string(list_transform(string_split_regex({x}, '(?i)<pre[^>]*>'), "
            f"lambda p, i: {piece}), ' ')")


def format_post(x: str) -> str:
    return html_to_text(replace_code_with_tokens(x))


def process_text(x: str, filter_corpus: bool = True) -> str:
    t = filter_corpus_text(x) if filter_corpus else x
    return normalize_symbols(normalize_text(remove_paths(t)))
