"""Text column functions.

Every function maps Columns to a Column and compiles to native Catalyst
expressions (regexp_replace / regexp_extract_all / transform / filter), so
text cleaning runs inside whole-stage code generation, row by row, with no
Python in the hot path.  Regexes stay in the common subset of Java regex and
RE2 so the SQL oracle reads them the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# ASCII punctuation (Python's string.punctuation) as a character class.
PUNCT_CLASS = r"[!-/:-@\[-`{-~]"
# Word splitter of the quality score: space or any ASCII punctuation but '|'.
WORD_SPLIT = r"[ !-/:-@\[-`{}~]"
SEP_RE = r"(=|-|\+|\*|#|_){4,}"
WS_RE = r"[ \t\n\f\r]+"
LINE_QUALITY_THRESHOLD = 1.6
LONG_TEXT = 1000

STACKTRACE_RE = (r" at ([a-zA-Z_$][a-zA-Z0-9_$]*\.)+[a-zA-Z_$][a-zA-Z0-9_$]*\((([a-zA-Z_$]"
                 r"[a-zA-Z0-9_$]{1,30}\.java:[0-9]{1,4})|([a-zA-Z]{1,30} [a-zA-Z]{1,30}))\)")
BINARY_RUN_RE = r"([01]{4,20}\.){3,30}[01]{4,20}"
LONG_PACKAGE_RE = r"([a-zA-Z0-9_$]{2,50}\.){5,}[a-zA-Z0-9_$]{2,50}"
# Windows paths: "C:\\a\\b" or "x\\a\\b" with word boundaries at both ends.
# The boundaries are spelled out with Unicode word characters (the meaning
# of \b differs between regex engines and JVM versions): the character before
# the path is captured and put back by the replacement, and the path must end
# with a word character.
PATH_RE = (r"(^|[^\p{L}\p{N}_])([Cc]:(?:\\\S{2,})+\\\S+[\p{L}\p{N}_])"
           r"|([\p{L}\p{N}_])((?:\\\S{2,})+\\\S+[\p{L}\p{N}_])")
LARGE_TOKEN_RE = r"[a-f0-9]{50,}|[*=+~#!_-]{3,}"
SYMBOLS_RE = r"[!\"%&$^*@`~(),?=/|<:;>{}\[\]-]"

# Tokenizer of software text: alternatives in priority order (first wins).
# Possessive quantifiers (*+, ++) only where the character that must follow
# is outside the quantified class, so they never change what matches; they
# stop the JVM matcher from backtracking through every word.  ``re2`` gives
# the plain form for engines without possessive quantifiers.
SW_TOKEN_RE = "|".join([
    r"(?:https?|ftp|mailto|file)://\S*+",                      # URL
    r"[a-zA-Z0-9_.+-]++@[a-zA-Z0-9-]++(?:\.[a-zA-Z0-9-]++)++",   # e-mail
    r"[a-zA-Z_$][a-zA-Z0-9_$]*+(?:\.[a-zA-Z_$][a-zA-Z0-9_$]*+)++(?:\(\))?",  # dotted API
    r"[a-zA-Z_$][a-zA-Z0-9_$]*+\(\)",                          # call
    r"==|!=|>=|<=|&&|\|\|",                                    # operators
    r"\.[Nn][Ee][Tt]|[Cc]#|[Cc]\+\+",                          # .net, C#, C++
    r"#[a-zA-Z0-9_]++|@[a-zA-Z0-9_]++",                        # hashtag, mention
    r"\d++%",                                                  # percentage
    r"n't|'[a-zA-Z]++",                                        # contraction pieces
    r"[\p{L}\p{N}_]++(?:\.[\p{L}\p{N}_]++)*+",                 # word / number
    r"[^\s\p{L}\p{N}_]",                                       # one symbol
])


# JVM fast path tried first: a word run followed by a character that no
# earlier alternative can continue with (not ':' of a URL scheme, not "'" of
# n't, not $ . ( @ # + - % of API / e-mail / C# / C++ / percent forms).  Where
# it matches, every earlier alternative fails and the word alternative yields
# the same token, so the token sequence is unchanged; it only skips the
# failing scans of the other alternatives for ordinary words.
SW_WORD_FAST = r"[\p{L}\p{N}_]++(?=[\s,;!?\"\)\]\}<>=*/|&~^`]|$)"
SW_TOKEN_RE_JVM = SW_WORD_FAST + "|" + SW_TOKEN_RE


def re2(pattern: str) -> str:
    """The same pattern without possessive quantifiers (RE2 / DuckDB)."""
    import re as _re
    return _re.sub(r"(\]|\)|\\S|\\d)(\*|\+)\+", r"\1\2", pattern)


# Normalised forms of contraction pieces (token -> norm).
CONTRACTIONS = {"n't": "not", "'ve": "have", "'re": "are", "'m": "am", "'ll": "will",
                "'d": "would", "'s": "is", "ca": "can", "wo": "will"}
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen "
                "fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty "
                "sixty seventy eighty ninety hundred thousand million billion trillion").split()
# Token drop tests (whole token unless noted): no letter or digit; number-like;
# one symbol character; URL (prefix); e-mail.
NO_ALNUM = r"[^\p{L}\p{N}]*"
NUMBER_LIKE = r"[+-]?[0-9.,:/]*[0-9][0-9.,:/]*"
ONE_SYMBOL = r"\p{S}"
URL_PREFIX = r"(?:https?|ftp|mailto|file)://|www\."
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)+"
# ... evaluated as one anchored alternation (one match per token).
DROP_RE = "^(?:" + "|".join([NO_ALNUM + "$", NUMBER_LIKE + "$", ONE_SYMBOL + "$"]) + ")"
DROP_URL_RE = "^(?:" + "|".join([NO_ALNUM + "$", NUMBER_LIKE + "$", ONE_SYMBOL + "$",
                                 URL_PREFIX, EMAIL + "$"]) + ")"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_markup(html) -> Column:
    """T1 html_to_text: drop script/style/comments, tags -> space, unescape
    the common entities (&amp; last)."""
    t = _c(html)
    t = F.regexp_replace(t, r"(?is)<script[^>]*>.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                    ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return t


def html_to_text(html) -> Column:
    """T1 + T5 + T6: the text of an HTML body, separators stripped, spaces squeezed."""
    return squeeze_whitespace(strip_separators(strip_markup(html)))


def drop_code_blocks(html) -> Column:
    """Remove <pre> blocks (with their content)."""
    return F.regexp_replace(_c(html), r"(?is)<pre[^>]*>.*?</pre>", " ")


def strip_separators(text) -> Column:
    """T5: runs of >= 4 of = - + * # _ become a space."""
    return F.regexp_replace(_c(text), SEP_RE, " ")


STRIP_RE = r"^[ \t\n\f\r]+|[ \t\n\f\r]+$"


def strip_ws(text) -> Column:
    """Remove leading/trailing whitespace of any kind (trim() only removes spaces)."""
    return F.regexp_replace(_c(text), STRIP_RE, "")


def squeeze_whitespace(text) -> Column:
    """All whitespace runs -> one space, trimmed."""
    return F.trim(F.regexp_replace(_c(text), WS_RE, " "))


def punct_count(text) -> Column:
    """T7 (punctuation): number of ASCII punctuation characters."""
    t = _c(text)
    return F.length(t) - F.length(F.regexp_replace(t, PUNCT_CLASS, ""))


def word_count(text) -> Column:
    """T7 (words): non-empty pieces after splitting on space/punctuation but '|'."""
    return F.size(F.filter(F.split(_c(text), WORD_SPLIT), lambda s: s != ""))


def line_quality(text) -> Column:
    """Words / max(punctuation, 1)."""
    return word_count(text).cast("double") / F.greatest(punct_count(text), F.lit(1)).cast("double")


def keep_by_quality(text, threshold: float = LINE_QUALITY_THRESHOLD) -> Column:
    """F8 predicate: short texts always pass, long ones need quality >= threshold."""
    return (F.length(_c(text)) <= LONG_TEXT) | (line_quality(text) >= threshold)


def squeeze_spaces(text) -> Column:
    return F.regexp_replace(_c(text), " +", " ")


def remove_stacktraces(text) -> Column:
    """T9: ' at pkg.Class.method(File.java:NN)' / '(Native Method)' frames."""
    return squeeze_spaces(F.regexp_replace(_c(text), STACKTRACE_RE, " "))


def remove_long_strings(text) -> Column:
    """Dotted binary runs and dotted names with >= 6 parts."""
    t = F.regexp_replace(_c(text), BINARY_RUN_RE, " ")
    t = F.regexp_replace(t, LONG_PACKAGE_RE, " ")
    return squeeze_spaces(t)


def remove_long_strings_list(text) -> Column:
    """T10, list form: binary runs, dotted names and any run of 30 or more
    non-space characters are deleted; nothing is put in their place."""
    t = F.regexp_replace(_c(text), BINARY_RUN_RE, "")
    t = F.regexp_replace(t, LONG_PACKAGE_RE, "")
    return F.regexp_replace(t, r"[^\x09-\x0D\x1C-\x20\x{85}\p{Z}]{30,}", "")


def filter_corpus_text(text) -> Column:
    """T9 then T10 (the corpus filter step)."""
    return remove_long_strings(remove_stacktraces(text))


def normalize_symbols(text) -> Column:
    """Long runs, punctuation runs, listed symbols; keep C#/C++ only."""
    t = F.regexp_replace(_c(text), r"[^ .]{40,}", " ")
    t = F.regexp_replace(t, PUNCT_CLASS + "{4,}", " ")
    t = F.regexp_replace(t, SYMBOLS_RE, " ")
    t = F.regexp_replace(t, r"([Cc]#)|#", "$1")
    t = F.regexp_replace(t, r"([Cc]\+\+)|\+", "$1")
    return squeeze_spaces(t)


def remove_paths(text) -> Column:
    """Windows-style paths."""
    return F.regexp_replace(_c(text), PATH_RE, "$1$3 ")


def remove_large_tokens(text) -> Column:
    """T12 option: hex runs of >= 50 and symbol runs of >= 3."""
    return F.regexp_replace(_c(text), LARGE_TOKEN_RE, "")


def tokenize_software_text(text) -> Column:
    """Array of tokens; URLs, e-mails, API calls, operators, .NET/C#/C++,
    hashtags and mentions stay whole; "n't" is split off its word first."""
    t = F.regexp_replace(_c(text), r"([a-zA-Z])n't", "$1 n't")
    return F.regexp_extract_all(t, F.lit(SW_TOKEN_RE_JVM), 0)


def _norm_token(low: Column) -> Column:
    """Norm of an already lower-cased token (contraction pieces mapped)."""
    e = None
    for k, v in CONTRACTIONS.items():
        e = (F.when(low == k, F.lit(v)) if e is None else e.when(low == k, F.lit(v)))
    return e.otherwise(low)


def _droppable(t: Column, keep_urls: bool) -> Column:
    return t.rlike(DROP_RE if keep_urls else DROP_URL_RE) | t.isin(*NUMBER_WORDS)


def normalize_tokens(tokens, keep_urls: bool = False) -> Column:
    """T14 one pass: lowercase norms (contractions mapped), then drop
    punctuation-only, number-like, single symbols and (unless kept) URLs/e-mails."""
    normed = F.transform(F.transform(_c(tokens), F.lower), _norm_token)
    return F.filter(normed, lambda t: ~_droppable(t, keep_urls))


def normalize_text(text, keep_urls: bool = False) -> Column:
    """T14 as applied by the corpus: tokenize + normalise, twice."""
    once = F.array_join(normalize_tokens(tokenize_software_text(text), keep_urls), " ")
    return F.array_join(normalize_tokens(tokenize_software_text(once), keep_urls), " ")


def normalize_query(text) -> Column:
    """Like T14 but URLs and e-mails are kept."""
    return normalize_text(text, keep_urls=True)


def clean_comment_quotes(text) -> Column:
    """Backticks become spaces."""
    return F.translate(_c(text), "`", " ")


def parse_tags(tags) -> Column:
    """T23: '<a><b>' -> ['a', 'b']."""
    inner = F.regexp_replace(_c(tags), r"^<|>$", "")
    return F.when(F.length(inner) == 0, F.array().cast("array<string>")).otherwise(
        F.split(inner, "><"))


def parse_tags_without(tags, topic: str) -> Column:
    """T23 variant: the tag list minus the topic tag; a row with no other tag
    has an empty list (see ``tag_lists`` for the empty table)."""
    return F.array_remove(parse_tags(tags), topic)


def tag_lists(df: DataFrame, topic: str, tags_col: str = "tags") -> DataFrame:
    """T23 over a table: one tag list per row, and the single list ['<unk>']
    when the table has no rows at all."""
    lists = df.select(parse_tags_without(tags_col, topic).alias("tags"))
    some = lists.limit(1).agg(F.count(F.lit(1)).alias("n"))  # one row
    unk = some.filter("n = 0").select(F.array(F.lit("<unk>")).alias("tags"))
    return lists.unionByName(unk)


def parse_entities(ents) -> Column:
    """T24: '<_ent_>'-joined string -> array; ['<unk>'] when empty."""
    arr = F.filter(F.split(F.coalesce(_c(ents), F.lit("")), "<_ent_>"), lambda s: s != "")
    return F.when(F.size(arr) == 0, F.array(F.lit("<unk>"))).otherwise(arr)


def parse_user_tags(s) -> Column:
    """Free text 'java, Android ' -> ['java', 'android'] (distinct, in order)."""
    parts = F.transform(F.split(F.lower(_c(s)), r"[,;\s]+"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def result_link(post_id) -> Column:
    """Link of a post."""
    return F.concat(F.lit("https://stackoverflow.com/questions/"), _c(post_id).cast("string"))


def answer_link(answer_id) -> Column:
    return F.concat(F.lit("https://stackoverflow.com/a/"), _c(answer_id).cast("string"))


def snippet_header(answer_id, score) -> Column:
    """Comment header placed above a snippet."""
    return F.format_string("// answer %s, score %s", _c(answer_id).cast("string"),
                           _c(score).cast("string"))


def emoticon_label(text) -> Column:
    """HAPPY / SAD / BOTH_HS / NA by emoticon presence."""
    happy = _c(text).rlike(HAPPY_RE)
    sad = _c(text).rlike(SAD_RE)
    return (F.when(happy & sad, "BOTH_HS").when(happy, "HAPPY").when(sad, "SAD")
            .otherwise("NA"))


# Emoticon patterns (fixed values): eyes, optional nose, mouth.
HAPPY_RE = r"\^_\^|[:=8](?:|o|O|-)[D)\]]"
SAD_RE = r"[:=8](?:|o|O|-)[(\[]"

# Social/software tokenizer (T19): emoticons, URLs, e-mail, hashtags,
# mentions, times, numbers, API forms, w(s) plurals and operators stay whole.
SOCIAL_TOKEN_RE = "|".join([
    r"(?:https?|ftp)://\S+|www\.\S+",
    r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)+",
    r"[:=;8xX]['\-o^]?[)\](\[}{<>dDpP3*|/\\]",
    r"\^_\^|<3",
    r"#[a-zA-Z0-9_]+|@[a-zA-Z0-9_]+",
    r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:[aApP][mM])?",
    r"[+-]?[0-9]+(?:[.,][0-9]+)*%?",
    r"[a-zA-Z_$][a-zA-Z0-9_$]*(?:\.[a-zA-Z_$][a-zA-Z0-9_$]*)+(?:\([^()\s]*\))?",
    r"[a-zA-Z_$][a-zA-Z0-9_$]*\([^()\s]*\)",
    r"[\p{L}]+\(s\)",
    r"==|!=|>=|<=|&&|\|\||->|\+\+|--",
    r"[\p{L}\p{N}_]+(?:['’][\p{L}]+)?",
    r"\S",
])


def social_tokenize(text) -> Column:
    """Tokens of social/software prose."""
    return F.regexp_extract_all(_c(text), F.lit(SOCIAL_TOKEN_RE), 0)


SENT_SPLIT_RE = r"([.!?])[ \t\n\f\r]+"


def split_sentences(text) -> Column:
    """Array of sentences (split after . ! ? followed by whitespace, and
    at line breaks), trimmed, empties dropped."""
    t = F.regexp_replace(_c(text), SENT_SPLIT_RE, "$1\n")
    return F.filter(F.transform(F.split(t, "\n"), strip_ws), lambda s: s != "")


def remove_stop_words(tokens, stop: tuple[str, ...]) -> Column:
    """Drop stop words, integers and single-character tokens."""
    return F.filter(_c(tokens), lambda t: ~F.lower(t).isin(*stop)
                    & ~t.rlike(r"^[0-9]+$") & (F.length(t) > 1))


# words of >= 2 word characters, or one of the listed punctuation marks
CLASSIFIER_TOKEN_RE = r"[\p{L}\p{N}_]{2,}|[|&#@~_'\"=\\/\-:;*.$()\[\]{}]"


def classifier_tokens(text) -> Column:
    """Lowercase; ':NN)' line references -> ':_xerrx_)'; words of >= 2
    chars or single listed punctuation."""
    t = F.regexp_replace(F.lower(F.trim(_c(text))), r":[0-9]*\)", ":_xerrx_)")
    return F.regexp_extract_all(t, F.lit(CLASSIFIER_TOKEN_RE), 0)


def results_to_json(*cols: str) -> Column:
    """One JSON record per result row."""
    return F.to_json(F.struct(*cols))
