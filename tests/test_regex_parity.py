"""Property test: text functions give the same result in Spark (Java regex,
with possessive quantifiers and the tokenizer fast path) and in DuckDB (RE2,
plain forms) on random software-flavoured strings."""

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry import oracle_text as S
from quarry.functions import code as C
from quarry.functions import text as T

PIECES = ["<pre><code>", "</code></pre>", "<code>", "</code>", ":)", ":(", ";-)", "<3", "^_^",
          "12:30pm", "w(s)", "->", "foo", "Bar", "x1", "com.a.b", "getMax()", "a.b()", "C#", "c++", "C++", ".NET", "#tag",
          "@user", "me@x.org", "http://a.io/p?q=1", "can't", "it's", "3.14", "1.2.3", "50%", "==",
          "&&", "||", "!", "?", ",", ";", ":", "(", ")", "[", "]", "{", "}", "<p>", "</p>", "é", "ß",
          "naïve", "$var", "a_b", "x.y.z.w.v.u", "0101.1100.0011.1111", "=====", "---", "+", "'",
          "\"q\"", "at a.b.C.m(F.java:12)", "C:\\\\dir\\\\sub", "👍", "½", "\t", "\n", "  "]

texts = st.lists(st.sampled_from(PIECES), min_size=0, max_size=25).map(
    lambda xs: "".join(x if i % 3 else x + " " for i, x in enumerate(xs)))

CASES = [
    ("tokenize", lambda c: F.array_join(T.tokenize_software_text(c), "\u0001"),
     lambda x: f"array_to_string({S.tokenize_software_text(x)}, chr(1))"),
    ("normalize", T.normalize_text, S.normalize_text),
    ("normalize_query", T.normalize_query, lambda x: S.normalize_text(x, keep_urls=True)),
    ("symbols", T.normalize_symbols, S.normalize_symbols),
    ("filter_corpus", T.filter_corpus_text, S.filter_corpus_text),
    ("html", T.html_to_text, S.html_to_text),
    ("quality", lambda c: F.round(T.line_quality(c), 6), lambda x: f"round({S.line_quality(x)}, 6)"),
    ("sentences", lambda c: F.array_join(T.split_sentences(c), "\u0001"),
     lambda x: f"array_to_string({S.split_sentences(x)}, chr(1))"),
    ("code_tokens", lambda c: F.array_join(C.code_token_strings(c), "\u0001"),
     lambda x: f"array_to_string({S.code_token_strings(x)}, chr(1))"),
    ("social", lambda c: F.array_join(T.social_tokenize(c), "\u0001"),
     lambda x: f"array_to_string({S.social_tokenize(x)}, chr(1))"),
    ("emoticons", T.emoticon_label, S.emoticon_label),
    ("classifier_tokens", lambda c: F.array_join(T.classifier_tokens(c), "\u0001"),
     lambda x: f"array_to_string({S.classifier_tokens(x)}, chr(1))"),
    ("paths", T.remove_paths, S.remove_paths),
    ("separators", T.strip_separators, S.strip_separators),
    ("large_tokens", T.remove_large_tokens, S.remove_large_tokens),
    ("word_count", T.word_count, lambda x: f"CAST({S.word_count(x)} AS INTEGER)"),
    ("code_blocks", lambda c: F.array_join(C.extract_code_blocks(c), "\u0001"),
     lambda x: f"array_to_string({S.extract_code_blocks(x)}, chr(1))"),
    ("lex", lambda c: F.array_join(C.lex_code(c), "\u0001"),
     lambda x: f"array_to_string({S.lex_code(x)}, chr(1))"),
    ("replace_code", C.replace_code_with_tokens, S.replace_code_with_tokens),
]


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(texts, min_size=20, max_size=20))
def test_spark_and_duckdb_agree(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "id int, src_txt string")
    con = duckdb.connect()
    con.register("t", df.toPandas())
    for name, sfn, dfn in CASES:
        got = {r["id"]: r["y"] for r in df.select("id", sfn(F.col("src_txt")).alias("y")).collect()}
        want = dict(con.execute(f"SELECT id, {dfn('src_txt')} AS y FROM t").fetchall())
        assert got == want, (name, [(batch[i], got[i], want[i]) for i in got if got[i] != want[i]][:2])
