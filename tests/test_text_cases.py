"""Text operators on small literal inputs; expectations written from the
operator definitions (README, 'Text operators')."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import code as C
from quarry.functions import ortho as OR
from quarry.functions import text as T


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "x string").select(col(F.col("x")).alias("y")).first()["y"]


def test_html_to_text(spark):
    html = "<html><head><style>p{}</style><script>var a='<p>';</script></head><body><!-- c -->" \
           "<p>Hello&amp;bye</p><p>a&lt;b ===== c</p></body></html>"
    assert one(spark, T.html_to_text, html) == "Hello&bye a<b c"


def test_word_punct_quality(spark):
    df = spark.createDataFrame([("a, b|c! d",)], "x string")
    r = df.select(T.word_count("x").alias("w"), T.punct_count("x").alias("p"),
                  T.line_quality("x").alias("q")).first()
    assert (r["w"], r["p"]) == (3, 3)  # 'a', 'b|c', 'd' ; ',', '|', '!'
    assert r["q"] == pytest.approx(1.0)


def test_stacktrace_and_long_strings(spark):
    s = "boom at com.foo.Bar.run(Bar.java:12) at java.lang.Thread.run(Native Method) end"
    assert one(spark, T.remove_stacktraces, s) == "boom end"
    s2 = "x 0101.1100.0011.1111 org.apache.commons.lang.text.util y"
    assert one(spark, T.remove_long_strings, s2) == "x y"


def test_normalize_symbols_keeps_csharp_cpp(spark):
    assert one(spark, T.normalize_symbols, "C# and c++ but #tag a+b (x)") == "C# and c++ but tag ab x "


def test_tokenizer_protects_software_terms(spark):
    toks = one(spark, T.tokenize_software_text,
               "Use com.a.b.Foo() or getMax() with C# and C++; see http://x.org/a?b=1 now, can't.")
    assert "com.a.b.Foo()" in toks and "getMax()" in toks and "C#" in toks and "C++" in toks
    assert "http://x.org/a?b=1" in toks
    assert "ca" in toks and "n't" in toks


def test_normalize_text_drops_numbers_urls_symbols(spark):
    out = one(spark, T.normalize_text, "I can't see 3.14 or 2nd http://a.io x@y.com , + - Go!")
    assert out == "i can not see or 2nd go"
    assert one(spark, T.normalize_query, "see http://a.io now") == "see http://a.io now"


def test_split_sentences(spark):
    assert one(spark, T.split_sentences, "One. Two!  Three?\nFour") == ["One.", "Two!", "Three?", "Four"]


def test_parse_tags_and_entities(spark):
    assert one(spark, T.parse_tags, "<java><swing>") == ["java", "swing"]
    assert one(spark, T.parse_tags, "") == []
    assert one(spark, T.parse_entities, "a<_ent_>b c") == ["a", "b c"]
    assert one(spark, T.parse_entities, "") == ["<unk>"]
    assert one(spark, T.parse_user_tags, "Java, android ,, java") == ["java", "android"]


def test_classifier_tokens(spark):
    assert one(spark, T.classifier_tokens, "Error at Foo(Foo.java:12) x") == \
        ["error", "at", "foo", "(", "foo", ".", "java", ":", "_xerrx_", ")"]


def test_emoticons(spark):
    assert one(spark, T.emoticon_label, "great :)") == "HAPPY"
    assert one(spark, T.emoticon_label, "bad :(") == "SAD"
    assert one(spark, T.emoticon_label, ":) :(") == "BOTH_HS"
    assert one(spark, T.emoticon_label, "plain") == "NA"
    for text in ("http://example.org", "f(x)", "List<3", "(8 bits)", "x;)"):
        assert one(spark, T.emoticon_label, text) == "NA", text


def test_code_blocks_and_tokens(spark):
    html = "<p>x</p><pre><code>import java.util.List;\nList l = new ArrayList();\nl.add(1);" \
           "\nfoo(2); // note\n</code></pre><p><code> </code></p>"
    assert one(spark, C.extract_code_blocks, html) == [
        "import java.util.List;\nList l = new ArrayList();\nl.add(1);\nfoo(2); // note"]
    toks = one(spark, lambda c: C.code_tokens(C.extract_code_blocks(c)[0]), html)
    kinds = [(t["kind"], t["token"]) for t in toks]
    assert kinds == [("IM", "java.util.List"), ("VAR", "List"), ("OC", "ArrayList"),
                     ("MC", "add"), ("UMC", "foo"), ("COM", "note")]


def test_replace_code_with_tokens(spark):
    html = "<p>see</p><pre><code>Map m = new HashMap();\nm.put(1);</code></pre><p>end</p>"
    out = one(spark, C.replace_code_with_tokens, html)
    assert "Map HashMap put" in out and out.startswith("<p>see</p>") and out.endswith("<p>end</p>")


def test_lex_code(spark):
    assert one(spark, C.lex_code, 'x = foo("a b", 3.5f);') == ["x", "=", "foo", "(", '"a b"', ",", "3.5f", ")", ";"]


@pytest.mark.parametrize("tok,typ,shape", [
    ("ABC", "AllUpper", "UUU"), ("123", "AllDigit", "DDD"), ("#$", "AllSymbol", "--"),
    ("A1", "AllUpperDigit", "UD"), ("A-", "AllUpperSymbol", "U-"), ("1-", "AllDigitSymbol", "D-"),
    ("A1-", "AllUpperDigitSymbol", "UD-"), ("Java", "InitUpper", "ULLL"), ("java", "AllLetter", "LLLL"),
    ("java8", "AllAlnum", "LLLLD"), ("get()", "NO", "LLL()")])
def test_token_type_and_shape(spark, tok, typ, shape):
    assert one(spark, OR.token_type, tok) == typ
    assert one(spark, OR.token_shape, tok) == shape


def test_orthographic_features(spark):
    o = one(spark, OR.orthographic_features, "getMaxSize()")
    assert (o["ccase"], o["brac"], o["api_ptrn"], o["p2"], o["s3"]) == ("T", "T", "T", "ge", "e()")


def test_parse_tags_without_topic(spark):
    assert one(spark, lambda c: T.parse_tags_without(c, "java"), "<java><swing>") == ["swing"]
    assert one(spark, lambda c: T.parse_tags_without(c, "java"), "<java>") == []


def test_remove_paths_unicode_boundaries(spark):
    assert one(spark, T.remove_paths, "see C:\\\\dir\\\\sub now") == "see   now"
    assert one(spark, T.remove_paths, "x C:\\\\dir\\\\subé") == "x  "
    assert one(spark, T.remove_paths, "é\\\\dir\\\\sub y") == "é  y"
    assert one(spark, T.remove_paths, "  \\\\dir\\\\sub y") == "  \\\\dir\\\\sub y"


def test_search_tokens_are_runs_of_non_space(spark):
    from quarry.operators.sparse import analyzer
    got = one(spark, analyzer, "The C++ and c#, .net java.util.Map x")
    assert got == ["c++", "c#,", ".net", "java.util.map"]
    assert one(spark, lambda c: analyzer(c, stop=("c++",)), "the C++") == ["the"]


def test_upper_case_pre_keeps_the_prose(spark):
    from quarry.functions.code import replace_code_with_tokens
    got = one(spark, replace_code_with_tokens, "a <PRE>m.get(x);</PRE> prose")
    assert got.endswith("prose") and got.startswith("a ")


def test_long_strings_list_form(spark):
    assert one(spark, T.remove_long_strings_list, "a " + "x" * 30 + " b " + "y" * 29) == "a  b " + "y" * 29


def test_tag_lists_of_an_empty_table(spark):
    df = spark.createDataFrame([("<java>",), ("<java><x>",)], "tags string")
    assert [r.tags for r in T.tag_lists(df, "java").collect()] == [[], ["x"]]
    assert [r.tags for r in T.tag_lists(df.limit(0), "java").collect()] == [["<unk>"]]
