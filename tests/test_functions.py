"""Scalar functions against plain Python on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from verso.functions import language, prompts, responses, text


def one(spark, value, **columns):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in columns.items())
    return spark.createDataFrame([tuple(columns.values())], schema).select(value.alias("v")).first().v


def test_trim_is_unicode_and_keeps_zero_width(spark):
    s = "\u3000\xa0\n a b \u2003\n"
    assert one(spark, text.trim(F.col("s")), s=s) == "a b"
    assert one(spark, text.trim(F.col("s")), s="\u200ba\u200b") == "\u200ba\u200b"
    assert one(spark, text.remove_zero_width(F.col("s")), s="a\u200bb\u200c\u200d\ufeffc") == "abc"
    assert one(spark, text.trim_end(F.col("s")), s=" a\n\n") == " a" and one(spark, text.trim_start(F.col("s")), s="\n a ") == "a "


@pytest.mark.parametrize("n", [0, 1, 11])
def test_placeholders(spark, n):
    s = "x" + "".join(f"[placeholder:ph_{k % 3}]$1\\1" for k in range(n)) + "y"
    df = text.let(spark.createDataFrame([(s,)], "s string"), "p", text.preprocess(F.col("s")))
    r = df.select("p.text", "p.names", text.restore_placeholders(F.col("p.text"), F.col("p.names")).alias("back")).first()
    assert r.back == s and len(r.names) == n and all(f"[placeholder:ph_{k}]" in r.text for k in range(n))
    assert one(spark, text.restore_placeholders(F.col("s"), F.col("a")), s="[placeholder:ph_9]", a=["x"]) == "[placeholder:ph_9]"


@pytest.mark.parametrize(
    "given, original, expected",
    [("Ensure -> X", "Ensure", "X"), ("Ensure ->  X ", "Ensure", " X "), ("Ensure ->\u3000X ", "Ensure", "X "), ("The->- X ", "The", "X"), ("The", "The", "The"), ("The - ", "The", "The - "), ("", "The", ""), ("X", "", "X"), ("a$1b -> c", "a$1b", "c"), ("Other", "The", "Other")],
)
def test_echo(spark, given, original, expected):
    assert one(spark, text.clean_echo(F.col("t"), F.col("o")), t=given, o=original) == expected


@pytest.mark.parametrize("s, tag", [("漢字", "zh-Hans"), ("漢字かな", "ja"), ("한글漢", "ko"), ("[1]", "en"), ("Привет", "und"), ("123", "und"), ("", "und")])
def test_detect(spark, s, tag):
    assert one(spark, language.detect_tag(F.col("s")), s=s) == tag


def test_codes(spark):
    assert one(spark, language.tag_of_code(F.col("s")), s="ZH-tw") == "zh-Hant" and one(spark, language.tag_of_code(F.col("s")), s="und") is None
    assert language.parse_code("HUN") == "hu" and language.parse_code("xx") is None


def marked(*parts):
    """An answer with the parts' indices and texts; white space varies with the index."""
    return "".join(f"[SEG_{i}]{' ' * (i % 3)}\n{t}{chr(10) * (i % 2 + 1)}" for i, t in parts)


CASES = [
    (marked((4, "vier"), (5, "fünf")), 2, ["vier", "fünf"]),
    (marked((9, "neun"), (2, "zwei"), (7, "sieben")), 3, ["zwei", "sieben", "neun"]),
    ("Sure, here it is:\n" + marked((0, "\u3000breit\u3000")), 1, ["breit"]),
    (marked((1, ""), (0, " \t")), 2, ["", ""]),
    ("[SEG_2]a[SEG_2]b", 2, ["a", "b"]),
    (marked((0, "x [SEG_] y [SEG_-1] z")), 1, ["x [SEG_] y [SEG_-1] z"]),
    (marked((0, "a"), (1, "b")), 5, "Expected 5 translations in batch response, but found 2"),
    (marked((0, "a"), (1, "b")), 1, "found 2"),
    ("", 1, "found 0"),
    (f"[SEG_{1 << 64}]x", 1, "Invalid segment index"),
    ("[SEG_" + "9" * 60 + "]x", 1, "Invalid segment index"),
]


@pytest.mark.parametrize("response, n, expected", CASES)
def test_parse(spark, response, n, expected):
    got = one(spark, responses.parse_batch(F.col("r"), F.col("n")), r=response, n=n)
    if isinstance(expected, str):
        assert expected in got.error and got.ok is None
    else:
        assert [x.text for x in got.ok] == expected and got.error is None


def test_parse_requested(spark):
    df = spark.createDataFrame([("[SEG_1]a[SEG_1]b", 2, [1, 2]), ("[SEG_2]a[SEG_1]b", 2, [1, 2])], "r string, n int, a array<int>")
    got = df.select(responses.parse_batch(F.col("r"), F.col("n"), F.col("a")).alias("p")).collect()
    assert got[0].p.error and [x.text for x in got[1].p.ok] == ["b", "a"]


def test_bodies_and_answers(spark):
    assert one(spark, responses.openai_text(F.col("s")), s='{"choices":[{"message":{"content":"hi"}}]}') == "hi"
    assert one(spark, responses.openai_text(F.col("s")), s='{"choices":[{"message":{}}]}') == "" and one(spark, responses.openai_text(F.col("s")), s='{"choices":[]}') is None
    assert one(spark, responses.anthropic_text(F.col("s")), s='{"content":[{"type":"thinking","thinking":"t"},{"type":"text","text":"x"}]}') == "x"
    assert one(spark, responses.status_error(F.col("n"), F.col("s")), n=429, s="b").kind == "RateLimited" and one(spark, responses.status_error(F.col("n"), F.col("s")), n=200, s="b") is None
    assert one(spark, responses.status_error(F.col("n"), F.col("s")), n=500, s="b").message == "API request failed: b"
    assert one(spark, prompts.endpoint(F.col("s"), "/v1/messages", "d"), s="http://h//") == "http://h/v1/messages"


def test_names(spark):
    assert one(spark, text.output_name(F.col("s")), s="/a/b.c/book.epub") == "/a/b.c/book_translated.epub"
    assert one(spark, text.basename(F.col("s"), "md"), s="/a/") == "unknown.md" and one(spark, text.basename(F.col("s"), "md"), s="C:\\x\\y.md") == "y.md"
    assert one(spark, text.first_code_text(F.col("s")), s="<pre>p</pre><code> c </code>") == "c" and one(spark, text.code_tag_count(F.col("s")), s="<pre><code>") == 2
