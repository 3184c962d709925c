import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "kwargs", "expected"),
    [
        ("HELLO WORLD", {}, "hello world"),
        ("café", {}, "cafe"),
        ("Hello, World!", {"lower": False}, "Hello World"),
        ("  hello   world  ", {}, "hello world"),
        ("United States (USA)", {}, "united states usa"),
        (None, {}, ""),
        ("Ｆｕｌｌ Ñandú", {}, "full nandu"),
        ("ﬁn … Żółw ½ ß", {}, "fin zołw 1 2 ß"),
        ("Café, Été", {"accents": False, "punctuation": False}, "cafe\u0301, e\u0301te\u0301"),
        ("привет Ёж", {}, "привет еж"),
    ],
)
def test_normalize(spark, raw, kwargs, expected):
    assert one(spark, raw, lambda x: T.normalize(x, **kwargs)) == expected


def test_tokens(spark):
    assert one(spark, "Hello world!", T.tokens) == ["hello", "world"]
    assert one(spark, "Hello,   World!  ", T.clean) == "hello world"
    assert set(one(spark, "USA (United States), UK (United Kingdom)", T.aliases_of)) >= {"USA", "UK"}
    assert one(spark, " a | b||", T.split_aliases) == ["a", "b"]
    assert one(spark, "The big cat was into it", T.evidence_tokens) == ["big", "cat", "was"]


def test_variants(spark):
    assert one(spark, "small ring", T.with_typo) == "smll ring"
    assert one(spark, "one two", T.with_typo) == "one two"
    assert one(spark, "a (b) c", T.without_parentheses) == "a c"
    assert one(spark, "first, second", T.first_clause) == "first"
    assert one(spark, "ab", lambda x: T.char_ngrams(x, 3)) == []
    assert one(spark, "abcd", lambda x: T.char_ngrams(x, 3)) == ["abc", "bcd"]


@pytest.mark.parametrize(("raw", "case"), [("Hello World", "title_case"), ("HELLO", "uppercase"), ("hello", "lowercase"), ("heLLo", "mixed")])
def test_letter_case(spark, raw, case):
    assert one(spark, raw, T.letter_case) == case


def test_redaction(spark):
    assert one(spark, "api_key=abc123 x", T.redact_keys) == "api_key=*** x"
    assert one(spark, "```x```", T.prompt_safe) == "x"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.7, 0.7], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = df.select(V.cosine(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("z")), V.euclidean(F.col("a"), F.col("z")), V.softmax(F.col("a"), 10.0), V.logsumexp(F.col("a"))).first()
    assert r[0] == pytest.approx(math.sqrt(0.5)) and r[1] == 0.0 and r[2] == 1.0
    assert sum(r[3]) == pytest.approx(1) and r[3][0] > 0.99
    assert r[4] == pytest.approx(math.log(math.e + 1))


def test_finite(spark):
    df = spark.createDataFrame([([1.0, float("nan")],)], "a array<double>")
    with pytest.raises(Exception, match="not finite"):
        df.select(V.finite(F.col("a"))).collect()
    with pytest.raises(ValueError):
        V.truncated(F.col("a"), 0, 4)
