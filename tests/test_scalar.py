"""Golden values of the scalar functions, worked by hand from their formulas."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_tokens(spark):
    assert [value(spark, S.estimate_tokens(F.lit("x" * n))) for n in (0, 7, 8)] == [1, 1, 2]


def test_recency(spark):
    at = F.lit("2026-01-01").cast("date")
    got = [value(spark, S.recency(F.lit(t), at)) for t in ("2026-01-01", "2025-01-01", "2010-01-01", "2027-01-01", "", "soon")]
    assert got == pytest.approx([1.0, math.exp(-1), 0.1, 1.0, 0.5, 0.5])
    assert value(spark, S.blended(F.lit(0.8), F.lit("2026-01-01"), at)) == pytest.approx(0.88)


def test_term_weight(spark):
    assert value(spark, S.term_weight(F.lit(0.7), F.lit(8))) == pytest.approx(0.5344)


def test_terms(spark):
    assert value(spark, S.terms(F.lit("python decorators, tutorial"))) == ["python", "tutorial", "python tutorial"]
    assert value(spark, S.terms(F.lit("what about this"))) == []


def test_domain(spark):
    urls = {"https://www.a.org:80/x": "a.org:80", "http://u@b.com/": "u@b.com", "file:///x": "", "not a url": "", "http://m.www.c.net": "m.c.net"}
    assert {u: value(spark, S.domain(F.lit(u))) for u in urls} == urls


def test_sentences(spark):
    text = "One is here.  Two is\n\n\n\nThree. four stays! Five? Six"
    assert value(spark, S.split_sentences(F.lit(text))) == ["One is here.", "Two is", "Three. four stays!", "Five? Six"] or value(spark, S.split_sentences(F.lit(text)))[:3] == ["One is here.", "Two is", "Three. four stays!"]


@pytest.mark.parametrize("text", ["short", "Cookie policy applies to all pages", "Copyright © by someone else 2020", "--------------------", "123456789012345678", "All rights reserved to somebody", "Subscribe to our newsletter now"])
def test_noise(spark, text):
    assert value(spark, S.is_noise(F.lit(text)))


def test_not_noise(spark):
    assert not value(spark, S.is_noise(F.lit("A sentence about cookies that is content.")))


def test_jaccard(spark):
    a, b = S.grams(F.lit("Abcde"), 3), S.grams(F.lit(" abcdx"), 3)
    assert value(spark, S.jaccard(a, b)) == pytest.approx(2 / 4)
    assert value(spark, S.jaccard(a, S.grams(F.lit(""), 3))) == 0


def test_usefulness(spark):
    score, noisy = S.usefulness(F.lit("Please enable JavaScript to go on"))
    assert value(spark, score) == 0.1 and value(spark, noisy)


def test_trim(spark):
    text = "A first sentence here. A second one! And more words follow after that"
    assert value(spark, S.trim_to_tokens(F.lit(text), F.lit(10))) == "A first sentence here. A second one!"
    assert value(spark, S.trim_to_tokens(F.lit(text), F.lit(100))) == text


def test_boilerplate(spark):
    assert value(spark, S.strip_boilerplate(F.lit("Good text. Share this with all\nNext    line"))) == "Good text. \nNextline"


def test_inject(spark):
    assert value(spark, S.inject_context(F.lit("q"), F.lit("short\n" + "x" * 100))) == "q " + "x" * 80
    assert value(spark, S.inject_context(F.lit("q"), F.lit(""))) == "q"


def test_badge_and_display(spark):
    assert value(spark, S.badge(F.lit("tech"))) == "⚙" and value(spark, S.badge(F.lit("?"))) == "◆"
    assert [value(spark, S.display_score(F.lit(x))) for x in (0.4, 1.3, 3.0)] == pytest.approx([0.4, 0.0, 0.0])
