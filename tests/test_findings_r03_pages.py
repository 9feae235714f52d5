"""Findings of the third review: texts of pages are used to their end."""

from hashlib import md5

import pytest
from compare import canonical, with_sql

from tessera.plans import query_plans as P
from tessera.sources import html as H

LONG = "several words stand in every line of it " * 100
CASES = {
    "long": (f"<p>{LONG}</p><p>the end</p>", f"{LONG.strip()}\nthe end"),
    "long, other end": (f"<p>{LONG}</p><p>another end</p>", f"{LONG.strip()}\nanother end"),
    "long words": ("<p>" + "a b c " * 1000 + "</p><p>the end</p>", "a b c " * 1000 + "the end"),
    "section": ("<p>before <![foo bar]></p><p>the end</p>", "before the end"),
    "long, section": (f"<nav>menu</nav><p>{LONG}<![1]></p><p>the end</p>", f"{LONG.strip()}\nthe end"),
    "open nav": (f"<nav>menu</nav><p>{LONG}</p><nav class=x><p>the end</p>", f"{LONG.strip()}\nthe end"),
    "open nav, nav": (f"<p>{LONG}</p><nav>x<nav>menu</nav><p>the end</p>", f"{LONG.strip()}\nthe end"),
    "nav ends in comment": (f"<p>{LONG}</p><nav><!-- </nav> --><p>the end</p>", f"{LONG.strip()}\nthe end"),
    "nav ends in script": (f"<p>{LONG}</p><nav>menu<script>'</nav><p>the end</p></script>", f"{LONG.strip()}\nthe end"),
    "open script": (f"<p>{LONG}</p><script><p>the end</p>", f"{LONG.strip()}\nthe end"),
}


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, f"https://a.example/{i}", f"<html><head><title>t</title></head><body>{html}</body></html>") for i, (html, _) in enumerate(CASES.values())]
    rows.append((len(rows), "https://a.example/head", f"<html><head><meta name='author' content='Ann'><body><p>{LONG}</p><p>the end</p></body></html>"))
    spark.createDataFrame(rows, "page_id long, url string, html string").toPandas().to_parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def test_whole_texts(spark, folder):
    found = P.extracted_pages(spark, folder).toPandas()
    assert canonical(found) == canonical(with_sql(P.ORACLES["extracted_pages"], folder))
    whole = [text for _, text in CASES.values()] + [f"{LONG.strip()}\nthe end"]
    assert dict(zip(found["page_id"], found["content"])) == {i: md5(text.encode()).hexdigest() for i, text in enumerate(whole)}


def test_cut_only_where_asked():
    page = CASES["long"][0]
    assert H.extract(page)["content"].endswith("\nthe end") and H.extract(page, 2000)["content"] == LONG[:2000].strip()


def test_number_of_thousands_of_digits():
    assert H.extract(f"<p>before &#{'9' * 5000}; &#{'0' * 5000}65; the end</p>")["content"] == "before � A the end"


def test_parser_that_fails_midway(monkeypatch):
    def feed(page, html):
        page.handle_data("before")
        raise AssertionError

    monkeypatch.setattr(H._Page, "feed", feed)
    assert H.extract("<p>before &amp; the end</p>")["content"] == "before & the end"
