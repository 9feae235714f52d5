"""Readers, pages and providers."""

import json
import sqlite3
import zipfile

import pytest

from tessera import errors
from tessera.sources import files as FI
from tessera.sources import html as H
from tessera.sources import providers as P

PAGE = """<html><head><title>A &amp; B</title><meta property="article:published_time" content="2024-05-01"><meta name="author" content="Ann"><meta property="og:image" content="i.png"></head>
<body><nav>Menu here</nav><h1>Head</h1><p>%s</p><script>x()</script><footer>Foot</footer></body></html>""" % ("Interesting content stands between other things. " * 8)


def test_page():
    got = H.extract(PAGE)
    assert (got["title"], got["timestamp"], got["author"], got["image"]) == ("A & B", "2024-05-01", "Ann", "i.png")
    assert "Interesting" in got["content"] and "Menu" not in got["content"] and "Foot" not in got["content"] and "x()" not in got["content"]
    assert H.extract("<html><body></body></html>") is None and H.extract("<h1>Only</h1>")["title"] == "Only"


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"  hello \xff world \n")
    (tmp_path / "empty.txt").write_text(" ")
    (tmp_path / "b.csv").write_text("x,y\n1,\n ,b\n")
    (tmp_path / "c.json").write_text(json.dumps([{"k": [1, None], "t": True}, "s"]))
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "e.pdf").write_text("no pdf")
    (tmp_path / "f.xyz").write_text("other")
    rows = {r["source"].rsplit("/", 1)[-1]: r for r in FI.ingest(spark, str(tmp_path), now="2024-01-01").collect()}
    assert rows["a.txt"]["content"] == "hello  world" and "empty.txt" not in rows and rows["a.txt"]["title"] == "a.txt" and rows["a.txt"]["timestamp"] == "2024-01-01"
    assert rows["b.csv#row1"]["content"] == "x: 1 | y: nan" or rows["b.csv#row1"]["content"].startswith("x: 1")
    assert rows["c.json#item0"]["content"] == "k: 1 None | t: True" and rows["c.json#item1"]["content"] == "s"
    assert rows["d.docx"]["content"] == "One\n\nTwo"


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (a INT, b TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(1, "x"), (0, ""), (2, None)])
    rows = FI.ingest(spark, f"sqlite://{path}", table="t").collect()
    assert [(r["content"], r["source"].rsplit("#", 1)[-1]) for r in rows] == [("a: 1 | b: x", "row0"), ("a: 2", "row2")]
    assert FI.read_sqlite(spark, path, query="SELECT b FROM t WHERE a = 1").first()["content"] == "b: x"
    with pytest.raises(errors.TesseraError) as e:
        FI.read_sqlite(spark, path)
    assert e.value.code == "ingest"


def test_unsupported(spark):
    with pytest.raises(errors.TesseraError) as e:
        FI.ingest(spark, "/tmp/x.xyz")
    assert e.value.code == "format" and e.value.to_dict()["source"] == "/tmp/x.xyz"


def test_fetch(spark):
    urls = spark.createDataFrame([(0, "http://a.org/1"), (0, "http://a.org/2")], "query_id long, url string")
    rows = {r["url"]: r for r in P.fetch(urls, get=P.offline_get({"http://a.org/1": PAGE}), wait=lambda s: None).collect()}
    assert rows["http://a.org/1"]["title"] == "A & B" and not rows["http://a.org/1"]["failed"] and rows["http://a.org/2"]["failed"]


def test_json_provider(spark):
    answers = {"results": [{"url": "u1", "title": "t"}, {"url": ""}, {"url": "u2"}]}

    def get(url, timeout):
        if url.startswith("http://down"):
            raise OSError
        return json.dumps(answers).encode()

    asked = spark.createDataFrame([(0, "q")], "query_id long, query string")
    rows = P.JsonProvider(["http://down", "http://up"], get=get).search(asked, 3).orderBy("rank").collect()
    assert [r["url"] for r in rows] == ["u1", "u2"]


def test_html_provider(spark):
    page = b"""<a rel="x" class="result__a" href="//site/l/?uddg=https%3A%2F%2Fa.org%2F1&amp;r=2">A <b>one</b></a><a class="result__a" href="https://b.org/">B &amp; two</a><a class="result__a" href="javascript:x">C</a><a href="https://c.org">no</a>"""
    asked = spark.createDataFrame([(0, "q")], "query_id long, query string")
    rows = P.HtmlProvider(get=lambda url, timeout: page).search(asked, 5).orderBy("rank").collect()
    assert [(r["url"], r["title"]) for r in rows] == [("https://a.org/1", "A one"), ("https://b.org/", "B & two")]


def test_fetch_late_and_rendered(spark):
    urls = spark.createDataFrame([(0, "http://a.org/1"), (0, "http://a.org/2")], "query_id long, url string")
    late = P.fetch(urls, get=P.offline_get({"http://a.org/1": PAGE}), wait=lambda s: None, session_timeout=-1.0).collect()
    assert len(late) == 2 and all(r["failed"] for r in late)
    rows = {r["url"]: r for r in P.fetch(urls, get=P.offline_get({"http://a.org/1": PAGE}), wait=lambda s: None, render=lambda u, t: PAGE.encode()).collect()}
    assert rows["http://a.org/2"]["title"] == "A & B"
    with pytest.raises(errors.TesseraError) as e:
        P.browser_get("http://a.org", 1.0)
    assert e.value.code == "dependency"


def test_sqlite_in_ranges(spark, tmp_path):
    path = str(tmp_path / "y.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (a INT, b TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(i, f"x{i}") for i in range(1, 101)])
        db.execute("DELETE FROM t WHERE a BETWEEN 20 AND 60")
        db.execute("CREATE TABLE none (a INT)")
    rows = FI.read_sqlite(spark, path, "t", max_rows=50)
    left = [i for i in range(1, 101) if not 20 <= i <= 60][:50]
    assert sorted((int(r["source"].rsplit("#row", 1)[-1]), r["content"], r["title"]) for r in rows.collect()) == [(n, f"a: {i} | b: x{i}", "t") for n, i in enumerate(left)]
    assert rows.rdd.getNumPartitions() > 1 and FI.read_sqlite(spark, path, "none").count() == 0


def test_registry():
    from tessera import registry

    assert registry.names("provider") == ["html", "json", "table"] and registry.make("embedder", "hashed", size=8)(["a", ""]).shape == (2, 8)
    registry.register("embedder", "ones", lambda: lambda texts: [[1.0]] * len(texts))
    assert registry.make("embedder", "ones")(["x"]) == [[1.0]]
    with pytest.raises(errors.TesseraError):
        registry.make("scorer", "none")
