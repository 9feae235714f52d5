"""The pipeline stage by stage against the operators' own decisions, and the registered queries against SQL."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import corpus_pipeline  # noqa: E402
from compare import canonical, with_sql  # noqa: E402
from test_training_operators import brute_decontaminate, brute_join  # noqa: E402

from tessera.llm import catalog  # noqa: E402


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_exact(rows):
    """(doc_id, text) of the rows that stay: of equal texts the largest id."""
    best = {}
    for i, t in rows:
        key = (t or "").translate(LOWER)
        best[key] = max(best.get(key, i), i, key=lambda x: (x is not None, x))
    return {(i, k) for k, i in best.items()}


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    scores = {r["doc_id"]: r["kept"] for r in catalog.QUERIES["op1_quality_cotraining"](spark, data).collect()}
    one = corpus_pipeline.quality(spark, docs, data)
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == {i for i, k in scores.items() if k}
    rows = pairs(one)
    two = corpus_pipeline.exact(spark, one, data)
    rows = pairs(two)
    assert two.columns == docs.columns and {(i, t.translate(LOWER)) for i, t in rows} == brute_exact(pairs(one)) and len(rows) == len(brute_exact(pairs(one)))
    three = corpus_pipeline.near(spark, two, data)
    want = {int(i) for i, _, c in brute_join(rows) if i == c}
    assert three.columns == docs.columns and {r["doc_id"] for r in three.collect()} == want
    rows = [r for r in rows if r[0] in want]
    four = corpus_pipeline.clean(spark, three, data)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in four.collect()} == {int(r[0]) for r in brute_decontaminate(rows, items) if not r[-1]}
    five = corpus_pipeline.encode(spark, four, data)
    assert five.count() == four.count() and all(r["n_tokens"] == len(r["ids"]) for r in five.collect())


def test_repeated_rows(spark, data):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (2, "b", None, None, None), (None, "c", None, None, None), (3, "A", "en", "s", 1)], SCHEMA)
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.exact(spark, docs, data).collect()) == ["2", "3", "None"]
    twice = docs.filter("doc_id = 1")
    assert corpus_pipeline.exact(spark, twice, data).count() == 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), data).count() == 0


def test_rows_that_share_an_id(spark, data):
    """No stage drops a row for another row of its id."""
    rows = [(7, "text one unique"), (7, "text two unique"), (8, "copy"), (9, "copy"), (8, "something else entirely"), (8, "Copy"), (9, "COPY"), (None, None), (10, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    left = corpus_pipeline.exact(spark, docs, data)
    assert {(i, (t or "").translate(LOWER)) for i, t in pairs(left)} == brute_exact(rows) == {(7, "text one unique"), (7, "text two unique"), (9, "copy"), (8, "something else entirely"), (10, "")} and left.count() == 5
    base = " ".join(f"w{i}" for i in range(60))
    close = [(1, base), (2, base + " x"), (2, "quite another text of its own words"), (2, "quite another text of its own words"), (1, base + " y"), (3, "z"), (None, base), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in close], SCHEMA)
    got = pairs(corpus_pipeline.near(spark, docs, data))
    assert len(got) == 5 and {t for i, t in got if i == 2} == {"quite another text of its own words"} and sum(i == 1 for i, _ in got) == 1
    item = spark.read.parquet(f"{data}/benchmark.parquet").filter("length(text) > 100").first()["text"]
    docs = spark.createDataFrame([(5, item, "en", "s", 1), (5, "clean words", "en", "s", 1), (None, item, None, None, None), (None, "clean", None, None, None)], SCHEMA)
    assert pairs(corpus_pipeline.clean(spark, docs, data)) == [(5, "clean words"), (None, "clean")]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, data, name):
    assert canonical(catalog.QUERIES[name](spark, data).toPandas()) == canonical(with_sql(catalog.ORACLES[name], data))
