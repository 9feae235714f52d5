"""Classification, variants, chunking, context, ranking and conflicts."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import chunk as C
from tessera.operators import classify as Q
from tessera.operators import context as X
from tessera.operators import documents as D
from tessera.operators import rank as R
from tessera.operators import vectors as V


def test_topics(spark):
    asked = spark.createDataFrame([(1, "python asyncio tutorial"), (2, "GST filing deadline"), (3, "zzz")], "query_id long, query string")
    got = {r["query_id"]: r for r in Q.predict(asked).collect()}
    assert (got[1]["topic"], got[1]["confidence"], got[1]["secondary"], got[1]["secondary_confidence"], got[1]["ambiguous"]) == ("tech", 0.6667, "education", 0.3333, False)
    assert got[2]["topic"] == "finance" and got[3]["topic"] == "general" and got[3]["confidence"] == 1.0


def test_variants(spark):
    asked = spark.createDataFrame([(1, "GST filing deadline", "finance"), (2, "   ", "tech"), (3, "best python tutorial 2026", "tech")], "query_id long, query string, topic string")
    rows = Q.variants(asked).orderBy("query_id", "rank").collect()
    assert [(r["text"], r["weight"]) for r in rows if r["query_id"] == 1] == [("GST filing deadline", 1.0), ("GST filing deadline 2026", 0.85), ("GST filing deadline site:rbi.org.in", 0.70)]
    assert [r["text"] for r in rows if r["query_id"] == 3] == ["best python tutorial 2026", "best python guide 2026", "best python tutorial 2026 site:docs.python.org"]
    assert not [r for r in rows if r["query_id"] == 2]
    history = spark.createDataFrame([(1, "gst filing deadline")], "query_id long, asked string")
    assert Q.variants(asked, history=history).filter("query_id = 1").count() == 2


TEXT = " ".join(f"Sentence number {i} talks about topic {i % 3} in some detail." for i in range(60))


def test_chunks_keep_to_the_budget():
    chunks = C.Chunker(threshold=-1.0, dedupe=1.1)(TEXT, "T")
    assert len(chunks) > 1 and [c["chunk_index"] for c in chunks] == list(range(len(chunks)))
    assert all(c["token_estimate"] <= 256 + 20 for c in chunks) and chunks[1]["title"] == "T [chunk 1]"
    last = chunks[0]["content"].split(". ")[-1]
    assert chunks[1]["content"].startswith(last)  # one sentence of overlap


def test_no_chunks():
    assert C.Chunker()("") == [] and C.Chunker()("Too short.") == []


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("ab c", min_size=0, max_size=12), max_size=12))
def test_keep_unlike_is_idempotent(items):
    kept = C.keep_unlike(items, 3, 0.85, 20)
    again = C.keep_unlike([items[i] for i in kept], 3, 0.85, 20)
    assert len(again) == len(kept) and kept == sorted(set(kept))


def test_chunk_rows(spark):
    docs = spark.createDataFrame([(1, TEXT, "t"), (2, None, None)], "doc_id long, content string, title string")
    rows = C.chunk_documents(docs).collect()
    assert rows and {r["doc_id"] for r in rows} == {1}


def test_chunk_quality(spark):
    good = "This explains how decorators wrap functions within other functions, keeping behaviour separate. " * 3
    rows = spark.createDataFrame([("s", "a.org", good, 0.7), ("s", "b.org", "Enable JavaScript", 0.1)], "session string, domain string, content string, coherence_score double")
    got = {r["domain"]: r for r in D.evaluate_chunks(rows).collect()}
    assert got["a.org"]["passed"] and not got["b.org"]["passed"] and got["b.org"]["noisy"]
    verdict = D.session_quality(D.domain_quality(D.evaluate_chunks(rows), "session", "domain"), "session").first()
    assert (verdict["domains"], verdict["passed"], verdict["accepted"]) == (2, 1, False)
    assert D.gate(rows, D.session_quality(D.domain_quality(D.evaluate_chunks(rows), "session", "domain"), "session")).count() == 0


def chunk_rows(spark, n=8):
    words = [f"Part {i} of the text has " + " ".join(f"word{i}x{j}" for j in range(80)) + "." for i in range(n)]
    return spark.createDataFrame([(0, i, w, f"https://site{i % 3}.org/{i}", "t", i, 0.7 + 0.02 * i) for i, w in enumerate(words)], "query_id long, pos int, content string, source string, title string, chunk_index int, coherence_score double")


def test_context_scores(spark):
    rows = X.score_chunks(chunk_rows(spark)).orderBy("pos").collect()
    assert [r["score"] for r in rows] == pytest.approx([round(0.81 - 0.0565 * i, 4) for i in range(8)])


def test_context_budget(spark):
    rows = X.build_context(chunk_rows(spark), 500).collect()
    assert rows and sum(r["tokens"] for r in rows) <= 500
    used = spark.createDataFrame([(0, r["fingerprint"]) for r in rows], "query_id long, fingerprint string")
    again = {r["fingerprint"] for r in X.build_context(chunk_rows(spark), 500, None, used).collect()}
    assert not again & {r["fingerprint"] for r in rows}
    assert X.summarize(X.build_context(chunk_rows(spark), 500)).first()["chunks"] == len(rows)
    assert X.to_prompt(X.build_context(chunk_rows(spark), 500)).first()["prompt"].startswith("[Source: site0.org | Score: 0.81 | Chunk: 0]")


def test_greedy_skips_and_goes_on(spark):
    rows = spark.createDataFrame([(0, 0, 0.9, 60), (0, 1, 0.8, 50), (0, 2, 0.7, 40)], "query_id long, pos int, score double, tokens int")
    assert sorted(r["pos"] for r in X.greedy_cap(rows, 100).collect()) == [0, 2]


def test_selection(spark):
    urls = [(0, "tech", i, f"https://site{i // 4}.org/{i}") for i in range(20)] + [(0, "tech", 20, "https://www.youtube.com/x"), (0, "tech", 21, "https://docs.python.org/3")]
    rows = R.select_urls(spark.createDataFrame(urls, "query_id long, topic string, pos int, url string")).orderBy("rank").collect()
    assert rows[0]["domain"] == "docs.python.org" and rows[0]["score"] == 0.55 and len(rows) <= 12
    per = [r["domain"] for r in rows]
    assert max(map(per.count, per)) <= 2 and "youtube.com" not in per


def test_block_list(spark):
    got = {r["d"]: (r["a"], r["b"]) for r in spark.createDataFrame([("microsoft.com",), ("ft.com",), ("www2.ft.com",)], "d string").select("d", R.blocked(F.col("d"), "substring").alias("a"), R.blocked(F.col("d")).alias("b")).collect()}
    assert got == {"microsoft.com": (True, False), "ft.com": (True, True), "www2.ft.com": (True, True)}


def test_conflicts(spark):
    docs = spark.createDataFrame([("s", 0, "a", "2024-01-05", "x"), ("s", 1, "b", "2024-02-01", "y"), ("s", 2, "c", "", "z"), ("t", 0, "d", "2020-01-01", "w")], "session string, pos int, source string, timestamp string, content string")
    rows = D.conflicts(docs).collect()
    assert len(rows) == 1 and rows[0]["newest_source"] == "b" and rows[0]["source_a"]["content_preview"] == "x"


def test_knn_finds_itself(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 8)))], "id long, embedding array<double>")
    got = V.knn(rows, rows.withColumnRenamed("id", "query_id"), 3).filter("rank = 1").collect()
    assert len(got) == 40 and all(r["id"] == r["query_id"] for r in got)


def test_merge(spark):
    hits = [(0, 0, 1, "a"), (0, 0, 2, "b"), (0, 1, 1, "b"), (0, 1, 2, "c"), (0, 1, 3, ""), (0, 1, 4, "d"), (1, 0, 1, "x"), (1, 0, 2, "y"), (1, 0, 3, "z"), (1, 1, 1, "w")]
    rows = R.merge_providers(spark.createDataFrame(hits, "query_id long, priority int, rank int, url string"), 3).orderBy("query_id", "place").collect()
    assert [r["url"] for r in rows if r["query_id"] == 0] == ["a", "b", "c"] and [r["url"] for r in rows if r["query_id"] == 1] == ["x", "y", "z"]


def test_dedup_keeps_the_first(spark):
    docs = spark.createDataFrame([(2, "same"), (1, "same"), (3, "other"), (4, None)], "pos int, content string")
    assert sorted(r["pos"] for r in D.dedup_documents(docs, "pos").collect()) == [1, 3, 4]


@pytest.mark.parametrize(("k", "threshold"), [(3, 0.85), (4, 0.80)])
def test_near_duplicate_pairs(spark, k, threshold):
    import random

    rng = random.Random(k)
    base = ["".join(rng.choice("abcde fgh") for _ in range(rng.randrange(5, 120))) for _ in range(12)]

    def changed(t):
        at = rng.randrange(len(t))
        return t[:at] + rng.choice(["", "x", "zz"]) + t[at + rng.randrange(3) :]

    left = [(i, t) for i, t in enumerate(base + [changed(t) for t in base for _ in range(3)] + [None, "", "ab", base[0].upper(), "é" * 50, "aa" * 4000])]
    right = [(100 + i, t) for i, t in enumerate([changed(t) for t in base] + ["", None, "é" * 40])]

    def grams(t):
        t = (t or "").lower().strip()
        return {t[i : i + k] for i in range(len(t) - k + 1)}

    want = {(i, j) for i, t in left for j, u in right for a, b in [(grams(t), grams(u))] if a and b and len(a & b) / len(a | b) >= threshold}
    frames = [spark.createDataFrame(rows, f"{name} long, text string") for rows, name in ((left, "a"), (right, "b"))]
    got = D.near_duplicate_pairs(*frames, k, threshold, "a", "b").collect()
    assert {(r["left_id"], r["right_id"]) for r in got} == want and len(got) == len(want) > 10


def test_hits_without_a_library(spark):
    known = [(1, "ab"), (2, "b"), (3, ""), (4, "ab"), (5, "zz")]
    assert sorted(Q._finder(known)("xaby")) == [1, 2, 3, 4]
    base = spark.createDataFrame([(7, "xaby"), (8, None)], "query_id long, q string")
    words = spark.createDataFrame(known, "n long, word string")
    for most in (100, 2):  # in one pass, and by a join
        assert sorted(tuple(r) for r in Q.substring_hits(base, words, most).collect()) == [(7, 1), (7, 2), (7, 3), (7, 4)]
