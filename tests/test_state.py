"""Reputation, lexicon, controller and telemetry."""

import itertools

import pytest

from tessera.operators import state as ST
from tessera.operators import telemetry as TM

GOOD = {"avg_chunk_quality": 0.8, "useful_hit_rate": 0.9, "irrelevance_rate": 0.1, "failure_rate": 0.0, "avg_latency": 0.2}


def test_reputation_twice():
    state, first = ST.reputation_step(None, GOOD | {"at": 0})
    score = ST.scrape_score(0.8, 0.9, 0.1, 0.0, 0.2)
    assert first == pytest.approx(0.4 + 0.2 * score) and state["total_scrapes"] == 1
    state, second = ST.reputation_step(state, GOOD | {"at": 0})
    assert second == pytest.approx(0.8 * round(first, 4) + 0.2 * score) and state["total_scrapes"] == 2


def test_reputation_decays_to_a_floor():
    state, _ = ST.reputation_step(None, GOOD | {"at": 0})
    late, _ = ST.reputation_step(state, GOOD | {"at": 5000 * ST.DAY})
    assert late["retrieval_confidence"] == pytest.approx(0.8 * 0.1 + 0.2 * ST.scrape_score(0.8, 0.9, 0.1, 0.0, 0.2), abs=1e-4)


def test_status_table():
    for n, average, streak in itertools.product((7, 8), (0.69, 0.70), (0, 4, 5, 9, 10, 12, 13)):
        candidate = "active" if n >= 8 and average >= 0.70 else "suppressed" if streak >= 10 else "candidate"
        active = "suppressed" if streak >= 13 else "candidate" if streak >= 5 else "active"
        assert ST.next_status("candidate", n, average, streak) == candidate
        assert ST.next_status("active", n, average, streak) == active
        assert ST.next_status("suppressed", n, average, streak) == "suppressed"


def observe(confidences, step=0.0, state=None, start=0.0, explore=0.0):
    for i, c in enumerate(confidences):
        state = ST.lexicon_step(state, {"term": "t", "topic": "x", "confidence": c, "at": start + i * step}, explore)
    return state


def test_lexicon_graduates_and_falls():
    assert observe([0.9] * 7)["status"] == "candidate"
    assert observe([0.9] * 8)["status"] == "active"
    assert observe([0.1] * 10)["status"] == "suppressed"
    assert observe([0.1] * 9 + [0.6] + [0.1])["status"] == "suppressed"  # the middle band leaves the streak
    assert observe([0.1] * 9 + [0.9] + [0.1])["consecutive_low"] == 1


def test_lexicon_recovers():
    low = observe([0.1] * 10)
    assert observe([0.9], state=low, start=ST.DAY * 29)["status"] == "suppressed"
    back = observe([0.9], state=low, start=ST.DAY * 30)
    assert back["status"] == "candidate" and back["consecutive_low"] == 0
    assert observe([0.1], state=low, explore=1.1)["status"] == "candidate"


def test_batch_fold_equals_steps(spark):
    rows = [("a", "x", c, float(i)) for i, c in enumerate([0.9] * 9 + [0.2] * 6)] + [("b", "x", 0.3, 1.0)]
    got = {r["term"]: r.asDict() for r in ST.observe_terms(spark.createDataFrame(rows, "term string, topic string, confidence double, at double"), explore=0.0).collect()}
    own = None
    for term, topic, c, at in rows[:-1]:
        own = ST.lexicon_step(own, {"term": term, "topic": topic, "confidence": c, "at": at}, 0.0)
    assert {k: got["a"][k] for k in own} == own and got["b"]["observations"] == 1
    more = spark.createDataFrame([("a", "x", 0.9, 100.0)], "term string, topic string, confidence double, at double")
    again = ST.observe_terms(more, spark.createDataFrame([got["a"]], ST.LEXICON_SCHEMA), explore=0.0).first()
    assert again["observations"] == 16


def test_empty_fold(spark):
    none = spark.createDataFrame([], "term string, topic string, confidence double, at double")
    assert ST.observe_terms(none).count() == 0


def test_controller():
    c = TM.Controller()
    for i in range(5):
        now, _ = c.record("d", 0.5, False, i)
    assert now == 15
    for i in range(5):
        now, domain = c.record("d", 6.0, True, 10 + i)
    assert 2 <= now < 15 and domain == 1


def test_throttle():
    passed = TM.throttle([0.0] * 12)
    assert passed[:10] == [0.0] * 10 and passed[10] == pytest.approx(0.1) and passed[11] == pytest.approx(0.2)


def test_collector(spark):
    rows = [("realpython.com", 1.0, False, False), ("realpython.com", 1.1, False, False), ("bad-site.com", 3.0, True, False), ("bad-site.com", 4.0, True, True)]
    stats = TM.by_domain(spark.createDataFrame(rows, "domain string, latency double, failed boolean, rate_limited boolean"))
    chunks = spark.createDataFrame([("realpython.com", 0, 8, 6, 4.8), ("bad-site.com", 0, 4, 0, 0.0)], "domain string, seq int, chunks_total int, chunks_kept int, coherence_sum double")
    got = {r["domain"]: r.asDict() for r in TM.with_chunks(stats, chunks).collect()}
    good, bad = got["realpython.com"], got["bad-site.com"]
    assert (good["avg_latency"], good["failure_rate"], good["useful_hit_rate"], good["irrelevance_rate"], good["avg_chunk_quality"]) == (1.05, 0.0, 0.75, 0.25, 0.8)
    assert (bad["avg_latency"], bad["failure_rate"], bad["rate_limited"], bad["useful_hit_rate"], bad["irrelevance_rate"]) == (0.0, 1.0, 1, 0.0, 1.0)


def test_expand(spark):
    lexicon = [("asyncio", "tech", 20, 18.0, 0.9, "active", 0, 0.0), ("docker", "tech", 20, 18.0, 0.8, "active", 0, 0.0), ("paper", "science", 20, 18.0, 0.9, "active", 0, 0.0), ("low", "tech", 20, 1.0, 0.2, "candidate", 0, 0.0)]
    queries = spark.createDataFrame([(1, "use asyncio well", "tech", False), (2, "containers", "tech", True)], "query_id long, query string, topic string, ambiguous boolean")
    got = {r["query_id"]: r["text"] for r in ST.expand_queries(queries, spark.createDataFrame(lexicon, ST.LEXICON_SCHEMA), 0.0).collect()}
    assert got == {1: "use asyncio well docker", 2: "containers asyncio docker paper"}
