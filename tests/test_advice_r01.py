"""Findings of the first review: whole inputs, against brute force."""

from decimal import ROUND_HALF_UP, Decimal

import pytest

from tessera.operators import chunk as C
from tessera.plans import text_plans as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def story(i, n=330):
    return " ".join(f"word{i}x{j}" for j in range(n)) + "."


@pytest.fixture(scope="module")
def long_source(spark, tmp_path_factory):
    """A source of 120 documents, of which the first 60 are alike and a language has only late ones; and one of 3."""
    rows = [(i, story(0) if i <= 60 else story(i), "it" if i > 100 else ("en", "de", "fr", "es")[i % 4], "hot", 200 + 37 * (i % 50)) for i in range(1, 121)]
    rows += [(200 + i, story(200 + i), "en", "small", 11_000 * i) for i in range(3)]
    folder = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def ranked(rows):
    """source -> (score, pos, document), best first."""
    found = {}
    for source in sorted({r[3] for r in rows}):
        own = sorted(r for r in rows if r[3] == source)
        scored = [(float(Decimal(repr(0.5 * (1 - p / len(own)) + 0.3 * ((10 - r[0] % 10) / 10) + 0.1)).quantize(Decimal("0.0001"), ROUND_HALF_UP)), p + 1, r) for p, r in enumerate(own)]
        found[source] = sorted(scored, key=lambda x: (-x[0], x[1]))
    return found


def capped(scored):
    n, kept = {}, []
    for x in scored:
        n[x[2][2]] = n.get(x[2][2], 0) + 1
        if n[x[2][2]] <= 3:
            kept.append(x)
    return kept


def test_diversity_cap_sees_every_document(spark, long_source):
    folder, rows = long_source
    expected = {(s, x[2][0], x[0]) for s, scored in ranked(rows).items() for x in capped(scored)}
    assert {(r["query_id"], r["doc_id"], r["score"]) for r in T.diversity_cap(spark, folder).collect()} == expected
    assert any(d > 100 and s == "hot" for s, d, _ in expected)


def test_token_allocation_sums_every_document(spark, long_source):
    folder, rows = long_source
    expected = {(s, x[2][0]): max(80, min(400, int(x[0] / sum(y[0] for y in scored) * 3000))) for s, scored in ranked(rows).items() for x in scored}
    assert {(r["query_id"], r["doc_id"]): r["allocated_tokens"] for r in T.token_allocation(spark, folder).collect()} == expected


def test_greedy_cap_takes_from_every_document(spark, long_source):
    folder, rows = long_source
    expected = set()
    for s, scored in ranked(rows).items():
        spent = 0
        for _, _, r in scored:
            if spent + max(1, r[4] // 4) <= 3000:
                spent += max(1, r[4] // 4)
                expected.add((s, r[0]))
    assert {(r["query_id"], r["doc_id"]) for r in T.greedy_cap(spark, folder).collect()} == expected


def test_built_context_takes_from_every_document(spark, long_source):
    folder, rows = long_source
    expected = set()
    for s, scored in ranked(rows).items():
        kept = [scored[i] for i in C.keep_unlike([x[2][1] for x in scored], 4, 0.80, 10)]
        expected |= {(s, x[1], place) for place, x in enumerate(capped(kept)[:10], 1)}
    got = T.built_context(spark, folder).collect()
    assert {(r["query_id"], r["pos"], r["place"]) for r in got} == expected
    assert any(p > 40 for _, p, _ in expected)
