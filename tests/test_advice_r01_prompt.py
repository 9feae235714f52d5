"""The prompt of a query's ten best chunks, whole."""

from compare import canonical, with_sql

from tessera.operators import context as X
from tessera.plans import state_plans as P

WHOLE = f"""WITH {P.CONTEXT}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS place FROM z)
SELECT query_id, md5(string_agg('[Source: ' || domain || ' | Score: ' || printf('%.2f', score) || ' | Chunk: ' || pos || ']' || chr(10) || doc_id || ' ' || text, chr(10) || chr(10) ORDER BY place)) AS prompt
FROM p WHERE place <= 10 GROUP BY query_id"""


def test_prompt_has_all_ten_chunks_whole(spark, data):
    assert canonical(P.context_prompt(spark, data).toPandas()) == canonical(with_sql(WHOLE, data))


def test_printed_score(spark):
    scores = [0.125, 0.375, 0.145, 0.615, 0.8149, 0.675]
    rows = spark.createDataFrame([(i, 1, "d", s, 0, "x") for i, s in enumerate(scores)], "query_id long, place int, domain string, score double, chunk_index int, content string")
    assert {r["query_id"]: r["prompt"] for r in X.to_prompt(rows).collect()} == {i: f"[Source: d | Score: {s:.2f} | Chunk: 0]\nx" for i, s in enumerate(scores)}
