"""More queries than one block of them holds."""

import numpy as np

from tessera.operators import vectors as V


def test_knn_answers_every_block(spark):
    x = np.random.default_rng(2).normal(size=(60, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    got = V.knn(rows, rows.withColumnRenamed("id", "query_id"), 3, block_rows=7).collect()
    unit = x / np.sqrt((x**2).sum(axis=1))[:, None]
    sim = unit @ unit.T
    assert {(r["query_id"], r["rank"], r["id"]) for r in got} == {(q, n + 1, int(i)) for q in range(60) for n, i in enumerate(np.argsort(-sim[q])[:3])}
    assert len(got) == 180
