"""Vector search and adjacent similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S


def knn(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "id", vec_col: str = "embedding", query_col: str = "query_id", block_rows: int = 20_000) -> DataFrame:
    """query, id, similarity, rank: the k most similar rows for each of many query vectors.

    Every row is compared. Queries are dealt by hash into blocks of about ``block_rows``, as many as
    needed; each block is broadcast on its own, and each task keeps k rows a query before anything is
    shuffled. Ties go to the smaller id.
    """
    asked = queries.select(F.col(query_col).cast("long").alias("query_id"), F.col(vec_col).alias("v"))
    blocks = -(-asked.count() // block_rows)
    found = vectors.sparkSession.createDataFrame([], "query_id long, id long, similarity double, rank int")
    for block in range(blocks):
        own = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        best = _knn_block(vectors, own.collect(), k, id_col, vec_col)
        found = best if block == 0 else found.unionByName(best)
    return found


def _knn_block(vectors: DataFrame, asked: list, k: int, id_col: str, vec_col: str) -> DataFrame:
    import numpy as np
    import pandas as pd

    if not asked:
        return vectors.sparkSession.createDataFrame([], "query_id long, id long, similarity double, rank int")
    ids = np.array([r["query_id"] for r in asked])
    matrix = np.array([r["v"] for r in asked], np.float64)
    norms = np.sqrt((matrix**2).sum(axis=1))
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix, norms))
    step = max(1, 4_000_000 // len(ids))  # rows compared at once, so that a large block of queries fits

    def best(parts):
        own_ids, q, qn = shared.value
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]  # query, id, similarity
        for part in (p.iloc[i : i + step] for p in parts for i in range(0, len(p), step)):
            x = np.stack(part["v"].to_numpy()).astype(np.float64)
            sim = (q @ x.T) / (qn[:, None] * np.sqrt((x**2).sum(axis=1))[None, :] + 1e-8)
            least = np.partition(sim, -k, axis=1)[:, -k] if len(x) > k else np.full(len(q), -np.inf)
            who, at = np.nonzero(sim >= least[:, None])  # the best k of each query, and what ties with the last
            held = [np.concatenate(c) for c in zip(held, (who, part["id"].to_numpy(np.int64)[at], sim[who, at]), strict=True)]
            order = np.lexsort((held[1], -held[2], held[0]))
            held = [c[order] for c in held]
            first = np.searchsorted(held[0], held[0])
            held = [c[np.arange(len(first)) - first < k] for c in held]
        yield pd.DataFrame({"query_id": own_ids[held[0]], "id": held[1], "similarity": held[2]})

    found = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).filter("v is not null").mapInPandas(best, "query_id long, id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, target: Column, k: int, id_col: str, vec_col: str) -> DataFrame:
    """The k rows nearest to one vector, as a top-k over a native expression."""
    scored = vectors.select(F.col(id_col).alias("id"), S.cosine(F.col(vec_col), target).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "id").limit(k)


def boundaries(rows: DataFrame, group: str, order: str, vec_col: str, threshold: float = 0.75) -> DataFrame:
    """similarity of each row with the one before it in its group, and whether a boundary lies between them."""
    w = Window.partitionBy(group).orderBy(order)
    sim = S.cosine(F.col(vec_col), F.lag(vec_col).over(w))
    return rows.withColumn("similarity", sim).withColumn("boundary", F.coalesce(F.col("similarity") < threshold, F.lit(False)))


def mean_coherence(rows: DataFrame, group: str, order: str, vec_col: str) -> DataFrame:
    """Mean similarity of neighbours in each group; 1 for a group of one."""
    w = Window.partitionBy(group).orderBy(order)
    sim = S.cosine(F.col(vec_col), F.lag(vec_col).over(w))
    return rows.withColumn("sim", sim).groupBy(group).agg(F.round(F.coalesce(F.avg("sim"), F.lit(1.0)), 4).alias("coherence"), F.count(F.lit(1)).alias("n"))
