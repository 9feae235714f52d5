"""Token-budgeted context for a prompt."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .chunk import like, shingles

BUDGET, MOST_CHUNKS, LEAST, MOST, PER_DOMAIN, MIN_SCORE, REUSE, PENALTY = 3000, 10, 80, 400, 3, 0.25, 0.75, 0.15


def score_chunks(chunks: DataFrame, reputation: DataFrame | None = None, used: DataFrame | None = None, query: str = "query_id", pos: str = "pos") -> DataFrame:
    """Adds domain and score (half rank, then coherence and reputation); used chunks lose 0.15 and go below 0.75.

    chunks: query, pos, content, source, coherence_score. reputation: domain, confidence. used: query, fingerprint.
    """
    by = Window.partitionBy(query)
    rows = chunks.withColumn("domain", S.domain(F.col("source")))
    rank = 1.0 - (F.row_number().over(by.orderBy(pos)) - 1) / F.count(F.lit(1)).over(by)
    rows = rows.withColumn("rank_score", rank)
    rows = rows.join(reputation.select("domain", F.col("confidence").alias("rep")), "domain", "left") if reputation is not None else rows.withColumn("rep", F.lit(0.5))
    score = 0.50 * F.col("rank_score") + 0.30 * F.col("coherence_score") + 0.20 * F.coalesce("rep", F.lit(0.5))
    rows = rows.withColumn("fingerprint", S.fingerprint(F.col("content")))
    if used is not None:
        rows = rows.join(used.select(query, "fingerprint").distinct().withColumn("seen", F.lit(True)), [query, "fingerprint"], "left").withColumn("previously_used", F.coalesce("seen", F.lit(False))).drop("seen")
    else:
        rows = rows.withColumn("previously_used", F.lit(False))
    rows = rows.withColumn("score", F.when(F.col("previously_used"), score - PENALTY).otherwise(score)).filter(~F.col("previously_used") | (F.col("score") >= REUSE))
    return rows.withColumn("score", F.round("score", 4)).drop("rep", "rank_score")


def diversity_cap(rows: DataFrame, query: str = "query_id", most: int = PER_DOMAIN, pos: str = "pos") -> DataFrame:
    w = Window.partitionBy(query, "domain").orderBy(F.desc("score"), pos)
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most).drop("_k")


def allocate(rows: DataFrame, budget: Column | int = BUDGET, query: str = "query_id") -> DataFrame:
    """Adds allocated_tokens: the share of the budget by score, between 80 and 400."""
    total = F.sum("score").over(Window.partitionBy(query))
    share = F.floor(F.col("score") / F.when(total == 0, 1.0).otherwise(total) * budget)
    return rows.withColumn("allocated_tokens", F.greatest(F.lit(LEAST), F.least(F.lit(MOST), share)).cast("int"))


def _same(a, b) -> bool:
    """Whether two keys of rows are equal; missing ones are."""
    return a == b or (a != a and b != b)


def _in_order(rows: DataFrame, query: str, pos: str) -> DataFrame:
    """Each query's rows in one partition, best first, to be read as a stream. The sort spills, so a query of any length fits."""
    return rows.repartition(F.col(query)).sortWithinPartitions(query, F.desc_nulls_last("score"), pos)


def greedy_cap(rows: DataFrame, budget: int = BUDGET, query: str = "query_id", tokens: str = "tokens", pos: str = "pos") -> DataFrame:
    """Rows taken by score as long as they fit; one that doesn't is skipped and smaller ones may follow. A task holds one sum, not the query's rows."""
    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, spent = object(), 0
        for part in parts:
            taken = []
            for q, t in zip(part.column(query).to_pylist(), part.column("_t").to_pylist(), strict=True):
                if not _same(q, current):
                    current, spent = q, 0
                taken.append(spent + t <= budget)
                spent += t if taken[-1] else 0
            yield part.filter(pa.array(taken, pa.bool_())).select(names)

    names = rows.columns
    asked = rows.withColumn("_t", F.col(tokens).cast("long")).filter(F.col("_t") <= budget)
    return _in_order(asked, query, pos).mapInArrow(fold, rows.schema)


def unlike(rows: DataFrame, query: str = "query_id", k: int = 4, threshold: float = 0.80, last: int = 10, pos: str = "pos") -> DataFrame:
    """Without chunks that are near duplicates of one of the last ten kept, by score. A task holds those ten and a batch of rows."""
    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kept = object(), deque(maxlen=last)
        for part in parts:
            taken = []
            for q, text in zip(part.column(query).to_pylist(), part.column("content").to_pylist(), strict=True):
                if not _same(q, current):
                    current = q
                    kept.clear()
                own = shingles(text or "", k)
                taken.append(not any(like(own, other, threshold) for other in kept))
                if taken[-1]:
                    kept.append(own)
            yield part.filter(pa.array(taken, pa.bool_()))

    return _in_order(rows, query, pos).mapInArrow(fold, rows.schema)


def build_context(chunks: DataFrame, budget: int = BUDGET, reputation: DataFrame | None = None, used: DataFrame | None = None, query: str = "query_id") -> DataFrame:
    """The chunks of each query's context in order of score, with content trimmed to its share.

    chunks: query_id, pos (rank), content, source, title, chunk_index, coherence_score; any number of
    queries at once. Returns also tokens, allocated_tokens, fingerprint (add them to used for
    the next turn of the session), place.
    """
    budget = min(budget or BUDGET, BUDGET)
    rows = unlike(score_chunks(chunks, reputation, used, query).filter(F.col("score") >= MIN_SCORE), query)  # lower ones come last, so none is like them
    rows = diversity_cap(rows, query)
    order = Window.partitionBy(query).orderBy(F.desc("score"), "pos")
    rows = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= MOST_CHUNKS)
    rows = allocate(rows, budget, query)
    rows = rows.withColumn("content", S.strip_boilerplate(F.col("content")))  # each step in a projection of its own: the next names it many times
    rows = rows.withColumn("content", S.trim_to_tokens(F.col("content"), F.col("allocated_tokens"))).withColumn("tokens", S.estimate_tokens(F.col("content")))
    return greedy_cap(rows.filter(F.col("tokens") >= LEAST), budget, query)


def summarize(context: DataFrame, budget: int = BUDGET, query: str = "query_id") -> DataFrame:
    """One row per query: chunks, tokens, utilization, sources (in order of first use)."""
    listed = F.array_sort(F.collect_list(F.struct("place", "domain")))
    return context.groupBy(query).agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("tokens").alias("total_tokens"), F.round(F.sum("tokens") / budget, 3).alias("utilization"),
        F.array_distinct(F.transform(listed, lambda x: x["domain"])).alias("sources"),
    )


def to_prompt(context: DataFrame, query: str = "query_id") -> DataFrame:
    """query, prompt: chunks under headers, a blank line between them.

    Scores print as Python's and C's %.2f do: the exact value of the double to the nearest hundredth, ties to even.
    """
    printed = F.pandas_udf(lambda s: s.map("{:.2f}".format), "string")
    head = F.format_string("[Source: %s | Score: %s | Chunk: %d]\n%s", "domain", printed(F.col("score")), F.col("chunk_index"), "content")
    return context.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", head.alias("t")))), lambda x: x["t"]), "\n\n").alias("prompt"))


def llm_context(chunks: DataFrame, query: str = "query_id", text: Column | None = None) -> DataFrame:
    """Per query a prompt block of numbered chunks with confidence (score, else coherence, else 0)."""
    confidence = F.round(F.coalesce("score", "coherence_score", F.lit(0.0)), 3)
    line = F.concat(F.lit("["), F.col("n"), F.lit("] "), S.or_default(F.col("source"), "unknown"), F.lit(" — confidence "), confidence.cast("string"), F.lit("\n"), S.strip(F.col("content")), F.lit("\n"))
    rows = chunks.withColumn("n", F.row_number().over(Window.partitionBy(query).orderBy("pos")))
    listed = rows.groupBy(query, "question").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("t")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["t"]), "\n")
    return listed.select(query, F.concat(F.lit("[RETRIEVAL CONTEXT]\nquestion: "), "question", F.lit("\nchunks: "), F.size("l"), F.lit("\n\n"), body, F.lit("\n[END CONTEXT]")).alias("prompt"))
