"""Renderings of results as columns: JSON lines, document ids, prompts and structured context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

ENVELOPE = ("session", "query", "topic")


def json_row(*columns: str) -> Column:
    """The columns as a JSON object, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def chunk_lines(chunks: DataFrame, *own: str) -> DataFrame:
    """chunks with line: the envelope's fields, then the chunk's own, as JSON. An own field of the same name wins."""
    return chunks.withColumn("line", json_row(*[c for c in ENVELOPE if c not in own], *own))


def document_id(session: Column, query: Column) -> Column:
    return F.concat(session, F.lit(":"), F.substring(query, 1, 40))


def result_prompt(chunks: DataFrame, query: str = "query_id", most: int = 5, max_chars: int = 600) -> DataFrame:
    """query, prompt: the first chunks by pos, numbered, each with its title, source and the start of its content."""
    rows = chunks.withColumn("n", F.row_number().over(Window.partitionBy(query).orderBy("pos"))).filter(F.col("n") <= most)
    part = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), S.or_default(F.col("title"), ""), F.lit("\nSource: "), S.or_default(F.col("source"), ""), F.lit("\n"), F.substring(F.coalesce("content", F.lit("")), 1, max_chars))
    return rows.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("prompt"))


def confidence() -> Column:
    """Of score, else coherence, else 0, to three places."""
    return F.round(F.coalesce("score", "coherence_score", F.lit(0.0)), 3)


def listed_chunks(chunks: DataFrame, query: str = "query_id") -> DataFrame:
    """query, index, source, confidence, text of every chunk, numbered from 1."""
    n = F.row_number().over(Window.partitionBy(query).orderBy("pos"))
    return chunks.select(query, n.alias("index"), S.or_default(F.col("source"), "unknown").alias("source"), confidence().alias("confidence"), F.col("content").alias("text"))
