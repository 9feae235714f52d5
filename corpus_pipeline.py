"""A training-corpus pipeline out of the operators of ``tessera.llm``.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs, with the same
columns; the last returns the encoded documents. Stages decide on rows, not on ids: rows that
repeat an id with another text are judged by their own text. Between stages the rows are written as
Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import bpe_digests
from tessera.llm.common import broadcast_if, few_rows_a_batch, give_back, materialize, row_key, table
from tessera.llm.decontaminate import decontaminate
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.jaccard_join import near_rows
from tessera.llm.quality import keep_good

#: Rows that a stage drops are broadcast up to so many (32 MB); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _make_room(spark: SparkSession) -> None:
    """Before each stage: executors and workers that live through all of them start it with little."""
    few_rows_a_batch(spark)
    give_back(spark)


def _same() -> Column:
    return F.col("_docs.doc_id").eqNullSafe(F.col("_keys.doc_id")) & (row_key("_docs.doc_id", "_docs.text") == F.col("_keys.row"))


def _joined(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    return docs.alias("_docs").join(broadcast_if(keys.select("doc_id", "row").distinct(), BROADCAST_ROWS).alias("_keys"), _same(), how)


def _without(docs: DataFrame, dropped: DataFrame, kept: DataFrame, name: str) -> DataFrame:
    """docs without the rows of dropped (doc_id, row), and of rows that are the same in kept (doc_id, row) one."""
    left = _joined(docs, materialize(dropped.select("doc_id", "row").distinct(), name), "left_anti")
    twice = materialize(kept.groupBy("doc_id", "row").count().filter("count > 1"), f"{name}-twice")
    if twice.isEmpty():
        return left
    once = _joined(left, twice, "left_semi").dropDuplicates(["doc_id", "text"])
    return _joined(left, twice, "left_anti").unionByName(once)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    _make_room(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: that of the largest id, and of several rows of that id the one with the smallest hash."""
    _make_room(spark)
    decided = materialize(exact_dedup(docs), "exact")
    kept = decided.filter("kept")
    best = kept.groupBy("doc_id", "text_sha256").agg(F.min("row").alias("best"), F.max("row").alias("other")).filter("best <> other")
    same = [F.col("k.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("k.text_sha256") == F.col("b.text_sha256")]
    others = kept.alias("k").join(best.alias("b"), same).filter("k.row <> b.best").select("k.doc_id", "k.row")
    return _without(docs, decided.filter("not kept").select("doc_id", "row").unionByName(others), kept, "copies")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row of the smallest id stays. Rows without id or words stay."""
    _make_room(spark)
    rows = materialize(near_rows(docs), "near-rows")
    linked = rows.filter("best is not null")
    return _without(docs, linked.filter("doc_id <> best.doc_id or row <> best.row"), linked, "near")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    _make_room(spark)
    found = materialize(decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id", "row").distinct(), "contaminated")
    return _joined(docs, found, "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of every document left."""
    _make_room(spark)
    return bpe_digests(docs, with_ids=True)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", clean), ("encode", encode)]

#: SQL can express neither the classifier nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
