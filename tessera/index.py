"""The chunk store: one Parquet table, partitioned by session, with a vector per chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .errors import SessionNotFound
from .functions import scalar as S
from .operators.chunk import Embedder, embed_column, hashed_embedder
from .operators.vectors import knn


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None):
        self.spark, self.path, self.embedder = spark, f"{path.rstrip('/')}/chunks", embedder or hashed_embedder()

    def exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def table(self, session: str | None = None) -> DataFrame:
        """All chunks, or a session's: a partition, so nothing else is read."""
        if not self.exists():
            raise SessionNotFound(session or "")
        rows = self.spark.read.parquet(self.path)
        if session is None:
            return rows
        own = rows.filter(F.col("session") == session)
        if own.isEmpty():
            raise SessionNotFound(session)
        return own

    def add(self, chunks: DataFrame, session: str, batch: str, force_new: bool = False, min_coherence: float = 0.3) -> dict:
        """Embeds and appends chunks (content, title, source, timestamp, author, chunk_index, coherence_score); counts them.

        batch names the write (a time stamp): a chunk's id is made of it, the URL and the chunk's place.
        """
        total, kept = Observation(), Observation()
        rows = indexable(chunks.observe(total, F.count(F.lit(1)).alias("n")), F.lit(session), batch, min_coherence).observe(kept, F.count(F.lit(1)).alias("n")).withColumn("embedding", embed_column(F.col("content"), self.embedder))
        rows.write.mode("overwrite" if force_new else "append").option("partitionOverwriteMode", "dynamic").partitionBy("session").parquet(self.path)
        n, indexed = total.get["n"], kept.get["n"]  # counted by the write itself
        if force_new and not indexed:
            self._drop(session)  # nothing was written, so nothing was replaced
        return {"total": n, "indexed": indexed, "dropped": n - indexed}

    def search(self, session: str, queries: DataFrame, k: int = 5) -> DataFrame:
        """query_id, rank, distance and the chunk of the k nearest distinct chunks, for queries (query_id, query) all at once."""
        rows = self.table(session)
        asked = queries.select("query_id", embed_column(F.col("query"), self.embedder).alias("embedding"))
        keyed = rows.select("id", "embedding", "content", "title", "url", "timestamp", "chunk_index", "coherence_score").dropDuplicates(["id"])
        keyed = keyed.withColumn("n", F.conv(F.col("id"), 16, 10).cast("long"))
        near = knn(keyed.select("n", "embedding"), asked, k, "n").withColumnRenamed("id", "n")
        return near.join(keyed.drop("embedding"), "n").select("query_id", "rank", (1 - F.col("similarity")).alias("distance"), "id", "content", "title", "url", F.col("url").alias("source"), "timestamp", "chunk_index", F.col("coherence_score").cast("double").alias("coherence_score"))

    def sessions(self) -> list[str]:
        if not self.exists():
            return []
        return sorted(r["session"] for r in self.spark.read.parquet(self.path).select("session").distinct().collect())

    def delete(self, session: str) -> None:
        self.table(session)
        self._drop(session)

    def _drop(self, session: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/session={session}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def indexable(chunks: DataFrame, session: Column, batch: str, min_coherence: float = 0.3) -> DataFrame:
    """Chunks as the store keeps them, but for the vector: the coherent ones, defaults filled in, with an id of URL, batch and place."""
    place = F.row_number().over(Window.partitionBy("url").orderBy("chunk_index")) - 1
    rows = chunks.filter(F.coalesce("coherence_score", F.lit(1.0)) >= min_coherence).select(
        session.alias("session"), S.or_default(F.col("title"), "").alias("title"), S.or_default(F.col("content"), "").alias("content"), S.or_default(F.col("source"), "").alias("url"), S.or_default(F.col("timestamp"), "").alias("timestamp"),
        S.or_default(F.col("author"), "").alias("author"), F.coalesce("chunk_index", F.lit(0)).cast("int").alias("chunk_index"), F.coalesce("coherence_score", F.lit(1.0)).cast("float").alias("coherence_score"),
    )
    return rows.withColumn("id", F.substring(F.md5(F.concat_ws("_", "url", F.lit(batch), place)), 1, 12))


def staleness(chunks: DataFrame, as_of: Column, max_age_hours: float = 24) -> DataFrame:
    """session, latest, stale: by the largest time stamp as a string, taken as UTC. Only two columns are read."""
    rows = chunks.groupBy("session").agg(F.max("timestamp").alias("latest"))
    at = F.coalesce(F.try_to_timestamp(F.substring("latest", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp("latest", F.lit("yyyy-MM-dd")))
    hours = (F.unix_micros(as_of) - F.unix_micros(at)) / 3600e6
    return rows.withColumn("stale", F.coalesce(hours > max_age_hours, F.lit(True)))
