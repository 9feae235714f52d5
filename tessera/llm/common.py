"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Separators between words of letters and digits: every ASCII character that is neither.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text that isn't lower-cased yet.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: ASCII white space, which separates plain words.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is missing, a folder of the application's own below /tmp serves in its place, but
    only if Spark runs on one machine (as in tests); on a cluster that is an error.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends, and sizes are known to the planner. discard() removes it."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.mode("overwrite").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _TABLES[id(found)] = (found, path)
    return found


#: The tables that materialize() wrote and discard() hasn't removed, by the frame that reads them.
_TABLES: dict[int, tuple[DataFrame, str]] = {}


def discard(*frames: DataFrame | None) -> None:
    """Removes tables of materialize() from which nothing is read any more."""
    for df in frames:
        known = _TABLES.pop(id(df), None)
        if known:
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(known[1])
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of an Arrow batch between executor and Python worker, at most. Texts are some KB each, and executor and worker hold a whole batch.
BATCH_ROWS = 512


def few_rows_a_batch(spark: SparkSession) -> None:
    """From now on the session sends Python workers batches of at most BATCH_ROWS rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def give_back(spark: SparkSession) -> None:
    """Has the executors collect their garbage, so that heaps which have grown shrink and Python workers beside them have the room."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the cheap path, as both ways agree there."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_key(id_col: str, text_col: str) -> Column:
    """A number that tells rows of one id with different texts apart; null counts as empty text."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def alnum_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits and of anything beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(text), NON_WORD), "")


#: Bytes of Parquet, as the planner knows them, beyond which nothing is broadcast whatever its rows.
BROADCAST_BYTES = 100_000_000


def small(df: DataFrame, rows: int) -> bool:
    """Whether df holds at most so many rows, of which it looks at no more than one beyond, and BROADCAST_BYTES."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= BROADCAST_BYTES and df.limit(rows + 1).count() <= rows


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast df behind a check of its size, else leave the join to the planner."""
    return F.broadcast(df) if small(df, rows) else df
