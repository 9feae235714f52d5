"""What the plan modules share: table access and how test tables stand for the engine's own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own below the one that driver and executors share (``spark.checkpoint.dir``; on one machine, where that is unset, below /tmp)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(shared or f'/tmp/checkpoints/{spark.sparkContext.applicationId}').rstrip('/')}/plans/{name}-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as fetch telemetry: a domain per user, latency by value, errors as failures."""
    e = events(spark, sf_dir)
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("domain"), (F.col("value") / 100).alias("latency"), (F.col("event_type") == "error").alias("failed"),
        (F.col("event_type") == "signup").alias("rate_limited"), "ts",
    )


FETCHES = """f AS (SELECT event_id AS seq, 'd' || CAST(user_id AS VARCHAR) AS domain, value / 100 AS latency, event_type = 'error' AS failed, event_type = 'signup' AS rate_limited, ts FROM events)"""
#: White space trimmed as the engine does it, and words.
STRIP = r"regexp_replace({0}, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g')"


def strip_sql(c: str) -> str:
    return STRIP.format(c)


def words_sql(c: str) -> str:
    return rf"list_filter(regexp_split_to_array({c}, '[\s\x{{A0}}]+'), lambda w: w <> '')"


def usefulness_sql(c: str) -> str:
    from ..functions import fixed

    noise = "|".join(fixed.PAGE_NOISE)
    w = words_sql(c)
    short = f"CASE WHEN len({w}) > 0 THEN len(list_filter({w}, lambda x: length(x) <= 3)) / len({w}) ELSE 1.0 END"
    n = f"length({c})"
    sentences = f"len(list_filter(regexp_split_to_array({c}, '[.!?]+'), lambda s: length({strip_sql('s')}) > 10))"
    return f"""CASE WHEN regexp_matches(lower({c}), '{noise}') THEN 0.1 ELSE round(greatest(0.0, least(1.0,
      0.45 * (CASE WHEN {n} < 150 THEN {n} / 150 * 0.5 ELSE least(1.0, 0.5 + ({n} - 150) / 1000) END)
      + 0.35 * greatest(0.0, 1 - ({short}) / 0.6) + 0.20 * (least(0.2, {sentences} * 0.02) / 0.2))), 4) END"""
