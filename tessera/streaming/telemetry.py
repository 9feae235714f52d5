"""Structured Streaming: telemetry windows, and reputation and lexicon that evolve with a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import state as ST
from ..operators.telemetry import Controller


def windowed(fetches: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts, failures and mean latency of successes per domain and window of event time; later events than ``late`` are left out."""
    span = F.window(time, width, slide) if slide else F.window(time, width)
    rows = fetches.withWatermark(time, late).groupBy(span.alias("w"), "domain").agg(
        F.count(F.lit(1)).alias("fetches"), F.sum(F.col("failed").cast("long")).alias("failures"), F.coalesce(F.avg(F.when(~F.col("failed"), F.col("latency"))), F.lit(0.0)).alias("avg_latency")
    )
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "domain", "fetches", "failures", "avg_latency")


def sessions(fetches: DataFrame, time: str = "ts", late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Events of a domain that follow each other within ``gap``."""
    rows = fetches.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), "domain").agg(F.count(F.lit(1)).alias("fetches"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "domain", "fetches")


def without_repeats(rows: DataFrame, keys: list[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def keyed_state(rows: DataFrame, keys: list[str], schema: str, step: Callable[[dict | None, dict], dict], order: list[str]) -> DataFrame:
    """The state of each key after every micro-batch that touched it: the same step as the batch fold, in order within a batch.

    Output mode update. State is a row with the schema's columns, kept in the state store.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [x.split()[1] for x in schema.split(", ")]
    own = [(n, k) for n, k in zip(names, kinds, strict=True) if n not in keys]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip([n for n, _ in own], state.get, strict=True)) if state.exists else None
        for record in pd.concat(list(parts)).sort_values(order, kind="stable").to_dict("records"):
            now = step(now, record)
        state.update(tuple(now[n] for n, _ in own))
        yield pd.DataFrame([{**dict(zip(keys, key, strict=True)), **now}], columns=names)

    return rows.groupBy(*keys).applyInPandasWithState(run, schema, ", ".join(f"{n} {k}" for n, k in own), "update", GroupStateTimeout.NoTimeout)


def reputation_stream(signals: DataFrame) -> DataFrame:
    """Reputation rows as signals (domain, topic, five metrics, at, seq) arrive."""
    return keyed_state(signals, ["domain", "topic"], ST.REPUTATION_SCHEMA, lambda s, r: ST.reputation_step(s, r)[0], ["at", "seq"])


def lexicon_stream(observations: DataFrame, explore: float = 0.02, seed: str = "0") -> DataFrame:
    """Lexicon rows as observations (term, topic, confidence, at, seq) arrive."""
    return keyed_state(observations, ["term", "topic"], ST.LEXICON_SCHEMA, lambda s, r: ST.lexicon_step(s, r, explore, seed), ["at", "seq"])


def controller_stream(fetches: DataFrame) -> DataFrame:
    """Concurrency per session as outcomes (session, seq, domain, latency, failed, at) arrive; the controller's state is kept as JSON."""
    import json

    def step(state: dict | None, seen: dict) -> dict:
        c = Controller()
        if state:
            saved = json.loads(state["memo"])
            c.concurrency, c.samples, c.domains = saved["c"], saved["s"], saved["d"]
            c.last_drop = float("-inf") if saved["l"] is None else saved["l"]
        c.record(seen["domain"], seen["latency"], bool(seen["failed"]), seen["at"])
        last = None if c.last_drop == float("-inf") else c.last_drop
        return {"concurrency": c.concurrency, "memo": json.dumps({"c": c.concurrency, "s": c.samples, "d": c.domains, "l": last})}

    return keyed_state(fetches, ["session"], "session string, concurrency int, memo string", step, ["at", "seq"])


def rolling_latency(fetches: DataFrame, size: int = 50, time: str = "ts") -> DataFrame:
    """domain, n, p50, p95 (nearest rank) of the last ``size`` successes of each domain, after every micro-batch that touched it."""
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        new = pd.concat(list(parts)).sort_values("at", kind="stable")
        held = [*held, *new["latency"][~new["failed"].astype(bool)].tolist()][-size:]
        state.update((held,))
        s = sorted(held)
        if s:
            yield pd.DataFrame({"domain": [key[0]], "n": [len(s)], "p50": [s[len(s) // 2]], "p95": [s[min(int(0.95 * len(s)), len(s) - 1)]]})

    rows = fetches.select("domain", F.col(time).alias("at"), F.col("latency").cast("double").alias("latency"), "failed")
    return rows.groupBy("domain").applyInPandasWithState(run, "domain string, n long, p50 double, p95 double", "held array<double>", "update", GroupStateTimeout.NoTimeout)


def expired(rows: DataFrame, key: str, after_hours: float, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """key, latest: a row for each key once the watermark is ``after_hours`` past its newest event (sessions that are stale after 24, terms whose probation of 30 days ends). A later event starts anew."""
    def run(own: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            latest = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [own[0]], "latest": [pd.Timestamp(latest, unit="us")]})
            return
        newest = max(int(part["at"].max()) for part in parts)
        newest = max(newest, state.get[0]) if state.exists else newest
        state.update((newest,))
        state.setTimeoutTimestamp(max(newest // 1000 + int(after_hours * 3_600_000), state.getCurrentWatermarkMs() + 1))

    seen = rows.withWatermark(time, late).select(key, time, F.unix_micros(time).alias("at"))
    kind = dict(rows.dtypes)[key]
    return seen.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, latest timestamp", "latest long", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_each_batch(stream: DataFrame, path: str, keys: list[str], checkpoint: str, partitions: int = 64):
    """Keeps the newest row per key in a table (see upserted()): each batch rewrites only the partitions, by a hash of the key, that it touches.

    A batch that fails half-way is run again with the same rows, which changes nothing that it already did.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark, table = batch.sparkSession, f"{path.rstrip('/')}/rows"
        new = batch.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(partitions)).cast("int")).cache()
        touched = [r["part"] for r in new.select("part").distinct().collect()]
        if touched:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
            fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            rows = ST.upsert(spark.read.parquet(table).filter(F.col("part").isin(touched)).select(*new.columns), new, keys) if fs.exists(at) else new
            staged = f"{path.rstrip('/')}/staged/b{number:012d}"  # what is read can't be written over
            rows.write.mode("overwrite").parquet(staged)
            spark.read.parquet(staged).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(table)
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged), True)
        new.unpersist()

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)


def upserted(spark, path: str) -> DataFrame:
    """The table that upsert_each_batch() keeps."""
    return spark.read.parquet(f"{path.rstrip('/')}/rows").drop("part")
