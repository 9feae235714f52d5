"""Fetch telemetry: per-domain aggregates, latency windows and the concurrency controller."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

FETCH_SCHEMA = "seq long, domain string, latency double, failed boolean, rate_limited boolean, content_empty boolean, status_code int"


def clean_records(fetches: DataFrame) -> DataFrame:
    """Records as they are appended: negative latencies are 0."""
    return fetches.withColumn("latency", F.greatest(F.lit(0.0), F.col("latency")))


def by_domain(fetches: DataFrame) -> DataFrame:
    """fetches, failures and rate limits per domain; mean latency is over successes, 0 without any."""
    ok = ~F.col("failed")
    return fetches.groupBy("domain").agg(
        F.count(F.lit(1)).alias("fetches"),
        F.sum(F.col("failed").cast("long")).alias("failures"),
        F.sum(F.col("rate_limited").cast("long")).alias("rate_limited"),
        F.round(F.coalesce(F.avg(F.when(ok, F.col("latency"))), F.lit(0.0)), 4).alias("avg_latency"),
        F.round(F.avg(F.col("failed").cast("double")), 4).alias("failure_rate"),
    )


def with_chunks(fetch_stats: DataFrame, chunk_stats: DataFrame) -> DataFrame:
    """Full outer join of by_domain() with the last chunk record of each domain (columns domain, seq, chunks_total, chunks_kept, coherence_sum)."""
    last = chunk_stats.groupBy("domain").agg(F.max_by(F.struct("chunks_total", "chunks_kept", "coherence_sum"), "seq").alias("c")).select("domain", "c.*")
    both = fetch_stats.join(last, "domain", "full_outer")
    zero = F.lit(0.0)
    hit = F.round(F.coalesce(F.try_divide("chunks_kept", "chunks_total"), zero), 4)
    return both.select(
        "domain",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("fetches", "failures", "rate_limited")],
        *[F.coalesce(c, zero).alias(c) for c in ("avg_latency", "failure_rate")],
        F.coalesce("chunks_total", F.lit(0)).cast("long").alias("chunks_total"),
        F.round(F.coalesce(F.try_divide("coherence_sum", "chunks_kept"), zero), 4).alias("avg_chunk_quality"),
        hit.alias("useful_hit_rate"),
        F.round(1 - hit, 4).alias("irrelevance_rate"),
    )


def global_failure_rate(fetch_stats: DataFrame) -> DataFrame:
    return fetch_stats.agg(F.round(F.coalesce(F.try_divide(F.sum("failures"), F.sum("fetches")), F.lit(0.0)), 6).alias("failure_rate"))


def latency_window(fetches: DataFrame, order: list[str], size: int = 50, group: str = "domain") -> DataFrame:
    """p50 and p95 (nearest rank) of the last ``size`` successes of each group, as of every success."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(-(size - 1), 0)
    sample = F.array_sort(F.collect_list("latency").over(w))
    n = F.size("sample")
    return fetches.filter(~F.col("failed")).withColumn("sample", sample).select(
        group, *order, F.element_at("sample", F.floor(n / 2).cast("int") + 1).alias("p50"), F.element_at("sample", F.least(F.floor(n * 0.95), n - 1).cast("int") + 1).alias("p95")
    )


class Controller:
    """Additive increase, multiplicative decrease of concurrency: a fold over request outcomes.

    ``now`` is the time of the event in seconds.
    """

    def __init__(self, low: int = 2, high: int = 20, cooldown: float = 5.0, window: int = 50):
        self.low, self.high, self.cooldown, self.window = low, high, cooldown, window
        self.concurrency, self.last_drop, self.samples = high // 2, float("-inf"), []
        self.domains: dict[str, list[int]] = {}  # domain: requests, failures, concurrency

    def p95(self) -> float:
        s = sorted(self.samples)
        return s[min(int(0.95 * len(s)), len(s) - 1)]

    def record(self, domain: str, latency: float, failed: bool, now: float) -> tuple[int, int]:
        """Global concurrency, and that of the domain, after this outcome."""
        if not failed:
            self.samples = [*self.samples, latency][-self.window :]
        state = self.domains.setdefault(domain, [0, 0, 5])
        state[0] += 1
        state[1] += failed
        rate = state[1] / state[0]
        if rate > 0.40 and state[0] >= 3:
            state[2] = max(1, state[2] // 2)
        elif not failed and rate < 0.05:
            state[2] = min(5, state[2] + 1)
        if self.samples:
            total, bad = sum(d[0] for d in self.domains.values()), sum(d[1] for d in self.domains.values())
            p95, share, cooled = self.p95(), bad / total, now - self.last_drop > self.cooldown
            if share > 0.20 or p95 > 4.0:
                lower = max(self.low, int(self.concurrency * 0.6))
                if cooled and lower != self.concurrency:
                    self.concurrency, self.last_drop = lower, now
            elif share < 0.05 and p95 < 1.5 and cooled:
                self.concurrency = min(self.high, self.concurrency + 1)
        return self.concurrency, state[2]

    def status(self) -> dict:
        """The numbers as they stand."""
        total, bad = sum(d[0] for d in self.domains.values()), sum(d[1] for d in self.domains.values())
        s = sorted(self.samples)
        return {
            "concurrency": self.concurrency, "failure_rate": round(bad / total, 3) if total else 0.0, "p50": round(s[len(s) // 2], 3) if s else 0.0, "p95": round(self.p95(), 3) if s else 0.0,
            "domains": {d: {"requests": n, "failures": f, "concurrency": c} for d, (n, f, c) in self.domains.items()},
        }


def control(fetches: DataFrame, group: str = "session", order: str = "seq", time: str = "at") -> DataFrame:
    """The controller's numbers after every event, one controller a group. Needs domain, latency, failed."""
    rows = fetches.select(F.col(group), F.col(order), "domain", "latency", "failed", F.col(time).cast("double").alias("at"))

    def step(c: Controller, r) -> dict:
        both = c.record(r.domain, r.latency, bool(r.failed), r.at)
        return {"concurrency": both[0], "domain_concurrency": both[1]}

    return streamed(rows, group, order, Controller, step, "concurrency int, domain_concurrency int")


def streamed(rows: DataFrame, group: str, order: str, start, step, schema: str) -> DataFrame:
    """group, order and what step(state, row) gives for every row of a group in order, state being start() at first.

    Groups are dealt over tasks and sorted there; a task holds one state and one batch of rows, so a group of any length fits.
    """
    kinds, names = dict(rows.dtypes), [x.split()[0] for x in schema.split(", ")]

    def run(parts):
        key, state = None, None
        for part in parts:
            found = []
            for own, r in zip(part[group], part.itertuples(), strict=True):
                if state is None or own != key:
                    key, state = own, start()
                found.append(step(state, r))
            yield pd.DataFrame({group: part[group].to_numpy(), order: part[order].to_numpy(), **{n: [f[n] for f in found] for n in names}})

    return rows.repartition(group).sortWithinPartitions(group, order).mapInPandas(run, f"{group} {kinds[group]}, {order} {kinds[order]}, {schema}")


def status(fetches: DataFrame, group: str = "session", order: str = "seq", time: str = "at", window: int = 50) -> DataFrame:
    """The controller's numbers as they stand at the end, per group: requests, failure_rate, p50, p95 (of the last successes), concurrency."""
    counts = fetches.groupBy(group).agg(F.count(F.lit(1)).alias("requests"), F.round(F.avg(F.col("failed").cast("double")), 3).alias("failure_rate"))
    last = control(fetches, group, order, time).groupBy(group).agg(F.max_by("concurrency", order).alias("concurrency"))
    recent = latency_window(fetches, [order], window, group).groupBy(group).agg(F.max_by(F.struct("p50", "p95"), order).alias("p")).select(group, F.round("p.p50", 3).alias("p50"), F.round("p.p95", 3).alias("p95"))
    return counts.join(last, group).join(recent, group, "left").select(group, "requests", "failure_rate", F.coalesce("p50", F.lit(0.0)).alias("p50"), F.coalesce("p95", F.lit(0.0)).alias("p95"), "concurrency")


def throttled(arrivals: DataFrame, group: str = "session", order: str = "seq", time: str = "at", rate: float = 10.0, capacity: float = 10.0) -> DataFrame:
    """group, order, passed: when each request of a group passes its token bucket."""
    class Bucket:
        tokens, last = capacity, None

    def step(b: Bucket, r) -> dict:
        b.tokens, at = bucket(b.tokens, b.last, r.at, rate, capacity)
        b.last = at
        return {"passed": at}

    return streamed(arrivals.select(group, order, F.col(time).cast("double").alias("at")), group, order, Bucket, step, "passed double")


def bucket(tokens: float, last: float | None, at: float, rate: float, capacity: float) -> tuple[float, float]:
    """(tokens left, when the request passes) after a request at a time; none passes before the one before it."""
    if last is not None:
        at = max(at, last)
        tokens = min(capacity, tokens + (at - last) * rate)
    if tokens < 1:
        return 0.0, at + (1 - tokens) / rate
    return tokens - 1, at


def chunk_records(domains: DataFrame) -> DataFrame:
    """What the collector is told of chunks: the mean coherence of all of a domain's chunks times the number that passed."""
    return domains.select("domain", F.lit(0).alias("seq"), F.col("total").alias("chunks_total"), F.col("passed").alias("chunks_kept"), (F.col("avg_coherence_score") * F.col("passed")).alias("coherence_sum"))


def collected(fetches: DataFrame, chunk_stats: DataFrame) -> DataFrame:
    """One row: domains, fetch_records, chunk_records, is_empty."""
    both = fetches.select("domain", F.lit(1).alias("f"), F.lit(0).alias("c")).unionByName(chunk_stats.select("domain", F.lit(0).alias("f"), F.lit(1).alias("c")))
    return both.agg(F.count_distinct("domain").alias("domains"), F.coalesce(F.sum("f"), F.lit(0)).cast("long").alias("fetch_records"), F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("chunk_records"), (F.count(F.lit(1)) == 0).alias("is_empty"))


def throttle(arrivals: list[float], rate: float = 10.0, capacity: float = 10.0) -> list[float]:
    """When each request passes a token bucket."""
    tokens, passed = capacity, []
    for at in arrivals:
        tokens, at = bucket(tokens, passed[-1] if passed else None, at, rate, capacity)
        passed.append(at)
    return passed


def reputation_signals(stats: DataFrame) -> DataFrame:
    """with_chunks() and the scrape score of each domain."""
    return stats.withColumn("scrape_score", F.round(S.scrape_score(F.col("avg_chunk_quality"), F.col("useful_hit_rate"), F.col("irrelevance_rate"), F.col("failure_rate"), F.col("avg_latency")), 6))
