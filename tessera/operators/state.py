"""State that evolves with observations: domain reputation and the learned lexicon.

The steps are plain functions of (state, observation); batch folds and streams run the same
ones. A batch fold streams over rows sorted by key and time, so a key of any size needs no more
memory than one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalar as S

DAY = 86400.0
REPUTATION_SCHEMA = "domain string, topic string, retrieval_confidence double, avg_chunk_quality double, useful_hit_rate double, irrelevance_rate double, failure_rate double, avg_latency double, total_scrapes int, last_updated double"
LEXICON_SCHEMA = "term string, topic string, observations int, confidence_sum double, avg_confidence double, status string, consecutive_low int, last_updated double"
METRICS = ("avg_chunk_quality", "useful_hit_rate", "irrelevance_rate", "failure_rate", "avg_latency")


def _clamp(x: float, low: float = 0.0, high: float = 1.0) -> float:
    return max(low, min(high, x))


def scrape_score(q: float, hit: float, irr: float, fail: float, latency: float) -> float:
    q, hit, irr, fail = map(_clamp, (q, hit, irr, fail))
    return _clamp(0.35 * q + 0.25 * hit + 0.15 * (1 - irr) + 0.15 * (1 - fail) + 0.10 / (1 + max(0.0, latency)))


def reputation_step(state: dict | None, seen: dict) -> tuple[dict, float]:
    """(new state, confidence before it was rounded). seen: the five metrics, and at in seconds."""
    raw = [float(seen[m]) for m in METRICS]
    score = scrape_score(*raw)
    if state is None:
        confidence, values, scrapes = _clamp(0.8 * 0.5 + 0.2 * score, 0.1, 1.0), raw, 1
    else:
        old = max(0.1, state["retrieval_confidence"] * 0.98 ** ((seen["at"] - state["last_updated"]) / DAY))
        confidence = _clamp(0.8 * old + 0.2 * score, 0.1, 1.0)
        values, scrapes = [0.8 * state[m] + 0.2 * v for m, v in zip(METRICS, raw, strict=True)], state["total_scrapes"] + 1
    return {"retrieval_confidence": round(confidence, 4), **{m: round(v, 4) for m, v in zip(METRICS, values, strict=True)}, "total_scrapes": scrapes, "last_updated": float(seen["at"])}, confidence


def next_status(status: str, observations: int, average: float, low_streak: int) -> str:
    """Candidates graduate or are suppressed; active terms are suppressed or demoted, in this order."""
    if status == "candidate":
        if observations >= 8 and average >= 0.70:
            return "active"
        return "suppressed" if low_streak >= 10 else "candidate"
    if status == "active":
        if low_streak >= 13:
            return "suppressed"
        return "candidate" if low_streak >= 5 else "active"
    return status


def _chance(*parts) -> float:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def lexicon_step(state: dict | None, seen: dict, explore: float = 0.02, seed: str = "0") -> dict:
    """seen: term, topic, confidence, and at in seconds."""
    c, now = float(seen["confidence"]), float(seen["at"])
    if state is None:
        return {"observations": 1, "confidence_sum": round(c, 4), "avg_confidence": round(max(0.20, c), 4), "status": "candidate", "consecutive_low": int(c < 0.50), "last_updated": now}
    days = (now - state["last_updated"]) / DAY
    total = state["confidence_sum"] if days <= 0 else round(max(0.0, state["confidence_sum"] * 0.98**days), 4)
    n = state["observations"] + 1
    total += c
    average, status, streak = max(0.20, total / n), state["status"], state["consecutive_low"]
    if c < 0.50:
        streak += 1
    elif c >= 0.70:
        streak = 0
    settled = False
    if status == "suppressed":
        if days >= 30:
            status, streak = "candidate", 0
        else:
            settled = True
            if _chance(seen["term"], seen["topic"], n, seed) < explore:
                status, streak = "candidate", max(0, streak - 2)
    if not settled:
        status = next_status(status, n, average, streak)
    return {"observations": n, "confidence_sum": round(total, 4), "avg_confidence": round(average, 4), "status": status, "consecutive_low": streak, "last_updated": now}


def fold_sorted(rows: DataFrame, keys: list[str], order: list[str], schema: str, step: Callable, start: DataFrame | None = None, every: bool = False) -> DataFrame:
    """State per key after all of its rows in order (or, with every, after each row).

    step(state, row) gives the new state. start holds states from before, with the schema's columns.
    Rows are dealt by key and sorted; a task holds one state and one batch.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    seen = rows.select(*keys, *[c for c in rows.columns if c not in keys]).withColumn("_old", F.lit(None).cast(f"struct<{', '.join(x.replace(' ', ':', 1) for x in schema.split(', '))}>"))
    if start is not None:
        old = start.select(*keys, F.struct(*names).alias("_old"))
        seen = seen.unionByName(old, allowMissingColumns=True)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for part in parts:
            out = []
            for record in part.to_dict("records"):
                own = tuple(record[k] for k in keys)
                if own != key:
                    if key is not None and state is not None and not every:
                        out.append({**dict(zip(keys, key, strict=True)), **state})
                    key, state = own, None
                if record["_old"] is not None:
                    state = {k: v for k, v in dict(record["_old"]).items() if k not in keys}
                    continue
                state = step(state, record)
                if every:
                    out.append({**{n: record.get(n) for n in names}, **dict(zip(keys, own, strict=True)), **state})
            yield pd.DataFrame(out, columns=names)
        if key is not None and state is not None and not every:
            yield pd.DataFrame([{**dict(zip(keys, key, strict=True)), **state}], columns=names)

    dealt = seen.repartition(*keys).sortWithinPartitions(*keys, F.col("_old").isNull(), *order)
    return dealt.mapInPandas(run, schema)


def update_reputation(signals: DataFrame, state: DataFrame | None = None, order: tuple[str, ...] = ("at",), every: bool = False) -> DataFrame:
    """Reputation rows per (domain, topic) after the signals (domain, topic, five metrics, at)."""
    return fold_sorted(signals, ["domain", "topic"], list(order), REPUTATION_SCHEMA, lambda s, r: reputation_step(s, r)[0], state, every)


def notify(reputation: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Those updates that the lexicon hears of."""
    return reputation.filter(F.col("retrieval_confidence") >= threshold)


def observe_terms(observations: DataFrame, state: DataFrame | None = None, order: tuple[str, ...] = ("at",), explore: float = 0.02, seed: str = "0", every: bool = False) -> DataFrame:
    """Lexicon rows per (term, topic) after the observations (term, topic, confidence, at)."""
    return fold_sorted(observations, ["term", "topic"], list(order), LEXICON_SCHEMA, lambda s, r: lexicon_step(s, r, explore, seed), state, every)


def observed(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """A row per term of each query, beside its other columns."""
    return queries.withColumn("term", F.explode(S.terms(F.col(query_col))))


def confidences(keys: DataFrame, reputation: DataFrame, as_of: float) -> DataFrame:
    """keys (domain, topic) with confidence: decayed to as_of, 0.5 where unseen, and capped to 0.70 while there were fewer than five scrapes."""
    rows = keys.join(reputation, ["domain", "topic"], "left")
    now = F.when(F.col("retrieval_confidence").isNull(), 0.5).otherwise(S.decay_reputation(F.col("retrieval_confidence"), (F.lit(as_of) - F.col("last_updated")) / DAY))
    return rows.withColumn("confidence", now).withColumn("capped_confidence", F.when(F.coalesce("total_scrapes", F.lit(0)) < 5, F.least(F.lit(0.70), now)).otherwise(now)).select(*keys.columns, "confidence", "capped_confidence")


def weighted_terms(lexicon: DataFrame, as_of: float) -> DataFrame:
    """The lexicon with weight, decayed to as_of."""
    average, total = S.decay_term(F.col("avg_confidence"), F.col("confidence_sum"), (F.lit(as_of) - F.col("last_updated")) / DAY)
    return lexicon.withColumn("avg_confidence", average).withColumn("confidence_sum", total).withColumn("weight", S.term_weight(F.col("avg_confidence"), F.col("observations")))


def lexicon_summary(lexicon: DataFrame, as_of: float, topic: str | None = None) -> DataFrame:
    """All terms (of a topic) by weight."""
    rows = lexicon.filter(F.col("topic") == topic) if topic else lexicon
    return weighted_terms(rows, as_of).orderBy(F.desc("weight"), "term", "topic")


def reputation_summary(reputation: DataFrame, topic: str | None = None) -> DataFrame:
    """All rows (of a topic) by stored confidence."""
    rows = reputation.filter(F.col("topic") == topic) if topic else reputation
    return rows.orderBy(F.desc("retrieval_confidence"), "domain", "topic")


def expand_queries(queries: DataFrame, lexicon: DataFrame, as_of: float, most: int = 3, least_weight: float = 0.30) -> DataFrame:
    """query_id, text: queries (query_id, query, topic, ambiguous) with up to three active terms. Queries that get none are left out."""
    active = weighted_terms(lexicon.filter("status = 'active'"), as_of)
    adjacent = F.create_map(*[F.lit(x) for kv in fixed.ADJACENT.items() for x in kv])
    first = active.withColumn("n", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "term"))).select("topic", "term", "weight", "n")
    own = queries.join(first, "topic").select("query_id", "query", "term", "weight", F.lit(0).alias("late"))
    near = queries.filter("ambiguous").withColumn("topic", adjacent[F.col("topic")]).join(first.filter("n = 1"), "topic").select("query_id", "query", "term", "weight", F.lit(1).alias("late"))
    rows = own.unionByName(near).filter((F.col("weight") >= least_weight) & ~F.lower("query").contains(F.lower("term")))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("late", F.desc("weight"), "term"))).filter(F.col("n") <= most)
    listed = rows.groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct("n", "term"))).alias("t"))
    return listed.select("query_id", F.concat_ws(" ", "query", F.array_join(F.transform("t", lambda x: x["term"]), " ")).alias("text"))


def term_id(term, topic):
    return F.substring(F.md5(F.concat(term, F.lit(":"), topic)), 1, 16)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def top_reputation(reputation: DataFrame, domain: str = "", topic: str | None = None, most: int = 20) -> DataFrame:
    """The best rows of domains that contain a text (and of a topic)."""
    return reputation_summary(reputation.filter(F.col("domain").contains(domain)), topic).limit(most)


def top_terms(lexicon: DataFrame, status: str, topic: str | None = None) -> DataFrame:
    """Active terms by mean confidence (15), or candidates by observations (20)."""
    rows = lexicon.filter(F.col("status") == status)
    rows = rows.filter(F.col("topic") == topic) if topic else rows
    by, most = ("observations", 20) if status == "candidate" else ("avg_confidence", 15)
    return rows.orderBy(F.desc(by), "term", "topic").limit(most)
