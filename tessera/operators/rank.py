"""Ranking, URL selection and provider merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalar as S


def rank_recency(chunks: DataFrame, as_of: Column, topic: Column | None = None, default_weight: float = 0.4, decay_days: int = 365, top_k: int | None = None, *ties: str) -> DataFrame:
    """Chunks with combined_score, best first. The topic sets the weight of recency."""
    weight = S.topic_weight(topic, default_weight) if topic is not None else F.lit(default_weight)
    rows = chunks.withColumn("combined_score", S.blended(F.col("coherence_score"), F.col("timestamp"), as_of, weight, decay_days))
    rows = rows.orderBy(F.desc("combined_score"), *ties)
    return rows.limit(top_k) if top_k else rows


def blocked(domain: Column, match: str = "suffix") -> Column:
    """Whether a domain is on the block list: as a suffix of its labels, or (match="substring") anywhere in it."""
    if match == "substring":
        return F.exists(F.array(*map(F.lit, fixed.BLOCKED_DOMAINS)), lambda b: domain.contains(b))
    return F.exists(F.array(*map(F.lit, fixed.BLOCKED_DOMAINS)), lambda b: (domain == b) | domain.endswith(F.concat(F.lit("."), b)))


def url_scores(urls: DataFrame, reputation: DataFrame | None = None) -> DataFrame:
    """Adds domain and score: the reputation of (domain, topic), 0.5 where unknown, with a boost for priority domains that are at 0.5."""
    rows = urls.withColumn("domain", S.domain(F.col("url")))
    if reputation is not None:
        rows = rows.join(reputation.select("domain", "topic", "retrieval_confidence"), ["domain", "topic"], "left")
    else:
        rows = rows.withColumn("retrieval_confidence", F.lit(None).cast("double"))
    score = F.coalesce("retrieval_confidence", F.lit(0.5))
    boost = F.exists(F.array(*map(F.lit, fixed.PRIORITY_DOMAINS)), lambda p: F.col("domain").contains(p))
    return rows.withColumn("score", F.when((score == 0.5) & boost, score + 0.05).otherwise(score)).drop("retrieval_confidence")


def select_urls(urls: DataFrame, reputation: DataFrame | None = None, max_urls: int = 12, per_domain: int = 2, explore: float = 0.10, seed: str = "0", match: str = "substring") -> DataFrame:
    """query_id, url, domain, score, rank: per query the URLs to fetch.

    urls: query_id, topic, pos, url. Blocked domains go. By score all but a tenth are exploited; the
    rest follow in an order by hash. Of a domain two stay.
    """
    rows = url_scores(urls, reputation).filter(~blocked(F.col("domain"), match))
    by = Window.partitionBy("query_id")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(by)).withColumn("place", F.row_number().over(by.orderBy(F.desc("score"), "pos")))
    n_explore = F.greatest(F.lit(1), F.floor(F.col("n") * explore).cast("int"))
    exploring = F.col("place") > F.col("n") - n_explore
    rows = rows.withColumn("o", F.when(exploring, F.md5(F.concat("url", F.lit(seed)))).otherwise("")).withColumn("e", exploring.cast("int"))
    order = F.row_number().over(by.orderBy("e", "o", F.when(~exploring, F.col("place")).otherwise(F.lit(0)), "pos"))
    rows = rows.withColumn("order", order).withColumn("k", F.row_number().over(Window.partitionBy("query_id", "domain").orderBy("order"))).filter(F.col("k") <= per_domain)
    return rows.withColumn("rank", F.row_number().over(by.orderBy("order"))).filter(F.col("rank") <= max_urls).select("query_id", "url", "domain", "score", "rank")


def merge_providers(hits: DataFrame, k: int) -> DataFrame:
    """Hits (query_id, priority, rank, url, ...) of several providers: the first provider's, then as many of the next as are missing and three more; each URL once; k a query."""
    by = Window.partitionBy("query_id")
    rows = hits.filter(S.or_default(F.col("url"), "") != "").withColumn("lead", F.min("priority").over(by))
    first = F.sum((F.col("priority") == F.col("lead")).cast("int")).over(by)
    rows = rows.withColumn("have", first).filter((F.col("priority") == F.col("lead")) | ((F.col("have") < k) & (F.col("rank") <= k - F.col("have") + 3)))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "url").orderBy("priority", "rank"))).filter("n = 1")
    return rows.withColumn("n", F.row_number().over(by.orderBy("priority", "rank", "url"))).filter(F.col("n") <= k).drop("lead", "have").withColumnRenamed("n", "place")


def scored_hits(docs: DataFrame, max_chars: int, topic: str = "general") -> DataFrame:
    """Search results with a score that falls by a tenth a rank."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("pos")) - 1
    return docs.withColumn("score", 1.0 - 0.1 * place).withColumn("content", F.substring("content", 1, max_chars)).withColumn("domain", S.domain(F.col("source"))).withColumn("topic", F.lit(topic))


def rerank(chunks: DataFrame, k: int | None = None, scorer: Column | None = None, *ties: str) -> DataFrame:
    """The best chunks by a scorer's column, else by coherence."""
    return chunks.orderBy(F.desc(scorer if scorer is not None else F.col("coherence_score")), *ties).limit(k or 5)


def lexical_scorer(query: Column, content: Column) -> Column:
    """Share of the query's words that the content has."""
    q = F.array_distinct(F.transform(S.words(query), F.lower))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, F.transform(S.words(content), F.lower))), F.size(q)), F.lit(0.0))


def first_per_domain(chunks: DataFrame, *order: str) -> DataFrame:
    w = Window.partitionBy("domain").orderBy(*order)
    return chunks.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def head_urls(urls: DataFrame, max_urls: int = 12, match: str = "substring") -> DataFrame:
    """query_id, url, domain, rank: what is fetched without a selector: the first URLs that aren't blocked."""
    rows = urls.withColumn("domain", S.domain(F.col("url"))).filter(~blocked(F.col("domain"), match))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).filter(F.col("rank") <= max_urls).select("query_id", "url", "domain", "rank")
