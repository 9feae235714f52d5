"""Registered queries over stored state, expansions, context scores and renderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalar as S
from ..operators import classify as Q
from ..operators import context as X
from ..operators import rank as R
from ..operators import state as ST
from .base import events, strip_sql, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: customers as reputation rows: a domain each, a topic per nation; as of day 100.
REPUTATION = "r AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS domain, 't' || CAST(c_nationkey AS VARCHAR) AS topic, 0.1 + 0.9 * (abs(c_acctbal) % 100) / 100 AS conf, c_custkey % 9 AS scrapes, (c_custkey % 90) * 86400.0 AS upd FROM customer)"


def _reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, zero = table(spark, sf_dir, "customer"), F.lit(0.0)
    return c.select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("domain"), F.concat(F.lit("t"), F.col("c_nationkey").cast("string")).alias("topic"), (0.1 + 0.9 * (F.abs("c_acctbal") % 100) / 100).alias("retrieval_confidence"),
        *[zero.alias(m) for m in ST.METRICS], (F.col("c_custkey") % 9).cast("int").alias("total_scrapes"), ((F.col("c_custkey") % 90) * 86400.0).cast("double").alias("last_updated"),
    )


@query(f"""WITH {REPUTATION}, k AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) AS domain, 't' || CAST(o_orderkey % 25 AS VARCHAR) AS topic FROM orders GROUP BY ALL),
j AS (SELECT k.*, scrapes, CASE WHEN conf IS NULL THEN 0.5 ELSE greatest(0.1, conf * pow(0.98, (8640000 - upd) / 86400)) END AS c FROM k LEFT JOIN r ON r.domain = k.domain AND r.topic = k.topic)
SELECT domain, topic, round(c, 6) AS confidence, round(CASE WHEN coalesce(scrapes, 0) < 5 THEN least(0.7, c) ELSE c END, 6) AS capped_confidence FROM j""")
def reputation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    keys = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("domain"), F.concat(F.lit("t"), (F.col("o_orderkey") % 25).cast("string")).alias("topic")).distinct()
    rows = ST.confidences(keys, _reputation(spark, sf_dir), 100 * ST.DAY)
    return rows.select("domain", "topic", F.round("confidence", 6).alias("confidence"), F.round("capped_confidence", 6).alias("capped_confidence"))


@query(f"""WITH {REPUTATION} SELECT domain, topic, CASE WHEN right(domain, 1) = '3' THEN 0.75 ELSE round(conf, 6) END::DOUBLE AS confidence FROM r UNION ALL SELECT 'new' || topic, topic, 0.75 FROM (SELECT DISTINCT topic FROM r)""")
def reputation_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _reputation(spark, sf_dir)
    changed = old.filter(F.col("domain").endswith("3")).withColumn("retrieval_confidence", F.lit(0.75))
    fresh = old.withColumn("domain", F.concat(F.lit("new"), "topic")).dropDuplicates(["domain", "topic"]).withColumn("retrieval_confidence", F.lit(0.75))
    return ST.upsert(old, changed.unionByName(fresh), ["domain", "topic"]).select("domain", "topic", F.round("retrieval_confidence", 6).alias("confidence"))


@query(f"WITH {REPUTATION} SELECT domain, topic, round(conf, 6) AS confidence FROM r ORDER BY conf DESC, domain LIMIT 20")
def reputation_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ST.reputation_summary(_reputation(spark, sf_dir)).limit(20)
    return rows.select("domain", "topic", F.round("retrieval_confidence", 6).alias("confidence"))


#: parts as learned terms: a word of the type is the term, the brand's digit chooses the topic.
TOPIC_OF = "['tech', 'finance', 'science', 'sports', 'news', 'education', 'health'][CAST(p_partkey % 7 + 1 AS INT)]"
LEXICON = f"""l AS (SELECT term, topic, min(p_partkey) AS k FROM (SELECT *, lower(p_brand) || CAST(p_size AS VARCHAR) AS term, {TOPIC_OF} AS topic FROM part) GROUP BY term, topic),
a AS (SELECT term, topic, 0.5 + (k % 50) / 101.3 AS avg, 8 + k % 30 AS obs, (k % 40) * 86400.0 AS upd FROM l WHERE k % 3 > 0),
w AS (SELECT *, round(CASE WHEN 4320000 > upd THEN round(greatest(0.2, avg * pow(0.98, (4320000 - upd) / 86400)), 4) ELSE avg END * log10(obs + 1) * least(1.0, obs / 10), 4) AS weight FROM a)"""


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    topic = F.element_at(F.array(*map(F.lit, ["tech", "finance", "science", "sports", "news", "education", "health"])), (F.col("p_partkey") % 7 + 1).cast("int"))
    rows = p.select(F.concat(F.lower("p_brand"), F.col("p_size").cast("string")).alias("term"), topic.alias("topic"), "p_partkey").groupBy("term", "topic").agg(F.min("p_partkey").alias("k"))
    return rows.select(
        "term", "topic", (8 + F.col("k") % 30).cast("int").alias("observations"), F.lit(5.0).alias("confidence_sum"), (0.5 + F.col("k") % 50 / 101.3).alias("avg_confidence"),
        F.when(F.col("k") % 3 > 0, "active").otherwise("candidate").alias("status"), F.lit(0).alias("consecutive_low"), ((F.col("k") % 40) * 86400.0).cast("double").alias("last_updated"),
    )


@query(f"""WITH {LEXICON}, q AS (SELECT conv_id * 1000 + turn AS query_id, text AS query, ['tech', 'finance', 'general', 'health'][CAST(turn % 4 + 1 AS INT)] AS topic, turn % 2 = 1 AS ambiguous FROM conversations),
f AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS n FROM w),
c AS (SELECT query_id, query, term, weight, 0 AS late FROM q JOIN f USING (topic) UNION ALL
 SELECT query_id, query, term, weight, 1 FROM q JOIN f ON f.topic = map_extract(MAP {{{", ".join(f"'{k}': '{v}'" for k, v in fixed.ADJACENT.items())}}}, q.topic)[1] AND f.n = 1 WHERE ambiguous),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, weight DESC, term) AS m FROM c WHERE weight >= 0.3 AND NOT contains(lower(query), term))
SELECT query_id, query || ' ' || string_agg(term, ' ' ORDER BY m) AS text FROM s WHERE m <= 3 GROUP BY query_id, query""")
def lexicon_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = F.element_at(F.array(*map(F.lit, ["tech", "finance", "general", "health"])), (F.col("turn") % 4 + 1).cast("int"))
    asked = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"), topic.alias("topic"), (F.col("turn") % 2 == 1).alias("ambiguous"))
    return ST.expand_queries(asked, _lexicon(spark, sf_dir), 50 * ST.DAY)


@query(f"WITH {LEXICON} SELECT term, topic, weight FROM w")
def active_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.lexicon_summary(_lexicon(spark, sf_dir).filter("status = 'active'"), 50 * ST.DAY).select("term", "topic", "weight")


#: Turns whose text begins a conversation count as asked before by the conversation after it.
@query(f"""WITH b AS (SELECT conv_id * 1000 + turn AS query_id, {strip_sql('text')} AS q FROM conversations),
h AS (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN q ELSE 'else' END AS asked FROM b),
v AS (SELECT query_id, 0 AS step, q AS text, 1.0 AS weight FROM b UNION ALL SELECT query_id, 1, q || ' 2026', 0.65 FROM b WHERE NOT contains(q, '2026') AND NOT contains(q, '2025'))
SELECT v.query_id, v.text, weight::DOUBLE AS weight FROM v JOIN h USING (query_id) WHERE length(v.text) BETWEEN 8 AND 180 AND lower(v.text) <> lower({strip_sql('asked')})""")
def unasked_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("conv_id") * 1000 + F.col("turn")
    asked = table(spark, sf_dir, "conversations").select(i.alias("query_id"), F.col("text").alias("query"), F.lit("general").alias("topic"))
    history = asked.select("query_id", F.when(F.col("query_id") % 2 == 0, S.strip(F.col("query"))).otherwise("else").alias("asked"))
    return Q.variants(asked, history=history).filter("strategy in ('original', 'year')").select("query_id", "text", "weight")


CONTEXT = """x AS (SELECT source AS query_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS pos, count(*) OVER (PARTITION BY source) AS n, doc_id, text, (10 - doc_id % 10) / 10.7 AS coherence, lang || '.example' AS domain FROM documents),
y AS (SELECT *, 0.5 * (1.0 - (pos - 1) / n) + 0.3 * coherence + 0.2 * CASE WHEN domain = 'en.example' THEN 0.9 ELSE 0.5 END AS raw, doc_id % 5 = 0 AS used FROM x),
z AS (SELECT *, round(CASE WHEN used THEN raw - 0.15 ELSE raw END, 4) AS score FROM y WHERE NOT used OR raw - 0.15 >= 0.75)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    pos = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return d.select(F.col("source").alias("query_id"), pos.alias("pos"), "doc_id", F.concat("doc_id", F.lit(" "), "text").alias("content"), F.concat(F.lit("https://"), "lang", F.lit(".example/"), "doc_id").alias("source"), F.lit("").alias("title"), pos.alias("chunk_index"), ((10 - F.col("doc_id") % 10) / 10.7).alias("coherence_score"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    reputation = spark.createDataFrame([("en.example", 0.9)], "domain string, confidence double")
    used = chunks.filter("doc_id % 5 = 0").select("query_id", S.fingerprint(F.col("content")).alias("fingerprint"))
    return X.score_chunks(chunks, reputation, used)


@query(f"WITH {CONTEXT} SELECT query_id, doc_id, score, used AS previously_used FROM z")
def context_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("query_id", "doc_id", "score", "previously_used")


@query(f"""WITH {CONTEXT}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS place FROM z)
SELECT query_id, md5(string_agg('[Source: ' || domain || ' | Score: ' || printf('%.2f', score) || ' | Chunk: ' || pos || ']' || chr(10) || doc_id || ' ' || text, chr(10) || chr(10) ORDER BY place)) AS prompt FROM p WHERE place <= 10 GROUP BY query_id""")
def context_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks of a query, whole."""
    rows = _scored(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos"))).filter("place <= 10")
    return X.to_prompt(rows).select("query_id", F.md5("prompt").alias("prompt"))


@query("""WITH r AS (SELECT o_orderkey, ['news', 'sports', 'finance', 'entertainment', 'health', 'general', 'tech', 'science', 'education', 'other'][CAST(o_orderkey % 10 + 1 AS INT)] AS topic, o_totalprice / 600001.7 AS c, greatest(0.1, exp(-greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-01')) / 365)) AS f FROM orders),
w AS (SELECT *, CASE topic WHEN 'news' THEN 0.65 WHEN 'sports' THEN 0.6 WHEN 'finance' THEN 0.55 WHEN 'entertainment' THEN 0.5 WHEN 'health' THEN 0.45 WHEN 'tech' THEN 0.3 WHEN 'science' THEN 0.25 WHEN 'education' THEN 0.2 ELSE 0.4 END AS w FROM r)
SELECT o_orderkey, round((1 - w) * greatest(0.0, least(1.0, c)) + w * f, 6) AS combined_score FROM w""")
def recency_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["news", "sports", "finance", "entertainment", "health", "general", "tech", "science", "education", "other"]
    topic = F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % 10 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", topic.alias("topic"), (F.col("o_totalprice") / 600001.7).alias("coherence_score"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"))
    return R.rank_recency(rows, F.lit("1998-06-01").cast("date"), F.col("topic")).select("o_orderkey", F.round("combined_score", 6).alias("combined_score"))


@query("""SELECT event_type, CAST(user_id % 10 AS BIGINT) AS bucket, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL""")
def telemetry_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type", (F.col("user_id") % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
