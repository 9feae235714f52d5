"""Registered queries over documents made, stored, ranked, throttled, inspected and rendered, and over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalar as S
from ..index import ChunkStore, indexable
from ..operators import classify as Q
from ..operators import context as X
from ..operators import documents as D
from ..operators import rank as R
from ..operators import render as RD
from ..operators import state as ST
from ..operators import telemetry as TM
from ..sources import files, providers
from .base import FETCHES, events, fetches, scratch, strip_sql, table, words_sql
from .query_plans import BY_DOMAIN, CHUNK_STATS, DOMAIN, KEYWORDS, _chunk_stats
from .state_plans import LEXICON, REPUTATION, _lexicon, _reputation
from .text_plans import CTX, EVALUATED, _chunks, _context

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- documents
@query("""SELECT 'in/' || source || '/' || doc_id AS source, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) ELSE lang END AS title, CASE WHEN doc_id % 2 = 0 THEN '2024-01-01' ELSE '2025-06-01T00:00:00' END AS timestamp, '' AS author, '' AS image, length(text) AS n FROM documents""")
def documents_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of rows, every third without a title and every other without a date."""
    i = F.col("doc_id")
    made = D.make_documents(table(spark, sf_dir, "documents"), F.col("text"), F.concat(F.lit("in/"), "source", F.lit("/"), i.cast("string")), F.when(i % 3 == 0, "").otherwise(F.col("lang")), F.when(i % 2 == 0, "2024-01-01"), F.lit("2025-06-01T00:00:00"))
    return made.select("source", "title", "timestamp", "author", "image", F.length("content").cast("long").alias("n"))


@query(f"SELECT doc_id FROM documents WHERE length({strip_sql('text')}) > 200 AND NOT regexp_matches(lower(text), '{'|'.join(fixed.INJECTION_JUNK)}')")
def injectable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.injectable(table(spark, sf_dir, "documents").withColumnRenamed("text", "content")).select("doc_id")


@query(f"""WITH f AS (SELECT *, CASE WHEN length(text) = 0 OR length(regexp_replace(text, '[^\\x{{80}}-\\x{{9f}}]', '', 'g')) / greatest(length(text), 1) > 0.05 THEN 'garbage' WHEN length(text) - length(replace(text, '|', '')) > 4 THEN 'table'
 WHEN len(l) > 0 AND len(list_filter(l, lambda x: length(x) < 30)) / len(l) > 0.7 THEN 'nav' ELSE 'paragraph' END AS format
 FROM (SELECT doc_id, source, {strip_sql('text')} AS text, list_filter(list_transform(string_split({strip_sql('text')}, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') AS l FROM documents WHERE doc_id % 10 < 8))
SELECT min(doc_id) AS doc_id, format FROM f WHERE format NOT IN ('garbage', 'nav') GROUP BY source, format, CASE WHEN format = 'table' THEN text ELSE array_to_string({words_sql('text')}, ' ') END""")
def readable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `read` shows: coherent chunks that are neither garbage nor navigation, each text of a source once."""
    d = table(spark, sf_dir, "documents")
    chunks = d.select("doc_id", "source", S.strip(F.col("text")).alias("content"), ((10 - F.col("doc_id") % 10) / 10).alias("coherence_score"))
    return D.readable(chunks, "doc_id", key="source").select("doc_id", "format")


@query(f"WITH {EVALUATED}, d AS (SELECT domain, round(sum(ok::INT) / count(*), 4) AS hit_rate FROM v WHERE domain <> 'src0' GROUP BY domain) SELECT doc_id, hit_rate, round(1 - hit_rate, 4) AS irrelevance FROM v LEFT JOIN d USING (domain)")
def chunk_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks beside the quality of their domain; one domain has none."""
    chunks = D.evaluate_chunks(_chunks(spark, sf_dir))
    return D.with_domain_quality(chunks, D.domain_quality(chunks).filter("domain <> 'src0'")).select("doc_id", "hit_rate", "irrelevance")


@query(f"""WITH {EVALUATED}, d AS (SELECT domain, count(*) AS n, sum(ok::INT)::BIGINT AS k, round(avg(coherence), 4) AS c FROM v GROUP BY domain) SELECT domain, n AS chunks_total, k AS chunks_kept, round(c * k, 6) AS coherence_sum FROM d""")
def chunk_handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = TM.chunk_records(D.domain_quality(D.evaluate_chunks(_chunks(spark, sf_dir))))
    return rows.select("domain", "chunks_total", "chunks_kept", F.round("coherence_sum", 6).alias("coherence_sum"))


# ---- the store
INDEXED = """i AS (SELECT doc_id, 'u' || CAST(doc_id // 7 AS VARCHAR) AS url, text, doc_id % 7 AS chunk_index, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE (doc_id % 10) / 10 END AS c, lang FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY chunk_index, doc_id) - 1 AS place FROM i WHERE coalesce(c, 1.0) >= 0.3)"""


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(F.col("lang").alias("session"), F.col("text").alias("content"), F.lit(None).cast("string").alias("title"), F.concat(F.lit("u"), F.floor(i / 7).cast("string")).alias("source"), F.lit("").alias("timestamp"), F.lit(None).cast("string").alias("author"),
                    (i % 7).alias("chunk_index"), F.when(i % 5 == 4, None).otherwise(i % 10 / 10).alias("coherence_score"))


@query(f"WITH {INDEXED} SELECT url, substring(md5(url || '_b_' || place), 1, 12) AS id, md5(text) AS content, coalesce(c, 1.0)::FLOAT AS coherence_score, '' AS title, '' AS author FROM k")
def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as the store keeps them, with their ids."""
    rows = indexable(_indexed(spark, sf_dir), F.lit("s"), "b")
    return rows.select("url", "id", F.md5("content").alias("content"), "coherence_score", "title", "author")


@query("""SELECT session, n, CASE WHEN session = 'b' THEN 'second' ELSE 'first' END AS batch FROM (SELECT CASE WHEN item_id % 2 = 0 THEN 'a' ELSE 'b' END AS session, count(*) FILTER (item_id % 3 > 0 OR item_id % 2 = 0) AS n FROM benchmark GROUP BY 1)""")
def stored_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sessions are indexed, then one is replaced; what the store lists afterwards."""
    store, none = ChunkStore(spark, scratch(spark, "store")), F.lit("")
    items = table(spark, sf_dir, "benchmark")

    def chunks(rows: DataFrame, batch: str) -> DataFrame:
        return rows.select(F.col("text").alias("content"), F.lit(batch).alias("title"), F.concat(F.lit("item/"), "item_id").alias("source"), none.alias("timestamp"), none.alias("author"), F.lit(0).alias("chunk_index"), F.lit(0.9).alias("coherence_score"))

    for session, rest in (("a", 0), ("b", 1)):
        store.add(chunks(items.filter(F.col("item_id") % 2 == rest), "first"), session, "one")
    store.add(chunks(items.filter("item_id % 2 = 1 and item_id % 3 > 0"), "second"), "b", "two", force_new=True)
    return store.table().groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.max("title").alias("batch"))


# ---- urls and ranking
@query(f"""SELECT query_id, url, domain, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY page_id) AS rank FROM (SELECT page_id % 20 AS query_id, page_id, url, {DOMAIN} AS domain FROM pages)
 WHERE len(list_filter([{', '.join(f"'{b}'" for b in fixed.BLOCKED_DOMAINS)}], lambda b: contains(domain, b))) = 0) WHERE rank <= 12""")
def urls_without_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.head_urls(table(spark, sf_dir, "pages").select((F.col("page_id") % 20).alias("query_id"), F.col("page_id").alias("pos"), "url"))


@query(f"SELECT query_id, url, page_id FROM (SELECT page_id % 10 AS query_id, {DOMAIN} AS url, page_id, row_number() OVER (PARTITION BY page_id % 10, {DOMAIN} ORDER BY page_id % 3, page_id) AS n FROM pages) WHERE n = 1")
def first_seen_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the hits of three variants of a query each URL once."""
    i = F.col("page_id")
    hits = table(spark, sf_dir, "pages").select((i % 10).alias("query_id"), (i % 3).alias("variant"), "page_id", S.domain(F.col("url")).alias("url"))
    return providers.first_urls(hits, "variant", "page_id").select("query_id", "url", "page_id")


@query("SELECT min(vec_id) AS vec_id, label FROM embeddings GROUP BY label")
def first_seen_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by id, the first of each."""
    return D.first_by_key(table(spark, sf_dir, "embeddings").select("vec_id", "label"), F.col("label"), "vec_id")


@query("SELECT doc_id, (10 - doc_id % 10) / 10 AS coherence_score FROM documents ORDER BY coherence_score DESC, doc_id LIMIT 25")
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks without a model: by coherence."""
    return R.rerank(_chunks(spark, sf_dir), 25, None, "doc_id").select("doc_id", "coherence_score")


@query(f"""WITH q AS (SELECT list_distinct(list_transform({words_sql("'The house and the river of the stone'")}, lambda x: lower(x))) AS q), s AS (SELECT doc_id, len(list_intersect(q, list_transform({words_sql('text')}, lambda x: lower(x)))) / len(q) AS score FROM documents, q)
SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 25""")
def reranked_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", R.lexical_scorer(F.lit("The house and the river of the stone"), F.col("text")).alias("score"))
    return R.rerank(rows, 25, F.col("score"), "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT event_id, CASE WHEN value / 50 > 1 THEN greatest(0.0, 1 - value / 50) ELSE value / 50 END AS shown FROM events")
def display_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", S.display_score(F.col("value") / 50).alias("shown"))


TOPICS = [*fixed.BADGES, "else"]


@query(f"""SELECT doc_id, CASE topic {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.BADGES.items())} ELSE '◆' END AS badge FROM (SELECT doc_id, [{', '.join(f"'{t}'" for t in TOPICS)}][CAST(doc_id % {len(TOPICS)} + 1 AS INT)] AS topic FROM documents)""")
def topic_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = F.element_at(F.array(*map(F.lit, TOPICS)), (F.col("doc_id") % len(TOPICS) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", S.badge(topic).alias("badge"))


#: Learned terms: the first words of conversations, with a topic and weight each.
LEARNED = f"""t AS (SELECT term, ['tech', 'finance', 'science', 'sports', 'news', 'education', 'other'][CAST(k % 7 + 1 AS INT)] AS topic, 0.3 + (k % 10) / 20.7 AS weight FROM (SELECT lower({words_sql('text')}[1]) AS term, min(conv_id) AS k FROM conversations WHERE turn = 0 GROUP BY 1) WHERE length(term) >= 4)"""


@query(f"""WITH {KEYWORDS}, {LEARNED}, q AS (SELECT conv_id * 1000 + turn AS query_id, lower({strip_sql('text')}) AS q FROM conversations),
h AS (SELECT query_id, topic, topic_rank, times * (1 + 0.2 * (length(keyword) - length(replace(keyword, ' ', ''))))::DOUBLE AS w FROM q JOIN kw ON contains(q, keyword)
 UNION ALL SELECT query_id, t.topic, coalesce(topic_rank, 99), weight * 0.5 FROM q JOIN t ON contains(q, term) LEFT JOIN (SELECT topic, min(topic_rank) AS topic_rank FROM kw GROUP BY topic) r ON r.topic = t.topic),
s AS (SELECT query_id, topic, sum(w) AS w FROM h GROUP BY ALL) SELECT query_id, topic, round(w / sum(w) OVER (PARTITION BY query_id), 4) AS score FROM s""")
def learned_topic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics by keywords and by learned terms."""
    c = table(spark, sf_dir, "conversations")
    own = c.filter("turn = 0").groupBy(F.lower(F.try_element_at(S.words(F.col("text")), F.lit(1))).alias("term")).agg(F.min("conv_id").alias("k")).filter("length(term) >= 4")
    topic = F.element_at(F.array(*map(F.lit, ["tech", "finance", "science", "sports", "news", "education", "other"])), (F.col("k") % 7 + 1).cast("int"))
    asked = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    return Q.topic_scores(asked, lexicon=own.select("term", topic.alias("topic"), (0.3 + F.col("k") % 10 / 20.7).alias("weight"))).select("query_id", "topic", "score")


# ---- controller
CONTROLLED = f"""f AS (SELECT event_id AS seq, 's' || CAST(user_id // 4 AS VARCHAR) AS session, 'd' || CAST(user_id AS VARCHAR) AS domain, value / 61.3 AS latency, event_type = 'error' AS failed, epoch_us(ts) / 1e6 AS tm FROM events),
n AS (SELECT *, row_number() OVER s AS k, sum(failed::INT) OVER s / count(*) OVER s AS share, count(*) OVER d AS req, sum(failed::INT) OVER d / count(*) OVER d AS rate,
 row_number() OVER d AS dk FROM f WINDOW s AS (PARTITION BY session ORDER BY seq), d AS (PARTITION BY session, domain ORDER BY seq)),
ok AS (SELECT session, seq, list_sort(list(latency) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) AS s FROM f WHERE NOT failed),
p AS (SELECT n.*, ok.s[CAST(floor(len(ok.s) / 2) + 1 AS INT)] AS p50, ok.s[CAST(least(floor(len(ok.s) * 0.95), len(ok.s) - 1) + 1 AS INT)] AS p95 FROM n ASOF LEFT JOIN ok ON n.session = ok.session AND n.seq >= ok.seq)"""
FOLDED = f"""{CONTROLLED}, r AS (SELECT session, 0::BIGINT AS k, 10 AS c, -1e300::DOUBLE AS dropped FROM f GROUP BY session
 UNION ALL SELECT p.session, p.k,
  CASE WHEN p95 IS NULL THEN c WHEN share > 0.2 OR p95 > 4 THEN CASE WHEN tm - dropped > 5 THEN greatest(2, CAST(floor(c * 0.6) AS INT)) ELSE c END WHEN share < 0.05 AND p95 < 1.5 AND tm - dropped > 5 THEN least(20, c + 1) ELSE c END,
  CASE WHEN p95 IS NOT NULL AND (share > 0.2 OR p95 > 4) AND tm - dropped > 5 AND greatest(2, CAST(floor(c * 0.6) AS INT)) <> c THEN tm ELSE dropped END
 FROM r JOIN p ON p.session = r.session AND p.k = r.k + 1),
e AS (SELECT session, domain, 0::BIGINT AS dk, 5 AS c FROM f GROUP BY ALL
 UNION ALL SELECT p.session, p.domain, p.dk, CASE WHEN rate > 0.4 AND req >= 3 THEN greatest(1, c // 2) WHEN NOT failed AND rate < 0.05 THEN least(5, c + 1) ELSE c END FROM e JOIN p ON p.session = e.session AND p.domain = e.domain AND p.dk = e.dk + 1)"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = events(spark, sf_dir), F.col("user_id")
    return e.select(F.concat(F.lit("s"), F.floor(u / 4).cast("string")).alias("session"), F.col("event_id").alias("seq"), F.concat(F.lit("d"), u.cast("string")).alias("domain"), (F.col("value") / 61.3).alias("latency"), (F.col("event_type") == "error").alias("failed"), (F.unix_micros("ts") / 1e6).alias("at"))


@query(f"WITH RECURSIVE {FOLDED} SELECT p.session, p.seq, r.c AS concurrency, e.c AS domain_concurrency FROM p JOIN r ON r.session = p.session AND r.k = p.k JOIN e ON e.session = p.session AND e.domain = p.domain AND e.dk = p.dk")
def concurrency_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The controller's numbers after every event, a controller per session of up to four domains."""
    return TM.control(_sessions(spark, sf_dir))


@query(f"""WITH RECURSIVE {FOLDED} SELECT session, count(*) AS requests, round(avg(failed::INT), 3) AS failure_rate, round(coalesce(max_by(p50, p.seq) FILTER (p50 IS NOT NULL), 0.0), 3) AS p50, round(coalesce(max_by(p95, p.seq) FILTER (p95 IS NOT NULL), 0.0), 3) AS p95, max_by(r.c, p.seq) AS concurrency
FROM p JOIN r USING (session, k) GROUP BY session""")
def controller_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TM.status(_sessions(spark, sf_dir))


@query("""WITH RECURSIVE a AS (SELECT 's' || CAST(user_id // 4 AS VARCHAR) AS session, event_id AS seq, (event_id % 40) * 0.01 + event_id // 40 AS tm, row_number() OVER (PARTITION BY user_id // 4 ORDER BY event_id) AS k FROM events),
r AS (SELECT session, k, seq, 1.0::DOUBLE AS tokens, tm::DOUBLE AS passed FROM a WHERE k = 1
 UNION ALL SELECT session, k, seq, CASE WHEN t < 1 THEN 0 ELSE t - 1 END, CASE WHEN t < 1 THEN w + (1 - t) / 0.01 ELSE w END FROM
 (SELECT a.session, a.k, a.seq, greatest(a.tm, r.passed) AS w, least(2.0, r.tokens + (greatest(a.tm, r.passed) - r.passed) * 0.01) AS t FROM r JOIN a ON a.session = r.session AND a.k = r.k + 1))
SELECT session, seq, round(passed, 4) AS passed FROM r""")
def throttled_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token bucket of two, a token every hundred seconds, per session."""
    e, i = events(spark, sf_dir), F.col("event_id")
    rows = e.select(F.concat(F.lit("s"), F.floor(F.col("user_id") / 4).cast("string")).alias("session"), i.alias("seq"), (i % 40 * 0.01 + F.floor(i / 40)).alias("at"))
    return TM.throttled(rows, rate=0.01, capacity=2.0).select("session", "seq", F.round("passed", 4).alias("passed"))


@query(f"""WITH {FETCHES}, {BY_DOMAIN}, {CHUNK_STATS}, l AS (SELECT 'd' || CAST(doc_id % 200 AS VARCHAR) AS domain FROM labels) SELECT (SELECT count(DISTINCT domain) FROM (SELECT domain FROM f UNION ALL SELECT domain FROM l)) AS domains, (SELECT count(*) FROM f) AS fetch_records, (SELECT count(*) FROM l) AS chunk_records, FALSE AS is_empty""")
def collector_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TM.collected(fetches(spark, sf_dir), _chunk_stats(spark, sf_dir))


# ---- state
@query(f"WITH {REPUTATION} SELECT domain, topic, round(conf, 6) AS confidence FROM r WHERE conf >= 0.65")
def lexicon_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.notify(_reputation(spark, sf_dir)).select("domain", "topic", F.round("retrieval_confidence", 6).alias("confidence"))


@query(f"WITH {REPUTATION} SELECT domain, topic, round(conf, 6) AS confidence FROM r WHERE contains(domain, '1') AND topic = 't3' ORDER BY conf DESC, domain LIMIT 20")
def inspect_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.top_reputation(_reputation(spark, sf_dir), "1", "t3").select("domain", "topic", F.round("retrieval_confidence", 6).alias("confidence"))


ALL_TERMS = LEXICON.replace(" WHERE k % 3 > 0)", ", CASE WHEN k % 3 > 0 THEN 'active' ELSE 'candidate' END AS status FROM l)").replace("(k % 40) * 86400.0 AS upd FROM l,", "(k % 40) * 86400.0 AS upd,")


@query(f"WITH {ALL_TERMS} SELECT term, topic, status, weight FROM w")
def lexicon_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms with their decayed weights."""
    return ST.lexicon_summary(_lexicon(spark, sf_dir), 50 * ST.DAY).select("term", "topic", "status", "weight")


@query(f"""WITH {ALL_TERMS} SELECT * FROM (SELECT term, topic, 'active' AS status FROM a WHERE status = 'active' ORDER BY avg DESC, term, topic LIMIT 15) UNION ALL SELECT * FROM (SELECT term, topic, 'candidate' FROM a WHERE status = 'candidate' ORDER BY obs DESC, term, topic LIMIT 20)""")
def inspect_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _lexicon(spark, sf_dir)
    return ST.top_terms(terms, "active").unionByName(ST.top_terms(terms, "candidate")).select("term", "topic", "status")


# ---- renderings
@query(f"""WITH {CTX}, t AS (SELECT *, greatest(1, n_chars // 4) AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS place FROM c)
SELECT query_id, count(*) AS chunks, sum(tokens)::BIGINT AS total_tokens, round(sum(tokens) / 3000, 3) AS utilization, (SELECT string_agg(domain, ',' ORDER BY first) FROM (SELECT domain, min(place) AS first FROM t u WHERE u.query_id = t.query_id GROUP BY domain)) AS sources FROM t GROUP BY query_id""")
def context_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, tokens, share of the budget and sources in order of first use."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos"))
    rows = _context(spark, sf_dir).withColumn("tokens", F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4))).withColumn("place", place)
    return X.summarize(rows).withColumn("sources", F.array_join("sources", ","))


@query("""SELECT doc_id, md5('{"session":"' || lang || '","topic":' || CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE '"tech"' END || ',"query":"own","n":' || n_chars || '}') AS line FROM documents WHERE lang IS NOT NULL""")
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON line per chunk; its own query wins over the envelope's."""
    d = table(spark, sf_dir, "documents").filter("lang is not null")
    rows = d.select("doc_id", F.col("lang").alias("session"), F.when(F.col("doc_id") % 3 > 0, "tech").alias("topic"), F.lit("own").alias("query"), F.col("n_chars").alias("n"))
    return RD.chunk_lines(rows, "query", "n").select("doc_id", F.md5("line").alias("line"))


@query("SELECT conv_id, turn, role || ':' || substring(text, 1, 40) AS id FROM conversations")
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", RD.document_id(F.col("role"), F.col("text")).alias("id"))


RENDERED = "z AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, lang AS title, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'u' || doc_id END AS url, text, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id % 10) / 7.3 END AS score, (doc_id % 9) / 7.7 AS coherence FROM documents)"


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), i.alias("pos"), F.col("lang").alias("title"), F.when(i % 4 > 0, F.concat(F.lit("u"), i)).alias("source"), F.col("text").alias("content"), F.when(i % 3 > 0, i % 10 / 7.3).alias("score"), (i % 9 / 7.7).alias("coherence_score"))


@query(f"WITH {RENDERED} SELECT query_id, md5(string_agg('[' || n || '] ' || coalesce(title, '') || chr(10) || 'Source: ' || coalesce(url, '') || chr(10) || substring(text, 1, 600), chr(10) || chr(10) ORDER BY n)) AS prompt FROM z WHERE n <= 5 GROUP BY query_id")
def result_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RD.result_prompt(_rendered(spark, sf_dir)).select("query_id", F.md5("prompt").alias("prompt"))


@query(f"WITH {RENDERED} SELECT query_id, CAST(n AS INT) AS index, coalesce(url, 'unknown') AS source, round(coalesce(score, coherence, 0), 3) AS confidence, md5(text) AS text FROM z")
def listed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RD.listed_chunks(_rendered(spark, sf_dir)).withColumn("text", F.md5("text"))


@query(f"""WITH {RENDERED} SELECT query_id, md5('[RETRIEVAL CONTEXT]' || chr(10) || 'question: why' || chr(10) || 'chunks: ' || count(*) || chr(10) || chr(10) || string_agg('[' || n || '] ' || coalesce(url, 'unknown') || ' — confidence ' || round(coalesce(score, coherence, 0), 3) || chr(10) || {strip_sql('text')} || chr(10), chr(10) ORDER BY n) || chr(10) || '[END CONTEXT]') AS prompt FROM z GROUP BY query_id""")
def llm_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.llm_context(_rendered(spark, sf_dir).withColumn("question", F.lit("why"))).select("query_id", F.md5("prompt").alias("prompt"))


# ---- files
@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INT) AS n, 'key: ' || n_nationkey || ' | name: ' || n_name || ' | region: ' || CASE WHEN n_regionkey = 2 THEN 'nan' ELSE n_regionkey || '.0' END AS content FROM nation")
def csv_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as CSV and read as a document per row; missing cells read nan."""
    path = scratch(spark, "csv")
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") != 2, F.col("n_regionkey").cast("double")).alias("region"))
    rows.coalesce(1).write.option("header", True).csv(path)
    return files.read_csv(spark, path, now="2025-01-01").select(F.substring_index("source", "#row", -1).cast("int").alias("n"), "content")


@query("SELECT item_id, text AS content FROM (SELECT item_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM benchmark) WHERE text <> ''")
def txt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items written as a text file each and read whole."""
    path = scratch(spark, "txt")
    table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("value")).repartition("item_id").write.partitionBy("item_id").text(path)
    return files.read_txt(spark, path, now="2025-01-01", glob="*.txt").select(F.regexp_extract("source", r"item_id=(\d+)", 1).cast("long").alias("item_id"), "content")


@query("SELECT r_regionkey AS n, 'key: ' || r_regionkey || ' | names: ' || r_name || ' ' || lower(r_name) || ' | none: None | ok: True' AS content FROM region")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions written as one JSON list and read as a document per item."""
    path = scratch(spark, "json")
    item = F.to_json(F.struct(F.col("r_regionkey").alias("key"), F.array("r_name", F.lower("r_name")).alias("names"), F.lit(None).cast("string").alias("none"), F.lit(True).alias("ok")), {"ignoreNullFields": "false"})
    rows = table(spark, sf_dir, "region").select("r_regionkey", item.alias("item"))
    rows.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "item"))), lambda x: x["item"]), ","), F.lit("]")).alias("value")).write.text(path)
    return files.read_json(spark, path, now="2025-01-01", glob="*.txt").select(F.substring_index("source", "#item", -1).cast("int").alias("n"), "content")
