"""Registered queries over documents, pages and benchmark items."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalar as S
from ..operators import chunk as C
from ..operators import documents as D
from .base import strip_sql, table, usefulness_sql, words_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SENTENCES = r"""list_filter(list_transform(flatten(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'),
 '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: string_split(x, chr(10) || chr(10)))), lambda x: """ + strip_sql("x") + "), lambda x: x <> '')"
NOISY = "(length(s) < 15 OR regexp_matches(s, '(?i)^(?:" + "|".join(p.replace("'", "''") for p in fixed.SENTENCE_NOISE) + ")'))"


@query(f"SELECT doc_id, CAST(len({SENTENCES}) AS INT) AS n_sentences FROM documents")
def sentence_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(S.split_sentences(F.col("text"))).alias("n_sentences"))


@query(f"SELECT doc_id, count(*) AS n, count(*) FILTER (NOT {NOISY}) AS kept FROM (SELECT doc_id, unnest({SENTENCES}) AS s FROM documents) GROUP BY doc_id")
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.sentences(table(spark, sf_dir, "documents"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum((~S.is_noise(F.col("sentence"))).cast("long")).alias("kept"))


@query(rf"""WITH s AS (SELECT doc_id, unnest({SENTENCES}) AS s FROM documents)
SELECT doc_id, count(DISTINCT regexp_replace(lower({strip_sql('s')}), '[\s\x{{A0}}]+', ' ', 'g')) AS n FROM s GROUP BY doc_id""")
def distinct_sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.distinct_sentences(D.sentences(table(spark, sf_dir, "documents"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INT) AS tokens, substring(md5(substring(text, 1, 200)), 1, 12) AS fingerprint FROM documents")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.estimate_tokens(F.col("text")).alias("tokens"), S.fingerprint(F.col("text")).alias("fingerprint"))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY md5(substring(text, 1, 500)) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def doc_dedup_prefix_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.substring("text", 1, 500)).alias("key"))
    return D.first_by_key(docs, F.col("key"), "doc_id").select("doc_id", "source")


def _grams_sql(t: str, k: int) -> str:
    """Of a column that is lower-cased and trimmed already: the lambda would do it again for every run."""
    return f"list_distinct(list_transform(range(1, CAST(greatest(length({t}) - {k - 2}, 1) AS BIGINT)), lambda i: substring({t}, i, {k})))"


def _pairs_sql(k: int, t: float) -> str:
    grams = lambda name, key: f"(SELECT {key}, {_grams_sql('t', k)} AS g FROM (SELECT {key}, lower({strip_sql('text')}) AS t FROM {name}))"
    return f"""WITH b AS MATERIALIZED {grams('benchmark', 'item_id')}, d AS MATERIALIZED {grams('documents', 'doc_id')}
    SELECT doc_id AS left_id, item_id AS right_id, round(n / (x + y - n), 6) AS similarity FROM (SELECT doc_id, item_id, len(d.g) AS x, len(b.g) AS y, len(list_intersect(d.g, b.g)) AS n FROM d JOIN b ON len(d.g) >= {t} * len(b.g) AND len(b.g) >= {t} * len(d.g) AND len(d.g) > 0)
    WHERE n / (x + y - n) >= {t}"""


def _neighbours_sql(k: int, t: float) -> str:
    return f"""WITH s AS (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS pos FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)),
    g AS (SELECT doc_id, pos, {_grams_sql('t', k)} AS g FROM (SELECT doc_id, pos, lower({strip_sql('s[pos]')}) AS t FROM s)),
    p AS (SELECT doc_id, pos, g, lag(g) OVER (PARTITION BY doc_id ORDER BY pos) AS h FROM g),
    j AS (SELECT doc_id, CASE WHEN len(g) > 0 AND len(h) > 0 THEN len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) ELSE 0.0 END AS j FROM p WHERE h IS NOT NULL)
    SELECT doc_id, count(*) AS pairs, count(*) FILTER (j >= {t}) AS alike, round(max(j), 6) AS most FROM j GROUP BY doc_id"""


def _neighbours(spark: SparkSession, sf_dir: str, k: int, t: float) -> DataFrame:
    rows = D.sentences(table(spark, sf_dir, "documents")).withColumn("g", S.grams(F.col("sentence"), k))
    rows = rows.withColumn("h", F.lag("g").over(Window.partitionBy("doc_id").orderBy("pos"))).filter("h is not null").withColumn("j", S.jaccard(F.col("g"), F.col("h")))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum((F.col("j") >= t).cast("long")).alias("alike"), F.round(F.max("j"), 6).alias("most"))


@query(_neighbours_sql(3, 0.85))
def sentence_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the sentences of a document are to those before them, and how many are near duplicates by the sentences' measure."""
    return _neighbours(spark, sf_dir, 3, 0.85)


@query(_neighbours_sql(4, 0.80))
def chunk_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the chunks' measure."""
    return _neighbours(spark, sf_dir, 4, 0.80)


def _pairs(spark: SparkSession, sf_dir: str, k: int, t: float) -> DataFrame:
    found = D.near_duplicate_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k, t, "doc_id", "item_id")
    return found.withColumn("similarity", F.round("similarity", 6))


@query(_pairs_sql(3, 0.85))
def near_dup_jaccard3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are nearly a benchmark item, by the sentences' measure."""
    return _pairs(spark, sf_dir, 3, 0.85)


@query(_pairs_sql(4, 0.80))
def near_dup_jaccard4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the chunks' measure."""
    return _pairs(spark, sf_dir, 4, 0.80)


@query(f"SELECT doc_id, {usefulness_sql('text')} AS usefulness, regexp_matches(lower(text), '{'|'.join(fixed.PAGE_NOISE)}') AS noisy, length(text) >= 200 AND len(list_filter({words_sql('text')}, lambda x: length(x) <= 3)) / greatest(len({words_sql('text')}), 1) <= 0.6 AS useful FROM documents")
def usefulness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, noisy = S.usefulness(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("usefulness"), noisy.alias("noisy"), S.is_useful(F.col("text")).alias("useful"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: coherence falls with the last digit of the id; a session per language."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("text").alias("content"), F.col("source").alias("domain"), F.col("lang").alias("session"), ((10 - F.col("doc_id") % 10) / 10).alias("coherence_score"))


EVALUATED = f"""e AS (SELECT doc_id, source AS domain, lang AS session, (10 - doc_id % 10) / 10 AS coherence, {usefulness_sql('text')} AS useful, regexp_matches(lower(text), '{'|'.join(fixed.PAGE_NOISE)}') AS noisy, length(text) AS n FROM documents),
v AS (SELECT *, round(0.6 * coherence + 0.4 * useful, 4) AS composite, coherence >= 0.3 AND useful >= 0.3 AND n >= 150 AND NOT noisy AS ok FROM e)"""


@query(f"WITH {EVALUATED} SELECT doc_id, useful AS usefulness, composite, ok AS passed FROM v")
def evaluate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.evaluate_chunks(_chunks(spark, sf_dir)).select("doc_id", "usefulness", "composite", "passed")


@query(f"""WITH {EVALUATED}, d AS (SELECT domain, count(*) AS total, sum(ok::INT)::BIGINT AS passed, round(avg(noisy::INT), 4) AS noise_rate, round(round(avg(coherence), 4), 3) AS coherence, round(round(avg(useful), 4), 3) AS usefulness, round(round(avg(composite), 4), 3) AS composite, avg(composite) AS c FROM v GROUP BY domain)
SELECT domain, total, passed, noise_rate, coherence, usefulness, composite, round(passed / total, 4) AS hit_rate, round(1 - round(passed / total, 4), 4) AS irrelevance, passed >= 1 AND c >= 0.3 AS useful_source FROM d""")
def quality_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.domain_quality(D.evaluate_chunks(_chunks(spark, sf_dir)))
    three = {c: F.round(f"avg_{s}", 3).alias(c) for c, s in (("coherence", "coherence_score"), ("usefulness", "usefulness"), ("composite", "composite"))}
    return rows.select("domain", "total", "passed", "noise_rate", *three.values(), "hit_rate", "irrelevance", "useful_source")


@query(f"""WITH {EVALUATED}, d AS (SELECT session, domain, count(*) AS total, sum(ok::INT) AS passed, avg(composite) AS c FROM v GROUP BY ALL)
SELECT session, count(*) AS domains, sum((passed >= 1 AND c >= 0.3)::INT)::BIGINT AS useful_domains, sum(total)::BIGINT AS total, sum(passed)::BIGINT AS passed, round(sum(passed) / sum(total), 4) AS pass_rate,
round(sum(passed) / sum(total), 4) >= 0.25 AND sum(passed) >= 3 AS accepted FROM d GROUP BY session""")
def session_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.session_quality(D.domain_quality(D.evaluate_chunks(_chunks(spark, sf_dir)), "session", "domain"), "session")


@query(r"""SELECT doc_id, CASE WHEN length(text) = 0 OR length(regexp_replace(text, '[^\x{80}-\x{9f}]', '', 'g')) / greatest(length(text), 1) > 0.05 THEN 'garbage'
 WHEN length(text) - length(replace(text, '|', '')) > 4 THEN 'table'
 WHEN len(list_filter(string_split(text, chr(10)), lambda x: """ + strip_sql("x") + """ <> '')) > 0 AND len(list_filter(string_split(text, chr(10)), lambda x: length(""" + strip_sql("x") + """) BETWEEN 1 AND 29)) / len(list_filter(string_split(text, chr(10)), lambda x: """ + strip_sql("x") + """ <> '')) > 0.7 THEN 'nav'
 ELSE 'paragraph' END AS format FROM documents""")
def detected_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.detect_format(F.col("text")).alias("format"))


@query("""WITH c AS (SELECT doc_id, text, substring(text, 1, 400) AS cut FROM documents),
p AS (SELECT *, greatest(CASE WHEN strpos(reverse(cut), ' .') > 0 THEN length(cut) - strpos(reverse(cut), ' .') - 1 ELSE -1 END, CASE WHEN strpos(reverse(cut), ' !') > 0 THEN length(cut) - strpos(reverse(cut), ' !') - 1 ELSE -1 END,
 CASE WHEN strpos(reverse(cut), ' ?') > 0 THEN length(cut) - strpos(reverse(cut), ' ?') - 1 ELSE -1 END, CASE WHEN strpos(reverse(cut), chr(10)) > 0 THEN length(cut) - strpos(reverse(cut), chr(10)) ELSE -1 END) AS last FROM c)
SELECT doc_id, md5(CASE WHEN length(text) <= 400 THEN text WHEN last > 240 THEN """ + strip_sql("substring(cut, 1, last + 1)") + " ELSE " + strip_sql("cut") + " END) AS trimmed FROM p")
def trimmed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.trim_to_tokens(F.col("text"), F.lit(100))).alias("trimmed"))


def _tails_sql() -> str:
    c = "text"
    for p in fixed.TAILS:
        c = f"regexp_replace({c}, '{p}', '', 'gi')"
    return strip_sql(c)


@query(f"SELECT doc_id, md5({_tails_sql()}) AS stripped FROM documents")
def stripped_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.strip_boilerplate(F.col("text"))).alias("stripped"))


@query()
def chunked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic chunks of every document, beside its source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.col("source").alias("title"))
    return C.chunk_documents(docs)


VOWELS, PACK_TOKENS, PACK_THRESHOLD = "aeiou", 64, 0.93


def vowel_embedder(texts: list[str]) -> np.ndarray:
    """How often each vowel occurs: an embedder that SQL can express."""
    return np.array([[t.lower().count(v) for v in VOWELS] for t in texts], np.float64).reshape(len(texts), len(VOWELS))


def _unlike_sql(items: str, keys: str, k: int, t: float, last: int) -> str:
    """CTEs r (keys, i, taken): which items (keys, i from 1, t: lower-cased and trimmed) aren't like any of the last ones taken before. The first taken stand first in kept."""
    return f"""g AS MATERIALIZED (SELECT {keys}, i, {_grams_sql('t', k)} AS g FROM {items}),
    r AS (SELECT {keys}, i, TRUE AS taken, [g] AS kept FROM g WHERE i = 1
     UNION ALL SELECT {keys}, i, taken, CASE WHEN taken THEN list_append(kept, g)[greatest(1, len(kept) - {last - 2}):] ELSE kept END FROM
     (SELECT g.*, r.kept, len(list_filter(r.kept, lambda x: len(x) > 0 AND len(g.g) > 0 AND least(len(x), len(g.g)) >= {t} * greatest(len(x), len(g.g)) AND len(list_intersect(x, g.g)) >= {t} * (len(x) + len(g.g) - len(list_intersect(x, g.g))))) = 0 AS taken FROM r JOIN g USING ({keys}) WHERE g.i = r.i + 1))"""


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, unnest(s) AS s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, list_filter({SENTENCES}, lambda s: NOT {NOISY}) AS s FROM documents)),
{_unlike_sql(f"(SELECT doc_id, i, lower({strip_sql('s')}) AS t FROM s)", 'doc_id', 3, 0.85, 20)},
l AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j, [{', '.join(f"length(lower(s)) - length(replace(lower(s), '{v}', ''))" for v in VOWELS)}]::DOUBLE[] AS v FROM s JOIN (SELECT doc_id, i FROM r WHERE taken) USING (doc_id, i)),
n AS (SELECT *, list_dot_product(v, lag(v) OVER o) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(lag(v) OVER o, lag(v) OVER o)) + 1e-8) AS near, row_number() OVER (PARTITION BY doc_id, array_to_string({words_sql('lower(s)')}, ' ') ORDER BY j) AS again FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY j)),
a AS (SELECT doc_id, s, v, near, greatest(1, length(s) // 4) AS tok, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS k FROM n WHERE again = 1),
p AS (SELECT doc_id, k, 1::BIGINT AS first, tok AS size, tok AS prev, NULL::BIGINT AS from_k FROM a WHERE k = 1
 UNION ALL SELECT doc_id, k, CASE WHEN cut THEN k - 1 ELSE first END, CASE WHEN cut THEN prev + tok ELSE size + tok END, tok, CASE WHEN cut THEN first END FROM
 (SELECT a.doc_id, a.k, a.tok, p.first, p.size, p.prev, coalesce(a.near < {PACK_THRESHOLD}, FALSE) OR p.size + a.tok > {PACK_TOKENS} AS cut FROM p JOIN a ON a.doc_id = p.doc_id AND a.k = p.k + 1)),
f AS (SELECT doc_id, from_k AS x, k - 1 AS y FROM p WHERE from_k IS NOT NULL UNION ALL SELECT doc_id, max_by(first, k), max(k) FROM p GROUP BY doc_id),
c AS (SELECT f.doc_id, x, y, string_agg(s, ' ' ORDER BY k) AS content, count(*) AS sentences, list(v ORDER BY k) AS vs FROM f JOIN a ON a.doc_id = f.doc_id AND a.k BETWEEN x AND y GROUP BY f.doc_id, x, y HAVING length(string_agg(s, ' ' ORDER BY k)) >= 100),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y) - 1 AS number FROM c)
SELECT doc_id, CAST(number AS INT) AS chunk_index, CAST(greatest(1, length(content) // 4) AS INT) AS token_estimate, CAST(sentences AS INT) AS sentence_count, md5(content) AS content, source || ' [chunk ' || number || ']' AS title,
 CASE WHEN sentences = 1 THEN 1.0 ELSE round(list_avg(list_transform(range(1, sentences), lambda i: list_dot_product(vs[i], vs[i + 1]) / (sqrt(list_dot_product(vs[i], vs[i])) * sqrt(list_dot_product(vs[i + 1], vs[i + 1])) + 1e-8))), 4) END AS coherence_score FROM e JOIN documents USING (doc_id)""")
def packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunker with an embedder that SQL can express, and a smaller budget."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.col("source").alias("title"))
    rows = C.chunk_documents(docs, vowel_embedder, max_tokens=PACK_TOKENS, threshold=PACK_THRESHOLD)
    return rows.select("doc_id", "chunk_index", "token_estimate", "sentence_count", F.md5("content").alias("content"), "title", "coherence_score")


@query("""SELECT source AS domain, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def first_chunk_per_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.col("source").alias("domain")).agg(F.min_by(F.struct("doc_id", "n_chars"), "doc_id").alias("r")).select("domain", "r.*")


@query("SELECT source AS domain, count(*) AS n, round(avg((10 - doc_id % 10) / 10), 6) AS coherence FROM documents GROUP BY source")
def chunks_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("coherence_score"), 6).alias("coherence"))


# The tables' roles for context assembly: a query per source, all its documents ranked by id.
CTX = """x AS (SELECT source AS query_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, count(*) OVER (PARTITION BY source) AS n, doc_id, lang AS domain, (10 - doc_id % 10) / 10 AS coherence, n_chars FROM documents),
c AS (SELECT *, round(0.5 * (1 - (pos - 1) / n) + 0.3 * coherence + 0.2 * 0.5, 4) AS score FROM x)"""


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    by = Window.partitionBy("source")
    rows = d.select(F.col("source").alias("query_id"), F.row_number().over(by.orderBy("doc_id")).alias("pos"), F.count(F.lit(1)).over(by).alias("n"), "doc_id", F.col("lang").alias("domain"), ((10 - F.col("doc_id") % 10) / 10).alias("coherence"), "n_chars")
    score = F.round(0.5 * (1 - (F.col("pos") - 1) / F.col("n")) + 0.3 * F.col("coherence") + 0.2 * 0.5, 4)
    return rows.withColumn("score", score)


@query(f"WITH {CTX} SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, domain ORDER BY score DESC, pos) AS k FROM c) WHERE k <= 3")
def diversity_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import context as X

    return X.diversity_cap(_context(spark, sf_dir)).select("query_id", "doc_id", "score")


@query(f"WITH {CTX} SELECT query_id, doc_id, CAST(greatest(80, least(400, floor(score / sum(score) OVER (PARTITION BY query_id) * 3000))) AS INT) AS allocated_tokens FROM c")
def token_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import context as X

    return X.allocate(_context(spark, sf_dir)).select("query_id", "doc_id", "allocated_tokens")


@query(f"""WITH RECURSIVE {CTX}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS k, greatest(1, n_chars // 4) AS t FROM c),
r AS (SELECT query_id, k, doc_id, t <= 3000 AS taken, CASE WHEN t <= 3000 THEN t ELSE 0 END AS used FROM o WHERE k = 1
 UNION ALL SELECT o.query_id, o.k, o.doc_id, r.used + o.t <= 3000, r.used + CASE WHEN r.used + o.t <= 3000 THEN o.t ELSE 0 END FROM r JOIN o ON o.query_id = r.query_id AND o.k = r.k + 1)
SELECT query_id, doc_id FROM r WHERE taken""")
def greedy_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import context as X

    rows = _context(spark, sf_dir).withColumn("tokens", F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)))
    return X.greedy_cap(rows).select("query_id", "doc_id")


def _trim_sql(text: str, limit: str) -> str:
    """A sub-select: text cut to limit characters, after the last end of a sentence or line if that is beyond 60 %."""
    end = lambda m: f"CASE WHEN strpos(reverse(cut), '{m[::-1]}') > 0 THEN length(cut) - strpos(reverse(cut), '{m[::-1]}') - {len(m) - 1} ELSE -1 END"
    last = f"greatest({', '.join(end(m) for m in ('. ', '! ', '? '))}, CASE WHEN strpos(reverse(cut), chr(10)) > 0 THEN length(cut) - strpos(reverse(cut), chr(10)) ELSE -1 END)"
    return f"""(SELECT CASE WHEN length(x) <= m THEN x ELSE {strip_sql('CASE WHEN ends > m * 0.6 THEN substring(cut, 1, CAST(ends + 1 AS INT)) ELSE cut END')} END FROM (SELECT *, {last} AS ends FROM (SELECT x, m, substring(x, 1, m) AS cut FROM (SELECT {text} AS x, {limit} AS m))))"""


@query(f"""WITH RECURSIVE x AS (SELECT source AS query_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, count(*) OVER (PARTITION BY source) AS n, doc_id, text, lang || '.example' AS domain, (10 - doc_id % 10) / 10 AS coherence FROM documents),
y AS (SELECT *, round(0.5 * (1.0 - (pos - 1) / n) + 0.3 * coherence + 0.2 * 0.5, 4) AS score FROM x),
z AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS i FROM y WHERE score >= 0.25),
{_unlike_sql(f"(SELECT query_id, i, lower({strip_sql('text')}) AS t FROM z)", 'query_id', 4, 0.80, 10)},
u AS (SELECT z.* FROM z JOIN (SELECT query_id, i FROM r WHERE taken) USING (query_id, i)),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, domain ORDER BY score DESC, pos) AS k FROM u) WHERE k <= 3),
b AS (SELECT *, CAST(greatest(80, least(400, floor(score / sum(score) OVER (PARTITION BY query_id) * 3000))) AS INT) AS allocated FROM d WHERE place <= 10),
w AS (SELECT *, {_trim_sql(_tails_sql(), 'allocated * 4')} AS content FROM b),
v AS (SELECT *, greatest(1, length(content) // 4) AS tokens FROM w),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS j FROM v WHERE tokens >= 80),
t AS (SELECT query_id, j, doc_id, TRUE AS taken, tokens AS used FROM o WHERE j = 1
 UNION ALL SELECT o.query_id, o.j, o.doc_id, t.used + o.tokens <= 3000, t.used + CASE WHEN t.used + o.tokens <= 3000 THEN o.tokens ELSE 0 END FROM t JOIN o ON o.query_id = t.query_id AND o.j = t.j + 1)
SELECT o.query_id, CAST(o.pos AS INT) AS pos, CAST(o.place AS INT) AS place, o.score, CAST(o.allocated AS INT) AS allocated_tokens, CAST(o.tokens AS INT) AS tokens, md5(o.content) AS content FROM o JOIN t ON t.query_id = o.query_id AND t.doc_id = o.doc_id WHERE t.taken""")
def built_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole context builder, for a query per source over all its documents."""
    from ..operators import context as X

    d = table(spark, sf_dir, "documents")
    rows = d.withColumn("pos", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    chunks = rows.select(F.col("source").alias("query_id"), "pos", F.col("text").alias("content"), F.concat(F.lit("https://"), "lang", F.lit(".example/"), "doc_id").alias("source"), F.lit("").alias("title"), F.col("pos").alias("chunk_index"), ((10 - F.col("doc_id") % 10) / 10).alias("coherence_score"))
    return X.build_context(chunks).select("query_id", "pos", "place", "score", "allocated_tokens", "tokens", F.md5("content").alias("content"))
