"""Benchmark decontamination with a distributed positional inverted index.

Corpus-wide counts are taken for the terms of the test items. Each window of an item is
then looked up from its two rarest terms that occur: their postings (document, position) are stored,
moved back by the term's place in the item and intersected, exactly or within a few words. What
remains are alignments of items with a document, whose words are compared: word by word for
phrases, by the share of a window's words that stand near for proximity matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NON_WORD, UPPER, alnum_words, broadcast_if, materialize, row_key, table, text_or_empty

#: Terms and anchors of the test items are broadcast up to so many rows (some 100 MB); beyond that they are shuffled.
BROADCAST_ROWS = 1_000_000
#: A proximity match: words by which terms may be apart, and the share of a window's words that must stand near.
SLACK, NEAR = 3, 0.8


def _corpus(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row tells rows apart even where doc_id is null or repeated."""
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row"), text.alias("text"))


def _items(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """key (tells items apart, also without id), item_id, item (words), m, win."""
    words = items.select(F.col(item_col).alias("item_id"), alnum_words(text_or_empty(text_col)).alias("item")).filter("size(item) > 0")
    return words.dropDuplicates().withColumn("m", F.size("item")).withColumn("win", F.least(F.lit(window), F.col("m"))).withColumn("key", F.xxhash64("item_id", "item"))


def _anchors(items: DataFrame, counts: DataFrame) -> DataFrame:
    """Of every window the two rarest of the terms that occur at all: key, pos1, term1, pos2, term2, whole (all of the window's terms occur)."""
    terms = items.select("key", "item", "m", "win", F.posexplode("item").alias("pos", "term")).join(counts, "term", "left")
    ranked = terms.groupBy("key", "item", "m", "win").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("n", F.lit(0)).alias("n")))).alias("places"))
    windows = ranked.select("key", "item", F.explode(F.expr("transform(sequence(0, m - win), i -> array_sort(transform(slice(places, i + 1, win), x -> struct(x.n as n, x.pos as pos))))")).alias("w"))
    windows = windows.withColumn("known", F.filter("w", lambda x: x["n"] > 0)).filter("size(known) > 0")
    first, second = F.col("known")[0]["pos"], F.try_element_at("known", F.lit(2))["pos"]
    rare = windows.select("key", "item", first.alias("pos1"), second.alias("pos2"), (F.size("known") == F.size("w")).alias("whole"))
    rare = rare.select("key", "pos1", F.try_element_at("item", F.col("pos1") + 1).alias("term1"), "pos2", F.try_element_at("item", F.col("pos2") + 1).alias("term2"), "whole")
    return rare.groupBy("key", "pos1", "term1", "pos2", "term2").agg(F.max("whole").alias("whole"))


def _tokens(corpus: DataFrame) -> DataFrame:
    return corpus.select("doc_id", "row", F.posexplode(alnum_words(F.col("text"))).alias("pos", "term"))


def postings(corpus: DataFrame, terms: DataFrame) -> DataFrame:
    """Positional postings of the given terms (column term) on shared files: term, doc_id, row, pos."""
    return materialize(_tokens(corpus).join(broadcast_if(terms, BROADCAST_ROWS), "term"), "decon-postings")


def alignments(index: DataFrame, anchors: DataFrame, slack: int = SLACK) -> DataFrame:
    """doc_id, row, key, shift, exact: documents in which both terms of an anchor stand as in the item, within ``slack`` words.

    shift is the position of the item's first word in the document (it may be negative). exact ones,
    of windows whose terms all occur, are what a phrase needs; the others may be proximity matches. A hot term
    meets only the anchors that chose it as their rarest.
    """
    first = index.join(broadcast_if(anchors, BROADCAST_ROWS).withColumnRenamed("term1", "term"), "term").withColumn("shift", F.col("pos") - F.col("pos1"))
    alone = first.filter("pos2 is null and whole").select("doc_id", "row", "key", "shift", F.lit(True).alias("exact"))
    cell = lambda pos: F.floor(pos / (2 * slack + 1))  # noqa: E731  places within slack of one lie in two cells at most
    want = first.filter("pos2 is not null").select("doc_id", "row", "key", "shift", "whole", F.col("term2").alias("term"), (F.col("shift") + F.col("pos2")).alias("pos"))
    want = want.withColumn("cell", F.explode(F.array_distinct(F.array(cell(F.col("pos") - slack), cell(F.col("pos") + slack)))))
    same = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), *[F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("row", "term", "cell")], F.abs(F.col("a.pos") - F.col("b.pos")) <= slack]
    both = want.alias("a").join(index.withColumn("cell", cell(F.col("pos"))).alias("b"), same).select("a.doc_id", "a.row", "key", "shift", (F.col("whole") & (F.col("a.pos") == F.col("b.pos"))).alias("exact"))
    return both.unionByName(alone).groupBy("doc_id", "row", "key", "shift").agg(F.max("exact").alias("exact"))


def compared(corpus: DataFrame, items: DataFrame, found: DataFrame, slack: int = SLACK, near: float = NEAR) -> DataFrame:
    """doc_id, row, hits, near: per document its items with the places where windows of them stand word for word, and the items with proximity matches.

    An item's alignments with a document come together before they meet its words, so that the words are there once.
    """
    asked = found.groupBy("doc_id", "row", "key").agg(F.collect_list(F.when(F.col("exact"), F.col("shift"))).alias("exact"), F.collect_list("shift").alias("shifts"))
    asked = asked.join(broadcast_if(items, BROADCAST_ROWS // 10), "key").groupBy("doc_id", "row").agg(F.collect_list(F.struct("item_id", "item", "m", "win", "exact", "shifts")).alias("asked"))
    asked = materialize(asked, "decon-alignments")
    same = [F.col("c.doc_id").eqNullSafe(F.col("k.doc_id")), F.col("c.row") == F.col("k.row")]
    texts = corpus.alias("c").join(broadcast_if(asked.select("doc_id", "row"), BROADCAST_ROWS).alias("k"), same, "left_semi")  # no other text is moved
    rows = texts.alias("c").join(asked.alias("k"), same).select("c.doc_id", "c.row", "k.asked", alnum_words(F.col("c.text")).alias("words"))
    rows = rows.dropDuplicates(["doc_id", "row"])
    place = """filter(sequence(greatest(0, -s), greatest(least(a.m - a.win, size(words) - a.win - s), greatest(0, -s))),
        i -> i <= a.m - a.win and i + s + a.win <= size(words) and slice(a.item, i + 1, a.win) = slice(words, i + s + 1, a.win))"""
    hits = F.expr(f"filter(transform(asked, a -> struct(a.item_id, a.win, flatten(transform(a.exact, s -> transform({place}, i -> i + s))) as places)), h -> size(h.places) > 0)")
    close = f"""exists(sequence(0, a.m - a.win), i -> size(array_intersect(slice(a.item, i + 1, a.win), slice(words, greatest(0, i + s - {slack}) + 1, a.win + 2 * {slack}))) >= {near} * size(array_distinct(slice(a.item, i + 1, a.win))))"""
    nearby = F.expr(f"array_distinct(transform(filter(asked, a -> exists(a.shifts, s -> {close})), a -> cast(a.item_id as string)))")
    return rows.select("doc_id", "row", hits.alias("hits"), nearby.alias("near")).filter("size(hits) > 0 or size(near) > 0")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slack: int = SLACK) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, near_items, row (common.row_key()).

    A window is ``window`` consecutive words of an item; an item of fewer words is one window.
    Words of the document inside any occurrence are hit. near_items are items without such an occurrence
    of which a window's two rarest terms stand within ``slack`` words of their distance and a window has
    four fifths of its words near its place. Null texts have no words; items without words match nothing;
    of repeated items each id counts once; items without id count as one, without a name in the list. Repeated
    documents are judged row by row, and no column but the named ones is looked at.
    """
    corpus, known = _corpus(docs, id_col, text_col), materialize(_items(items, item_col, item_text_col, window), "decon-items")
    vocabulary = materialize(known.select(F.explode("item").alias("term")).distinct(), "decon-terms")
    counts = materialize(_tokens(corpus).join(broadcast_if(vocabulary, BROADCAST_ROWS), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")), "decon-counts")
    anchors = materialize(_anchors(known, counts), "decon-anchors")
    terms = materialize(anchors.select("term1").union(anchors.select("term2")).toDF("term").filter("term is not null").distinct(), "decon-rare")
    found = compared(corpus, known, alignments(postings(corpus, terms), anchors, slack), slack)
    ids, covered = F.transform("hits", lambda h: h["item_id"].cast("string")), F.expr("flatten(transform(hits, h -> flatten(transform(h.places, p -> sequence(p, p + h.win - 1)))))")
    names = F.array_sort(F.filter(F.array_distinct(ids), lambda x: x.isNotNull()))
    found = materialize(found.select("doc_id", "row", F.size(F.array_distinct(covered)).alias("n_hit"), F.size(F.array_distinct(ids)).alias("n_items"), names.alias("items"), F.array_sort(F.array_except("near", ids)).alias("near")), "decon-hits")
    all_docs = corpus.select("doc_id", "row", F.size(alnum_words(F.col("text"))).alias("n_words"))
    same = [F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")), F.col("d.row") == F.col("h.row")]
    listed, near = (F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",") for c in ("items", "near"))
    return all_docs.alias("d").join(found.alias("h"), same, "left").select(
        "d.doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        listed.alias("items"),
        near.alias("near_items"),
        "d.row",
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "row")


def _sql_words(column: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(coalesce({column}, ''), '{UPPER}', '{UPPER.lower()}'), '{NON_WORD}'), lambda x: x <> '')"


SQL = f"""
WITH d AS (SELECT doc_id, {_sql_words('text')} AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {_sql_words('text')} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS p FROM i)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT d.*, ks.k, unnest(range(1, CAST(greatest(len(w) - k + 2, 1) AS BIGINT))) AS p FROM d, ks)),
hit AS (SELECT dw.doc_id, dw.p, dw.k, iw.item_id FROM dw JOIN iw USING (k, g)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, p, k FROM hit)) GROUP BY doc_id),
tc AS (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM d) GROUP BY term),
ip AS (SELECT DISTINCT item_id, w, k, p FROM (SELECT *, unnest(range(0, CAST(len(w) - k + 1 AS BIGINT))) AS p FROM i)),
ir AS (SELECT item_id, w, k, p, q, tc.n, row_number() OVER (PARTITION BY item_id, w, p ORDER BY tc.n, q) AS o FROM (SELECT *, unnest(range(p, p + k)) AS q FROM ip) x JOIN tc ON tc.term = x.w[x.q + 1]),
an AS (SELECT DISTINCT a.item_id, a.w, a.k, a.q AS q1, b.q AS q2 FROM ir a JOIN ir b ON a.item_id IS NOT DISTINCT FROM b.item_id AND a.w = b.w AND a.p = b.p AND a.o = 1 AND b.o = 2),
rt AS (SELECT DISTINCT unnest([w[q1 + 1], w[q2 + 1]]) AS term FROM an),
po AS (SELECT doc_id, w, unnest(range(0, len(w))) AS x FROM d),
ps AS (SELECT doc_id, w[x + 1] AS term, x FROM po WHERE w[x + 1] IN (SELECT term FROM rt)),
al AS (SELECT DISTINCT f.doc_id, an.item_id, an.w, an.k, f.x - q1 AS s FROM an JOIN ps f ON f.term = an.w[q1 + 1] JOIN ps g ON g.doc_id = f.doc_id AND g.term = an.w[q2 + 1] AND abs(g.x - f.x - q2 + q1) <= {SLACK}),
nr AS (SELECT DISTINCT al.doc_id, CAST(item_id AS VARCHAR) AS s FROM (SELECT *, unnest(range(0, CAST(len(w) - k + 1 AS BIGINT))) AS p FROM al) al JOIN d USING (doc_id)
  WHERE len(list_intersect(al.w[p + 1:p + k], d.w[greatest(0, p + al.s - {SLACK}) + 1:greatest(0, p + al.s - {SLACK}) + k + {2 * SLACK}])) >= {NEAR} * len(list_distinct(al.w[p + 1:p + k]))),
nx AS (SELECT doc_id, string_agg(s, ',' ORDER BY s) AS near_items FROM (SELECT * FROM nr EXCEPT SELECT doc_id, CAST(item_id AS VARCHAR) FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(near_items, '') AS near_items
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nx USING (doc_id)
"""

QUERIES = {"op6_decontaminate": op6_decontaminate}
ORACLES = {"op6_decontaminate": SQL}
