"""Topics of queries, and variants of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalar as S


def keyword_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.keywords(), "topic string, topic_rank int, keyword string, times int")


#: Keywords and terms that are matched in one pass, at most; beyond it they are joined.
MOST_KEYWORDS = 200_000


def substring_hits(base: DataFrame, words: DataFrame, most: int = MOST_KEYWORDS) -> DataFrame:
    """query_id, n: which of words (n, word) stand anywhere in q of base (query_id, q). All words are looked for in one pass over each query."""
    known = [(r["n"], r["word"]) for r in words.limit(most + 1).collect()]
    if len(known) > most:
        return base.join(words, F.col("q").contains(F.col("word"))).select("query_id", "n")
    shared = base.sparkSession.sparkContext.broadcast(known)

    def run(parts):
        find = _finder(shared.value)
        for part in parts:
            found = [(i, n) for i, q in zip(part["query_id"], part["q"], strict=True) for n in (find(q) if isinstance(q, str) else ())]
            yield pd.DataFrame(found, columns=["query_id", "n"])

    return base.mapInPandas(run, f"query_id {dict(base.dtypes)['query_id']}, n long")


def _finder(known: list[tuple[int, str]]):
    """A function that gives the numbers of the words in a text."""
    everywhere = [n for n, w in known if not w]
    try:
        import ahocorasick
    except ImportError:
        return lambda text: [*everywhere, *(n for n, w in known if w and w in text)]
    numbers: dict[str, list[int]] = {}
    for n, w in known:
        if w:
            numbers.setdefault(w, []).append(n)
    if not numbers:
        return lambda text: everywhere
    automaton = ahocorasick.Automaton()
    for w, own in numbers.items():
        automaton.add_word(w, own)
    automaton.make_automaton()
    return lambda text: [*everywhere, *{n for _, own in automaton.iter(text) for n in own}]


def topic_scores(queries: DataFrame, keywords: DataFrame | None = None, lexicon: DataFrame | None = None, query_col: str = "query", id_col: str = "query_id") -> DataFrame:
    """id, topic, topic_rank, score: share of the keyword hits. Keywords match as substrings of the lower-cased query.

    lexicon: topic, term, weight of learned terms, counted at half. Keywords and terms are
    dimension tables.
    """
    spark = queries.sparkSession
    base = queries.select(F.col(id_col).alias("query_id"), F.lower(S.strip(F.col(query_col))).alias("q"))
    keywords = keywords if keywords is not None else keyword_table(spark)
    weight = F.col("times") * (1 + 0.2 * (F.length("keyword") - F.length(F.replace(F.col("keyword"), F.lit(" "), F.lit("")))))
    words = keywords.select("topic", "topic_rank", F.col("keyword").alias("word"), weight.cast("double").alias("w"))
    if lexicon is not None:
        ranks = keywords.groupBy("topic").agg(F.min("topic_rank").alias("topic_rank"))
        words = words.unionByName(lexicon.join(ranks, "topic", "left").select("topic", F.coalesce("topic_rank", F.lit(99)).alias("topic_rank"), F.col("term").alias("word"), (F.col("weight") * 0.5).alias("w")))
    words = words.withColumn("n", F.xxhash64("topic", "topic_rank", "word", "w")).groupBy("n").agg(F.first("topic").alias("topic"), F.first("topic_rank").alias("topic_rank"), F.first("word").alias("word"), F.sum("w").alias("w"))
    hits = substring_hits(base, words.select("n", "word")).join(words.drop("word"), "n")
    raw = hits.groupBy("query_id", "topic", "topic_rank").agg(F.sum("w").alias("w"))
    return raw.select("query_id", "topic", "topic_rank", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("query_id")), 4).alias("score"))


def predict(queries: DataFrame, keywords: DataFrame | None = None, lexicon: DataFrame | None = None, query_col: str = "query", id_col: str = "query_id", top_k: int = 2, gap: float = 0.15) -> DataFrame:
    """id, topic, confidence, secondary, secondary_confidence, ambiguous, top_k. Without a hit the topic is general."""
    scores = topic_scores(queries, keywords, lexicon, query_col, id_col)
    listed = scores.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "topic_rank", "topic", "score"))).alias("s"))
    first, second = F.try_element_at("s", F.lit(1)), F.try_element_at("s", F.lit(2))
    found = listed.select(
        "query_id", first["topic"].alias("topic"), first["score"].alias("confidence"), second["topic"].alias("secondary"), F.coalesce(second["score"], F.lit(0.0)).alias("secondary_confidence"),
        F.coalesce(first["score"] - second["score"] < gap, F.lit(False)).alias("ambiguous"),
        F.transform(F.slice("s", 1, max(top_k, 2)), lambda x: F.struct(x["topic"].alias("topic"), x["score"].alias("score"))).alias("top_k"),
    )
    general = F.array(F.struct(F.lit("general").alias("topic"), F.lit(1.0).alias("score")))
    return queries.select(F.col(id_col).alias("query_id")).join(found, "query_id", "left").select(
        "query_id", F.coalesce("topic", F.lit("general")).alias("topic"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "secondary",
        F.coalesce("secondary_confidence", F.lit(0.0)).alias("secondary_confidence"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), F.coalesce("top_k", general).alias("top_k"),
    )


def variants(queries: DataFrame, year: int = 2026, max_variants: int = 5, history: DataFrame | None = None, expansions: DataFrame | None = None, site_hints: bool = True) -> DataFrame:
    """query_id, strategy, text, weight, rank of each query's variants, best first.

    queries: query_id, query, topic. expansions: query_id, text (the lexicon's variant). history:
    query_id, asked: what was asked before is left out. Strategies stand in their order before
    duplicates go and the cap applies; then weight decides.
    """
    q, topic = S.strip(F.col("query")), F.col("topic")
    base = queries.filter(S.strip(F.col("query")) != "")
    if expansions is not None:
        base = base.join(expansions.select("query_id", F.col("text").alias("expansion")), "query_id", "left")
    else:
        base = base.withColumn("expansion", F.lit(None).cast("string"))
    dated = F.when(~q.contains(str(year)) & ~q.contains(str(year - 1)), F.concat(q, F.lit(f" {year}")))
    rephrased = F.coalesce(*[F.when(F.lower(q).contains(a), F.regexp_replace(q, f"(?isu)^(.*?){a}", f"$1{b}")) for a, b in fixed.REPHRASE])
    rephrased = F.when(F.lower(rephrased) != F.lower(q), rephrased)
    hints = F.create_map(*[x for t, h in fixed.SITE_HINTS.items() for x in (F.lit(t), F.array(*map(F.lit, h)))])
    hint = F.try_element_at(F.filter(F.coalesce(hints[topic], F.array().cast("array<string>")), lambda h: ~F.lower(q).contains(F.replace(h, F.lit("site:"), F.lit("")))), F.lit(1))
    option = lambda n, name, text, w: F.struct(F.lit(n).alias("step"), F.lit(name).alias("strategy"), text.alias("text"), (w if hasattr(w, "alias") else F.lit(w)).alias("weight"))
    options = [
        option(0, "original", q, 1.0),
        option(1, "year", dated, F.when(topic.isin(fixed.YEAR_TOPICS), 0.85).otherwise(0.65)),
        option(2, "rephrase", rephrased, 0.75),
        option(3, "lexicon", F.col("expansion"), 0.90),
    ] + ([option(4, "site", F.concat(q, F.lit(" "), hint), 0.70)] if site_hints else [])
    rows = base.select("query_id", F.explode(F.array(*options)).alias("v")).select("query_id", "v.*").filter("text is not null").filter(F.length(S.strip(F.col("text"))).between(8, 180))
    rows = rows.withColumn("key", F.lower(S.strip(F.col("text"))))
    if history is not None:
        asked = history.select("query_id", F.lower(S.strip(F.col("asked"))).alias("key")).distinct()
        rows = rows.join(asked, ["query_id", "key"], "left_anti")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("step"))).filter("n = 1")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("step"))).filter(F.col("n") <= min(5, max_variants))
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), "step")
    return rows.withColumn("rank", F.row_number().over(order)).select("query_id", "strategy", "text", "weight", "rank")
