"""Documents, sentences and their quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S


def make_documents(rows: DataFrame, content: Column, source: Column, title: Column | None = None, timestamp: Column | None = None, now: Column | None = None) -> DataFrame:
    """content, source, title, timestamp, author, image; the title defaults to the last part of the source, the timestamp to now."""
    none = F.lit("")
    base = F.element_at(F.split(source, "/"), -1)
    stamp = S.or_default(timestamp if timestamp is not None else none, now if now is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    return rows.select(content.alias("content"), source.alias("source"), S.or_default(title if title is not None else none, base).alias("title"), stamp.alias("timestamp"), none.alias("author"), none.alias("image"))


def first_by_key(rows: DataFrame, key: Column, *order: str | Column) -> DataFrame:
    """The first row of each key. The hot key's rows are combined before the shuffle."""
    names = rows.columns
    # min_by over an aggregate keeps one row a key and task, where a window would gather them all
    best = rows.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*names), F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])).alias("_r"))
    return best.select("_r.*")


def dedup_documents(docs: DataFrame, *order: str, content: str = "content") -> DataFrame:
    """The first of the documents that share their first 500 characters."""
    return first_by_key(docs, F.md5(F.substring(content, 1, 500)), *order)


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_noise: bool = False) -> DataFrame:
    """id, pos (from 0), sentence. A narrow map."""
    rows = docs.select(F.col(id_col), F.posexplode(S.split_sentences(F.col(text_col))).alias("pos", "sentence"))
    return rows.filter(~S.is_noise(F.col("sentence"))) if drop_noise else rows


def distinct_sentences(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of the sentences of a document that are alike but for case and white space, the first."""
    key = F.regexp_replace(F.lower(S.strip(F.col("sentence"))), r"(?U)\s+", " ")
    w = Window.partitionBy(id_col, "_key").orderBy("pos")
    return rows.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_key", "_n")


def evaluate_chunks(chunks: DataFrame) -> DataFrame:
    """Adds usefulness, noisy, composite, word_count, passed to chunks (content, coherence_score, ...)."""
    score, noisy = S.usefulness(F.col("content"))
    rows = chunks.withColumn("noisy", noisy).withColumn("usefulness", score)
    rows = rows.withColumn("composite", S.composite(F.col("coherence_score"), F.col("usefulness"))).withColumn("word_count", F.size(S.words(F.col("content"))))
    passed = (F.col("coherence_score") >= 0.3) & (F.col("usefulness") >= 0.3) & (F.length("content") >= 150) & ~F.col("noisy")
    return rows.withColumn("passed", passed)


def domain_quality(evaluated: DataFrame, *keys: str) -> DataFrame:
    """Counts, rates and means per domain (or the given keys)."""
    keys = keys or ("domain",)
    mean = lambda c: F.round(F.avg(c), 4).alias(f"avg_{c}")
    rows = evaluated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col("passed").cast("long")).alias("passed"), F.round(F.avg(F.col("noisy").cast("double")), 4).alias("noise_rate"), mean("coherence_score"), mean("usefulness"), mean("composite")
    )
    hit = F.round(F.col("passed") / F.col("total"), 4)
    return rows.withColumn("hit_rate", hit).withColumn("irrelevance", F.round(1 - F.col("hit_rate"), 4)).withColumn("useful_source", (F.col("passed") >= 1) & (F.col("avg_composite") >= 0.3))


def session_quality(domains: DataFrame, *keys: str) -> DataFrame:
    """Roll-up of domain_quality() rows, and whether the gate lets the session in: a pass rate of 0.25 and three passed chunks."""
    agg = [F.count(F.lit(1)).alias("domains"), F.sum(F.col("useful_source").cast("long")).alias("useful_domains"), F.sum("total").alias("total"), F.sum("passed").alias("passed")]
    rows = (domains.groupBy(*keys) if keys else domains).agg(*agg)
    return rows.withColumn("pass_rate", F.round(F.coalesce(F.try_divide("passed", "total"), F.lit(0.0)), 4)).withColumn("accepted", (F.col("pass_rate") >= 0.25) & (F.col("passed") >= 3))


def gate(chunks: DataFrame, sessions: DataFrame, key: str = "session") -> DataFrame:
    """Chunks of the sessions that the gate lets in."""
    return chunks.join(sessions.filter("accepted").select(key), key, "left_semi")


def near_duplicate_pairs(left: DataFrame, right: DataFrame, k: int, threshold: float, left_id: str, right_id: str, text: str = "text") -> DataFrame:
    """left_id, right_id, similarity: pairs whose sets of k-character runs are similar.

    A pair of similarity t shares a run among the first n - ceil(t n) + 1 of each set in any common
    order, here that of rarity in the right side (then by hash), and its sizes differ by no more than a factor t. So
    pairs meet on rare runs, and only those of like size. The right side is the smaller one.
    """
    def side(df, id_col, out):
        return df.select(F.col(id_col).alias(out), S.grams(F.col(text), k).alias("g")).withColumn("size", F.size("g")).filter("size > 0")

    keep = lambda n: n - F.ceil(n * threshold).cast("int") + 1
    b = side(right, right_id, "right_id")
    rarity = b.select(F.explode("g").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    # runs that the right side doesn't have are the rarest of all: they use up the left prefix without meeting anything
    placed = lambda rows, own: rows.withColumn("i", F.row_number().over(Window.partitionBy(own).orderBy("n", "h"))).filter(F.col("i") <= keep(F.col("size")))
    opened = lambda rows, own: rows.select(own, "size", F.explode("g").alias("x")).join(rarity, "x", "left").select(own, "size", "x", F.coalesce("n", F.lit(0)).alias("n"), F.xxhash64("x").alias("h"))
    bounds = b.agg(F.min("size").alias("low"), F.max("size").alias("high"))
    a = side(left, left_id, "left_id").join(F.broadcast(bounds), (F.col("size") >= F.col("low") * threshold) & (F.col("size") * threshold <= F.col("high"))).drop("low", "high")
    pa, pb = placed(opened(a, "left_id"), "left_id").filter("n > 0").select("left_id", F.col("size").alias("size_a"), "x"), placed(opened(b, "right_id"), "right_id").select("right_id", F.col("size").alias("size_b"), "x")
    like = (F.col("size_a") >= threshold * F.col("size_b")) & (F.col("size_b") >= threshold * F.col("size_a"))
    met = pa.join(pb, "x").filter(like).select("left_id", "right_id").distinct()
    pairs = met.join(a.select("left_id", F.col("g").alias("ga")), "left_id").join(b.select("right_id", F.col("g").alias("gb")), "right_id")
    return pairs.select("left_id", "right_id", S.jaccard(F.col("ga"), F.col("gb")).alias("similarity")).filter(F.col("similarity") >= threshold)


def conflicts(docs: DataFrame, session: str = "session", source: str = "source", timestamp: str = "timestamp", content: str = "content", pos: str = "pos") -> DataFrame:
    """Pairs of a session's documents whose months differ (documents without a date never conflict).

    The result is every such pair, as its consumers need; the join is on the session and so
    its cost is that of the result.
    """
    side = lambda s: F.struct(F.col(f"{s}.{source}").alias("url"), F.col(f"{s}.{timestamp}").alias("timestamp"), F.substring(f"{s}.{content}", 1, 300).alias("content_preview"))
    dated = docs.filter(F.length(F.substring(timestamp, 1, 7)) > 0).withColumn("month", F.substring(timestamp, 1, 7))
    a, b = dated.alias("a"), dated.alias("b")
    on = (F.col(f"a.{session}") == F.col(f"b.{session}")) & (F.col(f"a.{pos}") < F.col(f"b.{pos}")) & (F.col("a.month") != F.col("b.month"))
    newest = F.when(F.col(f"a.{timestamp}") >= F.col(f"b.{timestamp}"), F.col(f"a.{source}")).otherwise(F.col(f"b.{source}"))
    return a.join(b, on).select(F.col(f"a.{session}").alias(session), side("a").alias("source_a"), side("b").alias("source_b"), F.lit("timestamp_divergence").alias("conflict_type"), newest.alias("newest_source"))


def injectable(chunks: DataFrame) -> DataFrame:
    """Chunks good enough to be put into another query."""
    from ..functions import fixed

    lower = F.lower(F.col("content"))
    keep = F.length(S.strip(F.col("content"))) > 200
    for word in fixed.INJECTION_JUNK:
        keep = keep & ~lower.contains(word)
    return chunks.filter(keep)


def with_domain_quality(chunks: DataFrame, domains: DataFrame) -> DataFrame:
    """chunks with the signals of their domain (of domain_quality()); null where a domain has none."""
    return chunks.join(domains.select("domain", "hit_rate", "irrelevance", "useful_source"), "domain", "left")


def readable(chunks: DataFrame, *order: str, least: float = 0.25, key: str = "doc_id") -> DataFrame:
    """Chunks worth reading: coherent enough, neither garbage nor navigation, and of those of a document that are alike but for white space the first."""
    form = S.detect_format(S.strip(F.col("content")))
    rows = chunks.filter(F.coalesce("coherence_score", F.lit(0.0)) >= least).withColumn("format", form).filter(~F.col("format").isin("garbage", "nav"))
    same = F.struct(F.col(key), F.when(F.col("format") == "table", F.col("content")).otherwise(F.array_join(S.words(F.col("content")), " ")))
    return first_by_key(rows, same, *order)
