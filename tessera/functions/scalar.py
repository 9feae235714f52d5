"""Scalar functions as native column expressions.

They stay inside whole-stage code generation where Spark's own functions do. Clocks and
randomness are parameters.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

TRIM = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """c without white space of any script at its ends."""
    return F.regexp_replace(c, TRIM, "")


def bound(value: Column, use) -> Column:
    """use(value), with value computed once however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def or_default(c: Column, default: Column | str) -> Column:
    """default where c is null or empty."""
    return F.coalesce(F.when(c != "", c), default if isinstance(default, Column) else F.lit(default))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def domain(url: Column) -> Column:
    """Network location without any www., '' where there is none. Port and user stay."""
    return F.coalesce(F.replace(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("www."), F.lit("")), F.lit(""))


def split_sentences(text: Column) -> Column:
    """Sentences: split after . ! ? before a capital, and at blank lines; trimmed, none empty."""
    text = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r" {2,}", " ")
    parts = F.flatten(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.split(s, r"\n\n")))
    return F.filter(F.transform(parts, lambda s: strip(s)), lambda s: s != "")


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def is_noise(sentence: Column) -> Column:
    s = strip(sentence)
    return (F.length(s) < 15) | s.rlike("(?i)^(?:" + "|".join(fixed.SENTENCE_NOISE) + ")")


def grams(text: Column, k: int) -> Column:
    """Distinct runs of k characters of the lower-cased, trimmed text. Linear in its length."""
    def runs(c: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(c) - (k - 1)), lambda i: F.array_join(F.slice(c, i, F.lit(k)), ""))
        return F.when(F.size(c) >= k, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    return bound(F.regexp_extract_all(F.lower(strip(text)), F.lit("(?s)."), F.lit(0)), runs)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def short_word_share(text: Column) -> Column:
    return bound(words(text), lambda w: F.when(F.size(w) > 0, F.size(F.filter(w, lambda x: F.length(x) <= 3)) / F.size(w)).otherwise(1.0))


def is_useful(text: Column, min_chars: int = 200) -> Column:
    return (F.length(text) >= min_chars) & (short_word_share(text) <= 0.6)


def usefulness(text: Column) -> tuple[Column, Column]:
    """(score, whether a page-noise pattern occurs). Noisy text scores 0.1."""
    noisy = bound(F.lower(text), lambda t: reduce(or_, [t.contains(p) for p in fixed.PAGE_NOISE]))
    n = F.length(text)
    length = F.when(n < 150, n / 150 * 0.5).otherwise(F.least(F.lit(1.0), 0.5 + (n - 150) / 1000))
    quality = F.greatest(F.lit(0.0), 1 - short_word_share(text) / 0.6)
    sentences = F.regexp_count(text, F.lit(r"(?U)[^.!?\s][^.!?]{9,}[^.!?\s]"))  # runs between ends of more than ten characters, white space at either side aside
    density = F.least(F.lit(0.2), sentences * 0.02) / 0.2
    score = F.round(clamp(0.45 * length + 0.35 * quality + 0.20 * density), 4)
    return F.when(noisy, 0.1).otherwise(score), noisy


def composite(coherence: Column, useful: Column) -> Column:
    return F.round(0.6 * coherence + 0.4 * useful, 4)


def trim_to_tokens(text: Column, tokens: Column) -> Column:
    """At most 4 characters a token, cut after the last sentence end or line end if that is beyond 60 %."""
    limit = (tokens * 4).cast("int")
    def end(cut: Column, back: Column, mark: str) -> Column:
        return bound(F.locate(mark[::-1], back), lambda at: F.when(at > 0, F.length(cut) - at - (len(mark) - 1)).otherwise(-1))

    def at_end(cut: Column) -> Column:
        last = bound(F.reverse(cut), lambda back: F.greatest(*[end(cut, back, m) for m in (". ", "! ", "? ", "\n")]))
        return bound(last, lambda at: F.when(at > limit * 0.6, F.substring(cut, F.lit(1), at + 1)).otherwise(cut))

    return F.when(F.length(text) <= limit, text).otherwise(strip(bound(F.substring(text, F.lit(1), limit), at_end)))


def strip_boilerplate(text: Column) -> Column:
    for pattern in fixed.TAILS:
        text = F.regexp_replace(text, f"(?id){pattern}", "")
    return strip(text)


def fingerprint(text: Column) -> Column:
    return F.substring(F.md5(F.substring(text, 1, 200)), 1, 12)


def recency(timestamp: Column, as_of: Column, decay_days: int = 365, floor: float = 0.1) -> Column:
    """exp(-age / decay), at least floor; 0.5 where there is no date."""
    age = F.datediff(as_of, F.try_to_date(F.substring(timestamp, 1, 10), "yyyy-MM-dd"))
    return F.when(age.isNull(), 0.5).when(age <= 0, 1.0).otherwise(F.greatest(F.lit(floor), F.exp(-age / decay_days)))


def blended(coherence: Column, timestamp: Column, as_of: Column, weight: Column | float = 0.4, decay_days: int = 365) -> Column:
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return (1 - w) * clamp(coherence) + w * recency(timestamp, as_of, decay_days)


def topic_weight(topic: Column, default: float = 0.4) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in fixed.RECENCY_WEIGHT.items() for x in kv])[topic], F.lit(default))


def badge(topic: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in fixed.BADGES.items() for x in kv])[topic], F.lit("◆"))


def terms(query: Column) -> Column:
    """Words of four letters or more that aren't stop words, then pairs of neighbours among them; each once."""
    one = F.filter(F.transform(words(query), F.lower), lambda w: w.rlike(r"^\p{L}{4,}$") & ~w.isin(fixed.STOP_WORDS))
    two = F.zip_with(one, F.slice(one, F.lit(2), F.greatest(F.size(one) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(one, F.filter(two, lambda x: x.isNotNull())))


def term_weight(confidence: Column, observations: Column) -> Column:
    return F.round(confidence * F.log10(observations + 1) * F.least(F.lit(1.0), observations / 10), 4)


def days_between(now: Column, then: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(then)) / 86400e6


def decay_term(confidence: Column, total: Column, days: Column) -> tuple[Column, Column]:
    """Average and sum of a term after so many days without observation."""
    factor = F.pow(F.lit(0.98), days)
    fresh = days.isNull() | (days <= 0)
    return F.when(fresh, confidence).otherwise(F.round(F.greatest(F.lit(0.2), confidence * factor), 4)), F.when(fresh, total).otherwise(F.round(F.greatest(F.lit(0.0), total * factor), 4))


def decay_reputation(value: Column, days: Column) -> Column:
    return F.when(days.isNull(), value).otherwise(F.greatest(F.lit(0.1), value * F.pow(F.lit(0.98), days)))


def scrape_score(quality: Column, hit: Column, irrelevance: Column, failure: Column, latency: Column) -> Column:
    q, h, i, f = map(clamp, (quality, hit, irrelevance, failure))
    return clamp(0.35 * q + 0.25 * h + 0.15 * (1 - i) + 0.15 * (1 - f) + 0.10 / (1 + F.greatest(F.lit(0.0), latency)))


def update_confidence(old: Column, score: Column) -> Column:
    return clamp(0.8 * old + 0.2 * score, 0.1, 1.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-8)


def is_garbage(text: Column) -> Column:
    controls = F.length(F.regexp_replace(text, r"[^\x{80}-\x{9f}]", ""))
    return (F.length(text) == 0) | (controls / F.greatest(F.length(text), F.lit(1)) > 0.05)


def is_nav_heavy(text: Column) -> Column:
    lines = F.array_remove(F.transform(F.split(text, "\n"), strip), "")
    return bound(lines, lambda own: F.when(F.size(own) > 0, F.size(F.filter(own, lambda x: F.length(x) < 30)) / F.size(own) > 0.7).otherwise(False))


def detect_format(text: Column) -> Column:
    pipes = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return F.when(is_garbage(text), "garbage").when(pipes > 4, "table").when(is_nav_heavy(text), "nav").otherwise("paragraph")


def inject_context(query: Column, context: Column) -> Column:
    """The query and the first line of context over 40 characters, cut to 80; 180 in all."""
    line = F.try_element_at(F.filter(F.transform(F.split(context, "\n"), strip), lambda x: F.length(x) > 40), F.lit(1))
    return F.when(line.isNull(), query).otherwise(strip(F.substring(F.concat(query, F.lit(" "), F.substring(line, 1, 80)), 1, 180)))


def display_score(score: Column) -> Column:
    return F.when(score > 1, F.greatest(F.lit(0.0), 1 - score)).otherwise(score)
