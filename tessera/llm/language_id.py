"""Language identification with a linear-chain conditional random field.

Each line is a chain of words, each word has a label (a language). A word's features are its
affixes, its character n-grams and itself (the lexicon), hashed; neighbouring labels share learned
transition weights, so that runs in one language are preferred over single switches. Forward-backward gives
every word's label probabilities. Neighbouring words of one label are a span; a document's score for a
language is the share of its letters, by these probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if, materialize, table
from .shingles import mix, tidy

#: Texts of each language that a model is fitted on, and words of all of them in equal shares, at most. Neither limits what is labelled.
FIT_DOCUMENTS, FIT_WORDS = 300, 250_000
FEATURE_BITS = 17
#: Lines that run through forward-backward at once hold so many words (with padding).
BATCH_WORDS = 60_000
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features, word of each feature): hashed, of lower-cased words, none of them empty.

    Prefixes and suffixes up to three letters, two- and three-grams with the word's ends, and the
    word itself as the lexicon entry.
    """
    n = np.fromiter(map(len, words), np.int64, len(words))
    text = "^" + "$^".join(words) + "$"
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    first = np.concatenate(([0], np.cumsum(n + 2)[:-1]))  # of each word, with its two marks
    who = np.repeat(np.arange(len(words)), n + 2)
    place = np.arange(len(code)) - first[who]
    step = np.uint64(0x9E3779B97F4A7C15)
    two = code[:-1] * step + code[1:]
    three = two[:-1] * step + code[2:]
    powers = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(int(n.max(initial=1)) + 1, step))))
    whole = np.add.reduceat(code * powers[place], first) if len(words) else np.empty(0, np.uint64)
    inside2, inside3 = np.flatnonzero(place[:-1] <= n[who[:-1]]), np.flatnonzero(place[:-2] < n[who[:-2]])
    found, owner = [whole ^ np.uint64(0x5851), two[inside2], three[inside3] ^ np.uint64(0x77)], [np.arange(len(words)), who[inside2], who[inside3]]
    for k in (1, 2, 3):
        heads = code[first + 1] + sum((code[np.minimum(first + 1 + i, first + n)] * powers[i] for i in range(1, k)), np.uint64(0))
        tails = sum((code[np.maximum(first + n - i, first + 1)] * powers[i] for i in range(k)), np.uint64(0))
        found += [heads * step + np.uint64(101 * k), tails * step + np.uint64(103 * k + 7)]
        owner += [np.arange(len(words))] * 2
    hashes = mix(np.concatenate(found))
    return (hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64), np.concatenate(owner)


def summed(weights: np.ndarray, words: list[str]) -> np.ndarray:
    """Per word the sum of its features' weights, by label."""
    feature, owner = features(words)
    return np.stack([np.bincount(owner, weights[feature, j], minlength=len(words)) for j in range(weights.shape[1])], axis=1)


def lines_of(text: str) -> list[list[str]]:
    """Lower-cased words of every line that has any."""
    return [x for x in (WORD.findall(line) for line in text.lower().split("\n")) if x]


def forward_backward(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(label probabilities, summed pair probabilities, summed log of the normaliser) of chains emit[chain, place, label], padded, longest first."""
    n, size, k = emit.shape
    top = emit.max(axis=2, keepdims=True)
    e, t = np.exp(emit - top), np.exp(move)
    ahead, scale = np.zeros_like(e), np.ones((n, size))
    alive = [int(np.searchsorted(-lengths, -i, side="left")) for i in range(size + 1)]  # chains longer than i
    ahead[:, 0] = e[:, 0] * np.exp(start)
    scale[:, 0] = ahead[:, 0].sum(axis=1)
    ahead[:, 0] /= scale[:, :1]
    for i in range(1, size):
        m = alive[i]
        a = (ahead[:m, i - 1] @ t) * e[:m, i]
        scale[:m, i] = a.sum(axis=1)
        ahead[:m, i] = a / scale[:m, i, None]
    back, pairs = np.ones_like(e), np.zeros((k, k))
    for i in range(size - 2, -1, -1):
        m = alive[i + 1]
        b = e[:m, i + 1] * back[:m, i + 1] / scale[:m, i + 1, None]
        back[:m, i] = b @ t.T
        pairs += t * (ahead[:m, i].T @ b)
    inside = np.arange(size) < lengths[:, None]
    return ahead * back, pairs, float((np.log(scale) + top[:, :, 0])[inside].sum())


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # feature, label
    move: np.ndarray
    start: np.ndarray

    def word_labels(self, lines: list[list[str]]) -> list[np.ndarray]:
        """Label probabilities of every word of every line. Lines of like length are padded together."""
        found: list = [None] * len(lines)
        number: dict[str, int] = {}
        indices = [np.fromiter((number.setdefault(w, len(number)) for w in line), np.int64, len(line)) for line in lines]
        weights = summed(self.weights, list(number)) if number else np.zeros((0, len(self.labels)))
        order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))
        at = 0
        while at < len(order):
            size = len(lines[order[at]])
            part = order[at : at + max(1, BATCH_WORDS // size)]
            part = [i for i in part if 2 * len(lines[i]) >= size or size < 16]
            lengths = np.array([len(lines[i]) for i in part])
            emit = np.zeros((len(part), size, len(self.labels)))
            emit[np.arange(size) < lengths[:, None]] = weights[np.concatenate([indices[i] for i in part])]
            labels, _, _ = forward_backward(emit, lengths, self.move, self.start)
            for row, i in enumerate(part):
                found[i] = labels[row, : lengths[row]]
            at += len(part)
        return found

    def documents(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, its share of the letters) of each text; ``und`` where it has no letter. Of equal shares the first label in order wins."""
        lines, owner, sizes = [], [], []
        for k, text in enumerate(texts):
            for line in lines_of(text or ""):
                lines.append(line)
                owner.append(k)
                sizes.append(np.fromiter(map(len, line), float, len(line)))
        share = np.zeros((len(texts), len(self.labels)))
        for k, n, p in zip(owner, sizes, self.word_labels(lines), strict=True):
            share[k] += n @ p
        total = share.sum(axis=1)
        best = share.argmax(axis=1)
        return [(self.labels[b], min(1.0, float(share[k, b] / total[k]))) if total[k] > 0 else (UNKNOWN, 0.0) for k, b in enumerate(best)]


def fit(rows: list[tuple[str, str]], passes: int = 4, rate: float = 0.4, decay: float = 1e-4) -> Crf | None:
    """A model from (text, language) pairs, whole texts; every word of a text bears its language. None without pairs.

    Maximum likelihood by adaptive gradient steps over batches of lines.
    """
    labels = sorted({lang for _, lang in rows})
    if not labels:
        return None
    number, chains = {x: i for i, x in enumerate(labels)}, []
    for text, lang in sorted(rows, key=lambda r: (zlib.crc32(r[0].encode()), r)):
        chains += [(line, number[lang]) for line in lines_of(text)]
    k = len(labels)
    model = Crf(labels, np.zeros((1 << FEATURE_BITS, k)), np.zeros((k, k)), np.zeros(k))
    if k == 1:
        return model
    g_w, g_m, g_s = np.full(model.weights.shape, 1e-6), np.full((k, k), 1e-6), np.full(k, 1e-6)
    rng = np.random.default_rng(7)
    for _ in range(passes):
        order = rng.permutation(len(chains))
        for a in range(0, len(order), 128):
            part = sorted((chains[i] for i in order[a : a + 128]), key=lambda c: -len(c[0]))
            lengths = np.array([len(c[0]) for c in part])
            inside = np.arange(lengths[0]) < lengths[:, None]
            words = [w for c in part for w in c[0]]
            flat, owner = features(words)
            emit = np.zeros((len(part), lengths[0], k))
            emit[inside] = np.stack([np.bincount(owner, model.weights[flat, j], minlength=len(words)) for j in range(k)], axis=1)
            p, pairs, _ = forward_backward(emit, lengths, model.move, model.start)
            truth = np.repeat([c[1] for c in part], lengths)
            error = p[inside]
            error[np.arange(len(truth)), truth] -= 1
            n = len(truth)
            used, slot = np.unique(flat, return_inverse=True)
            step = np.stack([np.bincount(slot, error[owner, j], minlength=len(used)) for j in range(k)], axis=1) / n + decay * model.weights[used] / 100
            stay = np.bincount([c[1] for c in part], lengths - 1, minlength=k)
            move = (pairs - np.diag(stay)) / n + decay * model.move
            start = (p[:, 0].sum(axis=0) - np.bincount([c[1] for c in part], minlength=k)) / n + decay * model.start
            g_w[used] += step**2
            g_m += move**2
            g_s += start**2
            model.weights[used] -= rate * step / np.sqrt(g_w[used])
            model.move -= rate / 4 * move / np.sqrt(g_m)
            model.start -= rate / 4 * start / np.sqrt(g_s)
    np.clip(model.move, -4, 4, out=model.move)  # labels of whole documents say little about switches within one
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", documents: int = FIT_DOCUMENTS, words: int = FIT_WORDS) -> Crf | None:
    """A model from documents with a language that aren't held out.

    Of each language at most ``documents`` different texts are taken, by a hash of the text, until they
    have its share of ``words``; at least one. So copies count once and a rare language is
    learned beside any number of documents of others.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("text is not null and lang is not null and doc_id is not null").filter(F.crc32(F.col("doc_id").cast("binary")) % 4 != 2).withColumn("h", F.xxhash64("text", F.lit(5)))
    own = rows.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id"))
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("n") <= documents)
    own = materialize(own, "language-sample")
    share = words // max(1, own.select("lang").distinct().count())
    chosen = rows.join(broadcast_if(own.select("lang", "h", "doc_id"), 100_000), ["lang", "h", "doc_id"]).dropDuplicates(["lang", "h", "doc_id"])
    found, held = [], {}
    for r in chosen.orderBy("h", "lang", "doc_id").select("text", "lang").toLocalIterator():
        if held.get(r["lang"], 0) < share or r["lang"] not in held:
            held[r["lang"]] = held.get(r["lang"], 0) + sum(map(len, lines_of(r["text"])))
            found.append((r["text"], r["lang"]))
    return fit(found)


def identify(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text", batch_rows: int = 128) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. A narrow map over whole texts.

    Texts that are null or have no letter, and all texts where there is no model, are ``und`` with
    score 0. A null id is not held out. Only the named columns are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in parts:
            for a in range(0, whole.num_rows, batch_rows):
                ids, texts = (whole.column(i).slice(a, batch_rows).to_pylist() for i in range(2))
                found = own.documents(texts) if own else [(UNKNOWN, 0.0)] * len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([i is not None and held_out(i) for i in ids]), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
        tidy()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_spans(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text", batch_rows: int = 128) -> DataFrame:
    """A row per span: doc_id, start, stop (characters of the text), n_words, lang, score.

    A span is a run of words of a line whose likeliest label is the same; score is the mean of that
    label's probabilities. Texts that are null or have no letter, and all texts without a model, have none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("n_words", pa.int64()), ("lang", pa.string()), ("score", pa.float64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in parts:
            for a in range(0, whole.num_rows if own else 0, batch_rows):
                ids, texts = (whole.column(i).slice(a, batch_rows).to_pylist() for i in range(2))
                lines = [(i, at, list(WORD.finditer(line))) for i, t in zip(ids, texts, strict=True) for at, line in _lines_at(t or "")]
                lines = [x for x in lines if x[2]]
                found = []
                for (i, at, words), p in zip(lines, own.word_labels([[w.group().lower() for w in x[2]] for x in lines]), strict=True):
                    best = p.argmax(axis=1)
                    cuts = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)]
                    found += [{"doc_id": i, "start": at + words[x].start(), "stop": at + words[y - 1].end(), "n_words": y - x, "lang": own.labels[best[x]], "score": float(p[x:y, best[x]].mean())} for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_pylist(found, schema)
        tidy()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, stop long, n_words long, lang string, score double")


def _lines_at(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    for line in text.split("\n"):
        yield at, line
        at += len(line) + 1


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


QUERIES = {"op8_language_id": op8_language_id}
ORACLES: dict[str, str] = {}
