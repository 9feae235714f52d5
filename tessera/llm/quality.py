"""Quality classifier by co-training.

Two classifiers see the same documents through separate views: the text (hashed words and
figures of its form) and the page's metadata (source, language, length). Both start from
labelled documents; in each round both score all documents, and either hands some that it is sure of to
the other as pseudo-labels. In the end each view is calibrated on labelled documents that it wasn't fitted on, and the
calibrated views are weighed against each other to score every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .shingles import few_rows, mix, slices_by_bytes, word_hashes

#: Labelled documents that a model is fitted on, and distinct words of them in all, at most. They bound what the driver holds, not what is scored.
FIT_LABELLED, FIT_WORDS = 8000, 16_000_000
#: Documents that a view hands over in a round for each label.
PER_ROUND = 400
WORD_BITS, META_BITS = 16, 10
TEXT_BYTES = 400_000
N_FORM = 12
_KINDS = np.zeros((256, 5), np.float64)  # upper case, lower case, digits, marks, line ends
_KINDS[65:91, 0] = _KINDS[97:123, 1] = _KINDS[48:58, 2] = _KINDS[10, 4] = 1
_KINDS[[i for i in range(33, 127) if not chr(i).isalnum()], 3] = 1


def text_view(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, feature) of the distinct hashed words of each text, and a row of figures of form for each."""
    words, owner, starts, ends = word_hashes(texts)
    lower, _, _, _ = word_hashes([t.lower() for t in texts])
    n = len(texts)
    pairs = np.unique(owner.astype(np.int64) << WORD_BITS | (lower >> np.uint64(64 - WORD_BITS)).astype(np.int64))
    count = np.bincount(owner, minlength=n).astype(float)
    some = np.maximum(count, 1)
    _, once = np.unique(lower ^ mix(owner.astype(np.uint64) + np.uint64(1)), return_index=True)
    distinct = np.bincount(owner[once], minlength=n)
    again = np.bincount(owner[1:][(lower[1:] == lower[:-1]) & (owner[1:] == owner[:-1])], minlength=n)
    form = np.zeros((n, N_FORM))
    for i, t in enumerate(texts):
        form[i, :5] = np.bincount(np.frombuffer(t, np.uint8), minlength=256) @ _KINDS
    letters, size = np.maximum(form[:, 0] + form[:, 1], 1), np.maximum([len(t) for t in texts], 1)
    mean = np.bincount(owner, ends - starts, minlength=n) / some
    form = np.stack([form[:, 0] / letters, form[:, 2] / size, form[:, 3] / size, form[:, 3] / some, form[:, 4] / some, np.log1p(count) / 10, distinct / some, again / some, mean / 20, np.abs(mean - 6) / 20, (count == 0) * 1.0, np.ones(n)], axis=1)
    return pairs >> WORD_BITS, pairs & ((1 << WORD_BITS) - 1), np.clip(form, 0, 3)


def meta_view(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Three hashed features a document: source, language and the power of two of its length; null is a value of its own."""
    def code(kind: str, value) -> int:
        return zlib.crc32(f"{kind}={value}".encode()) & ((1 << META_BITS) - 1)

    return np.array([[code("source", s), code("lang", g), code("chars", None if c is None else int(c).bit_length())] for s, g, c in zip(source, lang, n_chars, strict=True)], np.int64).reshape(-1, 3)


class _Logistic:
    """Logistic regression over (row, feature) pairs of weight 1 and dense columns, by accelerated full gradient steps."""

    def __init__(self, features: int, dense: int):
        self.w, self.v = np.zeros(features), np.zeros(dense)

    def logits(self, row, feature, dense, n):
        return np.bincount(row, self.w[feature], minlength=n) + dense @ self.v

    def fit(self, row, feature, dense, y, weight, steps=120, rate=1.0, decay=1e-5):
        n = len(y)
        per = np.maximum(np.bincount(feature, np.ones(len(feature)), minlength=len(self.w)), 1)
        scale = 1 / np.sqrt(per / n + 1e-3)  # rare words move as readily as frequent ones
        gw, gv = np.zeros_like(self.w), np.zeros_like(self.v)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(self.logits(row, feature, dense, n), -30, 30)))
            e = (p - y) * weight / weight.sum()
            dw = np.bincount(feature, e[row], minlength=len(self.w)) * scale + decay * self.w
            dv = dense.T @ e + decay * self.v
            gw += dw**2
            gv += dv**2
            self.w -= rate * 0.1 * dw / np.sqrt(gw + 1e-12)
            self.v -= rate * dv / np.sqrt(gv + 1e-12)
        return self


def _platt(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of the columns of x, and of a constant last, that make them the log odds of y (Newton's method)."""
    x = np.column_stack([x, np.ones(len(y))])
    c = np.zeros(x.shape[1])
    goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(len(c))
        c -= np.linalg.solve(h, x.T @ (p - goal) + 1e-3 * c)
    return c


@dataclass
class Model:
    text: _Logistic
    meta: _Logistic
    text_fit: np.ndarray
    meta_fit: np.ndarray
    both: np.ndarray
    threshold: float

    def views(self, texts: list[bytes], meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log odds of either view."""
        row, feature, form = text_view(texts)
        a = self.text.logits(row, feature, form, len(texts))
        b = _meta_logits(self.meta, meta)
        return a * self.text_fit[0] + self.text_fit[1], b * self.meta_fit[0] + self.meta_fit[1]

    def score(self, texts: list[bytes], meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.views(texts, meta)
        return _p(a), _p(b), _p(a * self.both[0] + b * self.both[1] + self.both[2])


def _p(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _meta_rows(meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(meta)), meta.shape[1]), meta.ravel(), np.ones((len(meta), 1))


def _meta_logits(model: _Logistic, meta: np.ndarray) -> np.ndarray:
    row, feature, one = _meta_rows(meta)
    return model.logits(row, feature, one, len(meta))


_FEATURES = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("words", pa.binary()), ("form", pa.list_(pa.float64())), ("meta", pa.list_(pa.int64()))])


def _feature_rows(part: pa.RecordBatch, *columns: str) -> Iterator[tuple[int, list[bytes], np.ndarray, tuple]]:
    """(first row, packed words of each, metadata, text view) of slices of a batch with columns text, source, lang, n_chars under these names."""
    text, source, lang, chars = (part.column(c).to_pylist() for c in columns)
    data = [(t or "").encode() for t in text]
    for a, b in slices_by_bytes(list(map(len, data)), TEXT_BYTES):
        row, feature, form = text_view(data[a:b])
        cuts = np.searchsorted(row, np.arange(b - a + 1))
        yield a, [feature[x:y].astype(np.uint16).tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], meta_view(source[a:b], lang[a:b], chars[a:b]), (row, feature, form)


_VIEWS = ("text", "source", "lang", "n_chars")


def _view_frame(docs: DataFrame) -> DataFrame:
    """Features of the documents, as the fit needs them; texts stay on the executors."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few_rows(parts):
            ids, ys = part.column("doc_id").to_pylist(), part.column("y").to_pylist()
            for a, words, meta, (_, _, form) in _feature_rows(part, *_VIEWS):
                yield pa.RecordBatch.from_pylist([{"doc_id": ids[a + i], "y": ys[a + i], "words": w, "form": form[i].tolist(), "meta": meta[i].tolist()} for i, w in enumerate(words)], _FEATURES)

    return docs.mapInArrow(run, "doc_id long, y int, words binary, form array<double>, meta array<long>")


def _columns(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, size_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(size_col).cast("long").alias("n_chars"))


def _labelled(docs: DataFrame, known: DataFrame, labelled: int, most_words: int) -> list:
    """A bounded sample of the labelled documents, by a hash of the id: one row an id, up to so many distinct words in all."""
    chosen = docs.select("doc_id").join(known, "doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(labelled)
    rows = _view_frame(docs.join(F.broadcast(chosen), "doc_id")).groupBy("doc_id").agg(F.min(F.struct("words", "y", "form", "meta")).alias("r")).select("doc_id", "r.*")
    found, held = [], 0
    for r in rows.orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").toLocalIterator():
        held += len(r["words"]) // 2
        if held > most_words:
            break
        found.append(r)
    return sorted(found, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))


def _confident(docs: DataFrame, known: DataFrame, views: tuple, sure: float, per_round: int) -> list:
    """Rows kind, key, words, form, meta of documents without a label of which a view is sure; kind is 2 * view + label.

    All documents are scored. Of the sure ones ``per_round`` of each kind stay, by a hash of the content, so
    that copies count once and no group of them fills the places. Each task keeps so many; tasks are
    merged in two steps.
    """
    shared = docs.sparkSession.sparkContext.broadcast(views)
    most = 2 * per_round  # some will turn out to be labelled

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[int, dict]] = {k: {} for k in range(4)}
        for part in few_rows(parts):
            ids = part.column("doc_id").to_pylist()
            for a, words, meta, (row, feature, form) in _feature_rows(part, *_VIEWS):
                (text, text_fit), (page, page_fit) = shared.value
                p = [_p(text.logits(row, feature, form, len(words)) * text_fit[0] + text_fit[1]), _p(_meta_logits(page, meta) * page_fit[0] + page_fit[1])]
                for kind in range(4):
                    certainty = p[kind // 2] if kind % 2 else 1 - p[kind // 2]
                    for i in np.flatnonzero(certainty >= sure).tolist():
                        if ids[a + i] is None:
                            continue
                        key = xxhash.xxh3_64_intdigest(words[i] + meta[i].tobytes()) >> 1
                        old = best[kind].get(key)
                        if old is None or ids[a + i] < old["doc_id"]:
                            best[kind][key] = {"kind": kind, "key": key, "doc_id": ids[a + i], "words": words[i], "form": form[i].tolist(), "meta": meta[i].tolist()}
                    if len(best[kind]) > 2 * most:
                        best[kind] = {k: best[kind][k] for k in sorted(best[kind])[:most]}
        yield pa.RecordBatch.from_pylist([own[k] for own in best.values() for k in sorted(own)[:most]], schema)

    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), *[_FEATURES.field(c) for c in ("doc_id", "words", "form", "meta")]])
    found = docs.mapInArrow(run, "kind int, key long, doc_id long, words binary, form array<double>, meta array<long>").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(256)))
    for by in (["kind", "part"], ["kind"]):
        found = found.groupBy(*by, "key").agg(F.min(F.struct("doc_id", "words", "form", "meta")).alias("r")).withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("key"))).filter(F.col("n") <= most).select("kind", "part" if "part" in by else F.lit(0).alias("part"), "key", "r.*")
    rows = found.join(known, "doc_id", "left_anti").orderBy("kind", "key").collect()
    return [r for kind in range(4) for r in [r for r in rows if r["kind"] == kind][:per_round]]


def cotrain(docs: DataFrame, labels: DataFrame, rounds: int = 3, per_round: int = PER_ROUND, sure: float = 0.95, keep_clean: float = 0.995, labelled: int = FIT_LABELLED, most_words: int = FIT_WORDS) -> Model | None:
    """A model from docs (doc_id, text, source, lang, n_chars) and labels (doc_id, y: 1 good, 0 bad).

    Fitted on at most ``labelled`` documents with labels, and on pseudo-labels that are drawn from all others. The
    threshold is 0.5, or less if that would reject more than 1 - keep_clean of the good documents of the fold
    that calibrates. None if there aren't both good and bad documents to learn from.
    """
    known = labels.groupBy("doc_id").agg(F.max("y").alias("y")).filter("doc_id is not null and y is not null")
    rows = _labelled(docs, known, labelled, most_words)
    y = np.array([r["y"] for r in rows])
    fold, fit = np.arange(0, len(rows), 4), np.setdiff1d(np.arange(len(rows)), np.arange(0, len(rows), 4))
    if min(((y[x] == k).sum() for x in (fold, fit) for k in (0, 1)), default=0) < 3:
        return None
    text, page = _Logistic(1 << WORD_BITS, N_FORM), _Logistic(1 << META_BITS, 1)

    def text_rows(own):
        words = [np.frombuffer(r["words"], np.uint16).astype(np.int64) for r in own]
        return np.repeat(np.arange(len(own)), list(map(len, words))), np.concatenate([np.empty(0, np.int64), *words]), np.array([r["form"] for r in own]).reshape(-1, N_FORM)

    def meta_rows(own):
        return _meta_rows(np.array([r["meta"] for r in own], np.int64).reshape(-1, 3))

    calibrating, fitted = [rows[i] for i in fold], [rows[i] for i in fit]
    fold_text, fold_meta = text_rows(calibrating), meta_rows(calibrating)

    def odds(view):
        return (text.logits(*fold_text, len(fold)) if view == 0 else page.logits(*fold_meta, len(fold)))[:, None]

    given: tuple[dict, dict] = ({}, {})  # pseudo-labels that text (0) and page (1) got from the other view: rows and labels by content
    for k in range(rounds + 1):
        for view, model in enumerate((text, page)):
            own = [given[view][key] for key in sorted(given[view])]
            goal = np.concatenate([y[fit], [label for _, label in own]]).astype(float)
            weight = np.where(np.arange(len(goal)) < len(fit), 1.0, 0.3)
            every = fitted + [r for r, _ in own]
            model.fit(*(text_rows(every) if view == 0 else meta_rows(every)), goal, weight, steps=120 if k == 0 else 40)
        fits = [_platt(odds(view), y[fold]) for view in (0, 1)]
        if k < rounds:
            for r in _confident(docs, known, ((text, fits[0]), (page, fits[1])), sure, per_round):
                given[1 - r["kind"] // 2][r["key"]] = (r, r["kind"] % 2)
    both_odds = np.column_stack([odds(view)[:, 0] * fits[view][0] + fits[view][1] for view in (0, 1)])
    both = _platt(both_odds, y[fold])
    good = np.sort(_p(both_odds @ both[:2] + both[2])[y[fold] == 1])
    return Model(text, page, *fits, both, min(0.5, float(good[int(len(good) * (1 - keep_clean))])))


def _scores(own: Model | None, part: pa.RecordBatch, *columns: str) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    """(first row, end, the three scores, kept) of slices of a batch with columns text, source, lang, n_chars under these names."""
    text, source, lang, chars = (part.column(c).to_pylist() for c in columns)
    data = [(t or "").encode() for t in text]
    for a, b in slices_by_bytes(list(map(len, data)), TEXT_BYTES):
        found = [np.full(b - a, 0.5)] * 3 if own is None else own.score(data[a:b], meta_view(source[a:b], lang[a:b], chars[a:b]))
        yield a, b, found, found[2] >= (0 if own is None else own.threshold)


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, text_score, meta_score, score, kept of every row of docs (doc_id, text, source, lang, n_chars)."""
    names = ["doc_id", "text_score", "meta_score", "score", "kept"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few_rows(parts):
            for a, b, found, kept in _scores(shared.value, part, "text", "source", "lang", "n_chars"):
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), *map(pa.array, found), pa.array(kept)], names=names)

    rows = docs.select("doc_id", "text", "source", "lang", "n_chars")
    return rows.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, kept boolean")


def good_labels(labels: DataFrame) -> DataFrame:
    """doc_id, y from the labels table: good is of quality and not toxic. A null mark counts as not said: quality decides, toxic as 0."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).when(F.col("quality").isNotNull(), 0).alias("y"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars") -> DataFrame:
    """One row per document: doc_id, text_score, meta_score, score (0 to 1), kept.

    Null texts count as empty, null metadata is a value of its own, repeated rows are scored each. With no
    labels, or labels of one kind only, every score is 0.5 and everything is kept. Of labels that repeat an id
    the better one counts. Only the named columns are looked at.
    """
    rows = _columns(docs, id_col, text_col, source_col, lang_col, size_col)
    return score_documents(rows, cotrain(rows, good_labels(labels)))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars") -> DataFrame:
    """The rows of docs, with all their columns, that quality_scores() keeps. A narrow map: rows that repeat an id are judged each."""
    shared = docs.sparkSession.sparkContext.broadcast(cotrain(_columns(docs, id_col, text_col, source_col, lang_col, size_col), good_labels(labels)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few_rows(parts):
            for a, b, _, kept in _scores(shared.value, part, text_col, source_col, lang_col, size_col):
                yield part.slice(a, b - a).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def op1_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op1_quality_cotraining": op1_quality_cotraining}
ORACLES: dict[str, str] = {}
