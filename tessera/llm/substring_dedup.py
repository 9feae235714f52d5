"""Removal of word passages that an earlier document holds, with a compressed FM-index per shard.

Windows of a fixed number of words are routed by an anchor, the smallest hash among their shorter
word runs, so that equal windows meet. Anchors that only one document has are dropped, and
windows of anchors that stand in very many different surroundings are routed by their own hash
instead, so that no shard grows with an anchor. Each shard indexes the segments it got (runs of windows with one key) but
those of a key's last document, and streams those of later documents against the index: backward
search over the wavelet matrix, with the earliest owner of the interval, gives the matching
statistics, and places whose match reaches a window's length are reported.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if, materialize, small, table
from .fm_index import FmIndex
from .shingles import few_rows, gram_hashes, mix, slices_by_bytes, tidy, word_hashes

WINDOW, ANCHOR_WORDS = 50, 10
TEXT_BYTES = 1_000_000
#: Words that one index holds, and the packed bytes that a shard is to get.
INDEX_WORDS, SHARD_BYTES = 600_000, 16_000_000
#: Different segments with an anchor beyond which its windows are routed by their own hash.
HOT_SEGMENTS = 4096
#: Shared windows of hot anchors that all tasks get as a list (16 MB), at most; beyond it each document's are joined to it.
LISTED_WINDOWS = 2_000_000
#: Segments and windows that a task remembers, to send equal ones once.
SEEN = 200_000
#: Documents with something to remove are broadcast up to so many; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000


def window_anchors(words: np.ndarray, owner: np.ndarray, window: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, anchor) of every window."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams, _ = gram_hashes(words, np.zeros(len(words), np.int8), width)
    span, reach, least = window - width + 1, 1, grams
    while 2 * reach <= span:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if span > reach:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    places = np.flatnonzero(owner[:n] == owner[window - 1 :])
    return places, least[places]


def window_hashes(words: np.ndarray, places: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of the window at each place."""
    grams, _ = gram_hashes(words, np.zeros(len(words), np.int8), window)
    return mix(grams[places] ^ np.uint64(0xA5A5))


def _batches(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for part in few_rows(parts):
        data = [(t or "").encode() for t in part.column("text").to_pylist()]
        for a, b in slices_by_bytes(list(map(len, data)), TEXT_BYTES):
            yield part.slice(a, b - a), data[a:b]


def _tagged(column: pa.Array, salt: np.ndarray) -> np.ndarray:
    """The keys listed for each document, told apart by the document's salt."""
    values, offsets = column.flatten(), np.concatenate(([0], np.cumsum(np.array(column.value_lengths().fill_null(0)))))
    return np.array(values, np.int64).view(np.uint64) ^ np.repeat(salt, np.diff(offsets))


def _run_starts(places: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Where runs of windows begin that follow each other and agree in ``same``; the end last."""
    change = np.diff(places) != 1
    for x in same:
        change |= x[1:] != x[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1, [len(places)])) if len(places) else np.zeros(1, np.int64)


def anchors(rows: DataFrame, window: int, width: int) -> DataFrame:
    """doc_id, row, key, fresh: the anchors of each document's runs of windows, and whether this task met the run's words for the first time."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, data in _batches(parts):
            words, owner, _, _ = word_hashes(data)
            places, least = window_anchors(words, owner, window, width)
            cuts = _run_starts(places, owner[places], least)
            first, last = cuts[:-1], cuts[1:] - 1
            alike = (mix(window_hashes(words, places[first], window)) + window_hashes(words, places[last], window) if len(first) else np.empty(0, np.uint64)).tolist()
            if len(seen) > SEEN:
                seen.clear()
            fresh = [x not in seen and not seen.add(x) for x in alike]
            who = pa.array(owner[places[first]])
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(who), part.column("row").take(who), pa.array(least[first].view(np.int64)), pa.array(fresh, pa.bool_())], names=["doc_id", "row", "key", "fresh"])

    return rows.filter("doc_id is not null").mapInArrow(run, "doc_id long, row long, key long, fresh boolean")


def shared_anchors(every: DataFrame) -> DataFrame:
    """key, n (different segments, as tasks count them) of the anchors that more than one document has. Counted within tasks first."""
    return every.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.sum(F.col("fresh").cast("long")).alias("n")).filter("a < b").select("key", "n")


def _hot(part: pa.RecordBatch, words: np.ndarray, owner: np.ndarray, window: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, document) of the windows whose anchor is among the document's hot ones."""
    places, least = window_anchors(words, owner, window, width)
    salt = mix(np.arange(part.num_rows, dtype=np.uint64) + np.uint64(1))
    places = places[np.isin(least ^ salt[owner[places]], _tagged(part.column("hot"), salt))]
    return places, owner[places]


def hot_windows(texts: DataFrame, window: int, width: int, every: bool) -> DataFrame:
    """key, a, b: windows of hot anchors with their first and last document in a batch; with ``every`` doc_id, row, key of each document's."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data in _batches(parts):
            words, owner, _, _ = word_hashes(data)
            places, who = _hot(part, words, owner, window, width)
            if not len(places):
                continue
            keys = window_hashes(words, places, window)
            if every:
                at = pa.array(who)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("row").take(at), pa.array(keys.view(np.int64))], names=["doc_id", "row", "key"])
                continue
            docs = np.array(part.column("doc_id"), np.int64)[who]
            order = np.lexsort((docs, keys))
            keys, docs = keys[order], docs[order]
            cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
            yield pa.RecordBatch.from_arrays([pa.array(keys[cuts[:-1]].view(np.int64)), pa.array(docs[cuts[:-1]]), pa.array(docs[cuts[1:] - 1])], names=["key", "a", "b"])

    return texts.mapInArrow(run, "doc_id long, row long, key long" if every else "key long, a long, b long")


_SEGMENT = pa.schema([("shard", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("words", pa.binary()), ("stop", pa.int64())])


def segments(live: DataFrame, listed: np.ndarray | None, shards: int, window: int, width: int) -> DataFrame:
    """Runs of windows with a shared anchor, and single shared windows of hot anchors, with their words' hashes.

    live: doc_id, row, text, cold and hot (its shared anchors), wins (its shared windows of hot ones,
    unless ``listed`` has all of them in order). What an earlier document of the same task has too
    needs no search: it leaves as finished, with stop set and no words. So of exact copies each task sends few.
    """
    shared = live.sparkSession.sparkContext.broadcast(listed)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        alike: dict[int, int] = {}
        for part, data in _batches(parts):
            words, owner, _, _ = word_hashes(data)
            places, least = window_anchors(words, owner, window, width)
            docs, rows = (np.array(part.column(c), np.int64) for c in ("doc_id", "row"))
            first, salt = np.searchsorted(owner, np.arange(len(data))), mix(np.arange(len(data), dtype=np.uint64) + np.uint64(1))
            found: list[tuple] = []  # shard, key, document, start, words, stop
            cold = np.flatnonzero(np.isin(least ^ salt[owner[places]], _tagged(part.column("cold"), salt)))
            at, keys = places[cold], least[cold]
            cuts = _run_starts(at, owner[at], keys).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                place, k, key = int(at[a]), int(owner[at[a]]), int(keys[a])
                own = words[place : at[b - 1] + window].tobytes()
                digest, doc = hashlib.blake2b(own, digest_size=16).digest(), int(docs[k])
                if seen.get(digest, doc) < doc:
                    found.append((key % shards, 0, k, place - first[k], None, place - first[k] + b - a - 1 + window))
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen[digest] = doc
                found.append((key % shards, key, k, place - first[k], own, None))
            at, who = _hot(part, words, owner, window, width)
            if len(at):
                keys = window_hashes(words, at, window)
                if shared.value is None:
                    keep = np.isin(keys ^ salt[who], _tagged(part.column("wins"), salt))
                else:
                    keep = shared.value[np.minimum(np.searchsorted(shared.value, keys), len(shared.value) - 1)] == keys if len(shared.value) else np.zeros(len(keys), bool)
                at, who, keys = at[keep], who[keep], keys[keep]
                every, group = np.unique(keys, return_inverse=True)
                earliest = np.full(len(every), np.iinfo(np.int64).max)
                np.minimum.at(earliest, group, docs[who])
                before = np.fromiter((alike.get(x, np.iinfo(np.int64).max) for x in every.tolist()), np.int64, len(every))
                earliest = np.minimum(earliest, before)
                if len(alike) > SEEN:
                    alike.clear()
                alike.update(zip(every.tolist(), earliest.tolist(), strict=True))
                later = docs[who] > earliest[group]
                for place, k, key in zip(at[~later].tolist(), who[~later].tolist(), keys[~later].tolist(), strict=True):
                    found.append((key % shards, key, k, place - first[k], words[place : place + window].tobytes(), None))
                at, who = at[later], who[later]
                cuts = _run_starts(at, who)
                for place, last, k in zip(at[cuts[:-1]].tolist(), at[cuts[1:] - 1].tolist(), who[cuts[:-1]].tolist(), strict=True):
                    found.append((place % shards, 0, k, place - first[k], None, last - first[k] + window))
            shard, key, k, start, own, stop = zip(*found, strict=True) if found else [()] * 6
            k = np.array(k, np.int64)
            columns = [shard, np.array(key, np.uint64).view(np.int64), docs[k], rows[k], start, own, stop]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _SEGMENT, strict=True)], schema=_SEGMENT)

    return live.mapInArrow(run, "shard int, key long, doc_id long, row long, start long, words binary, stop long")


def repeated_windows(groups: list[dict[bytes, int]], window: int) -> dict[bytes, np.ndarray]:
    """For the word sequences of each group (with their first documents), per window: whether it also stands in a sequence of a smaller document.

    Nobody asks for what only a group's last document has, and its first document asks for
    nothing: the former aren't indexed, the latter not streamed.
    """
    indexed, streamed = [], []
    for group in groups:
        least, most = min(group.values()), max(group.values())
        indexed += [(w, d) for w, d in group.items() if d < most]
        streamed += [(w, d) for w, d in group.items() if d > least]
    if not indexed:
        return {}
    known = np.frombuffer(b"".join(w for w, _ in indexed), np.uint64)
    asked = np.frombuffer(b"".join(w for w, _ in streamed), np.uint64)
    lengths, sizes = (np.array([len(w) // 8 for w, _ in x]) for x in (indexed, streamed))
    docs = np.unique([d for _, d in indexed + streamed])
    of, own = (np.searchsorted(docs, [d for _, d in x]).astype(np.int32) for x in (indexed, streamed))
    symbols, code = np.unique(known, return_inverse=True)
    text = np.zeros(len(known) + len(indexed), np.int64)
    text[np.arange(len(known)) + np.repeat(np.arange(len(indexed)), lengths)] = code + 1
    index = FmIndex(text, len(symbols) + 1, np.repeat(of, lengths + 1), window)
    at = np.minimum(np.searchsorted(symbols, asked), len(symbols) - 1)
    stream = np.where(symbols[at] == asked, at + 1, 0)
    ends = np.cumsum(sizes)
    hit = index.repeated(stream, ends - sizes, ends, own, window)
    return {w: hit[b - n : b - window + 1] for (w, _), b, n in zip(streamed, ends.tolist(), sizes.tolist(), strict=True)}


def search(routed: DataFrame, shards: int, window: int) -> DataFrame:
    """doc_id, row, start, stop: word ranges of a document that earlier ones hold."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])

    def ranges(groups: list[dict[bytes, list]]) -> pa.RecordBatch:
        """Groups have the members (doc_id, row, start) of each word sequence."""
        first, found = [{words: min(m[0] for m in members) for words, members in group.items()} for group in groups], []
        hits = repeated_windows(first, window)
        for group, own in zip(groups, first, strict=True):
            for words, members in group.items():
                runs = None
                for doc, row, start in members:
                    if doc > own[words]:
                        found.append((doc, row, start, start + len(words) // 8))
                        continue
                    if runs is None:
                        hit = hits.get(words)
                        edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).view(np.int8))).tolist() if hit is not None and hit.any() else []
                        runs = list(zip(edge[::2], edge[1::2], strict=True))
                    found += [(doc, row, start + a, start + b - 1 + window) for a, b in runs]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(4)], schema=schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[bytes, list]] = {}
        for part in parts:
            done = part.filter(pa.compute.is_valid(part.column("stop")))
            yield pa.RecordBatch.from_arrays([done.column(c) for c in schema.names], schema=schema)
            rest = part.filter(pa.compute.is_null(part.column("stop")))
            for key, words, *member in zip(*(rest.column(c).to_pylist() for c in ("key", "words", "doc_id", "row", "start")), strict=True):
                held.setdefault(key, {}).setdefault(words, []).append(member)
        block, size = [], 0
        for key in sorted(held):
            group = held.pop(key)
            docs = {m[0] for members in group.values() for m in members}
            if len(docs) == 1:
                continue
            block.append(group)
            size += sum(len(words) // 8 for words in group)
            if size > INDEX_WORDS:
                yield ranges(block)
                block, size = [], 0
        if block:
            yield ranges(block)
        del block
        tidy()

    return routed.repartition(shards, "shard").mapInArrow(run, "doc_id long, row long, start long, stop long")


def repeated_ranges(rows: DataFrame, window: int = WINDOW, width: int = ANCHOR_WORDS, hot_segments: int = HOT_SEGMENTS, listed_windows: int = LISTED_WINDOWS) -> DataFrame:
    """doc_id, row, ranges (array of struct start, stop) of the documents that hold words of earlier ones."""
    keys, none, listed = ["doc_id", "row"], F.array().cast("array<long>"), np.empty(0, np.uint64)
    every = materialize(anchors(rows, window, width), "passage-anchors")
    shared = materialize(shared_anchors(every), "passage-shared")
    hot = F.col("n") > hot_segments
    live = every.join(shared, "key").groupBy(*keys).agg(F.collect_set(F.when(~hot, F.col("key"))).alias("cold"), F.collect_set(F.when(hot, F.col("key"))).alias("hot"), F.count(F.lit(1)).alias("n"))
    live = materialize(live.withColumn("wins", none), "passage-live")
    if not shared.filter(hot).isEmpty():
        texts = rows.join(live.filter("size(hot) > 0").select(*keys, "hot"), keys).select(*keys, "text", "hot")
        wins = hot_windows(texts, window, width, False).groupBy("key").agg(F.min("a").alias("a"), F.max("b").alias("b")).filter("a < b").select("key")
        wins = materialize(wins, "passage-windows")
        if small(wins, listed_windows):
            listed = np.sort(np.array([r["key"] for r in wins.collect()], np.int64).view(np.uint64))
        else:
            listed = None
            own = materialize(hot_windows(texts, window, width, True), "passage-own-windows").join(wins, "key").groupBy(*keys).agg(F.collect_set("key").alias("own"))
            live = live.join(own, keys, "left").withColumn("wins", F.coalesce("own", none))
    n_segments = live.agg(F.sum("n")).first()[0] or 0
    shards = max(16, -(-n_segments * 8 * (window + (window - width) // 2) // SHARD_BYTES))
    texts = rows.join(live, keys).select(*keys, "text", "cold", "hot", "wins")
    found = search(segments(texts, listed, shards, window, width), shards, window)
    return found.groupBy(*keys).agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot_segments: int = HOT_SEGMENTS, listed_windows: int = LISTED_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (text; null stays null without words).

    A word goes if a window of ``window`` words over it also starts in a document with a smaller id.
    Windows are judged on the input. Rows without id are left whole and remove nothing from others;
    rows that repeat an id are one document to each other. Only the named columns are looked at.
    """
    rows = numbered(docs, id_col, text_col)
    ranges = materialize(repeated_ranges(rows, window, hot_segments=hot_segments, listed_windows=listed_windows), "passage-ranges")
    joined = rows.join(broadcast_if(ranges, BROADCAST_ROWS), ["doc_id", "row"], "left").select("doc_id", "text", "ranges")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few_rows(parts):
            n, gone, kept = [], [], []
            for text, cut in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist(), strict=True):
                words = (text or "").encode().split()
                n.append(len(words))
                if cut:
                    keep = np.ones(len(words), bool)
                    for r in cut:
                        keep[r["start"] : r["stop"]] = False
                    words = [words[i] for i in np.flatnonzero(keep)]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, CAST(greatest(len(w) - 48, 1) AS BIGINT))) AS p FROM d)),
m AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
r AS (SELECT DISTINCT doc_id, q FROM (SELECT g.doc_id, unnest(range(g.p, g.p + 50)) AS q FROM g JOIN m USING (h) WHERE m.least < g.doc_id)),
x AS (SELECT doc_id, list(q) AS qs FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN qs IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(qs, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""

QUERIES = {"op4_substring_dedup": op4_substring_dedup}
ORACLES = {"op4_substring_dedup": SQL}
