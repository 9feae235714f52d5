"""Byte-level BPE: exact merges in linear time, and decoding.

The bytes of a piece are mapped to Latin-1 so that one Aho-Corasick pass finds every
vocabulary entry in it. Encoding walks from the left, takes the longest entry and backs off
to shorter ones, or to the previous place, until neighbouring tokens are compatible: that is,
until the merges would not have joined anything across their border. A border is judged by
undoing merges on both sides of it, and the verdict is memoised. Each place is given up at
most once, so the work is linear in the piece's length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .shingles import KEPT, tidy

#: Pieces and pairs that are remembered within a task; beyond it the memory starts anew.
CACHE_ENTRIES = 200_000
#: Longer pieces are encoded without being remembered.
CACHE_CHARS = 64

#: Texts without other white space, letters and digits than these, and default_pattern() for them.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
PLAIN_TEXT = f"[\x00-\x1b\x20-\x7f{_LETTERS}]*"
PLAIN_PIECES = rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Encoder:
    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ids = {base64.b64decode(token).decode("latin-1"): int(rank) for token, rank in pairs}
        self.of = {i: token for token, i in self.ids.items()}
        # White space is Unicode's White_Space here; the regex module counts four control characters more.
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.plain = (re.compile(PLAIN_TEXT), re.compile(PLAIN_PIECES)) if pattern == default_pattern() else None
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.automaton.add_word(token, i)
        self.automaton.make_automaton()
        self.joined: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}  # the two tokens that a token was merged from
        self._undo_merges()
        self.length = {i: len(token) for i, token in self.of.items()}
        self.shorter = {i: next((self.ids[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ids), -1) for i, token in self.of.items()}
        self.bytes_of = {str(i): token.encode("latin-1") for i, token in self.of.items()}
        self.pairs = _Memo(lambda pair: self._fits(pair >> 32, pair & 0xFFFFFFFF))
        self.id_text = _Memo(lambda piece: " ".join(map(str, self.piece(piece))), CACHE_CHARS)

    def forget(self) -> None:
        self.pairs.clear()
        self.id_text.clear()

    def _undo_merges(self) -> None:
        """parts, and joined, its reverse. In order of rank, as a split is judged by earlier merges."""
        for token, i in sorted(self.ids.items(), key=lambda x: x[1]):
            self.parts[i] = None
            for cut in range(len(token) - 1, 0, -1):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None and a < i and b < i and self._fits(a, b):
                    self.parts[i], self.joined[a, b] = (a, b), i
                    break

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging left + right by rank leaves the border between them standing.

        The younger token of the two is taken apart step by step; if at any time the two
        that touch the border form a token older than what was just undone, the merges
        would have joined them first.
        """
        bound = len(self.ids) + 1
        while True:
            if self.joined.get((left, right), bound) < bound:
                return False
            if left > right:
                bound, split = left, self.parts[left]
                if split is None:
                    bound, split = right + 1, self.parts[right]
                    if split is None:
                        return True
                    right = split[0]
                else:
                    left = split[1]
            else:
                bound, split = right + 1, self.parts[right]
                if split is None:
                    bound, split = left, self.parts[left]
                    if split is None:
                        return True
                    left = split[1]
                else:
                    right = split[0]

    def piece(self, text: str) -> list[int]:
        """Ids of one match of the pattern."""
        raw = text.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.ids.get(raw)
        if whole is not None:
            return [whole]
        pairs, length, last = self.pairs, self.length, -1
        found: list[int] = []
        for _, token in self.automaton.iter_long(raw):
            if last >= 0 and not pairs[last << 32 | token]:
                break
            found.append(token)
            last = token
        else:
            return found
        at, dead = sum(map(length.__getitem__, found)), set()
        while True:
            end = at + length[token]
            if end not in dead and (not found or pairs[found[-1] << 32 | token]):
                found.append(token)
                at = end
                if at == len(raw):
                    return found
                token = next(self.automaton.iter_long(raw, at))[1]
                continue
            token = self.shorter[token]
            while token < 0:  # nothing fits here: never come back to this place
                dead.add(at)
                if not found:
                    raise ValueError("the vocabulary lacks single bytes")
                at -= length[found[-1]]
                token = self.shorter[found.pop()]

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pieces(text) for i in self.piece(p)]

    def pieces(self, text: str) -> list[str]:
        """Matches of the pattern. Texts of basic Latin letters take a cheaper expression that finds the same."""
        if self.plain and self.plain[0].fullmatch(text):
            return self.plain[1].findall(text)
        return self.pattern.findall(text)

    def decode(self, ids: list[int]) -> bytes:
        return "".join(map(self.of.__getitem__, ids)).encode("latin-1")

    def round_trip(self, text: str) -> tuple[int, str, bytes]:
        """Number of ids, the ids in decimal joined by spaces, and the bytes that they decode to."""
        joined = " ".join(map(self.id_text.__getitem__, self.pieces(text)))
        ids = joined.split()
        self.pairs.trim()
        self.id_text.trim()
        return len(ids), joined, b"".join(map(self.bytes_of.__getitem__, ids))


class _Memo(dict):
    """Values by key, made when first asked for; those of keys with too large a size aren't kept."""

    def __init__(self, make, longest: int | None = None):
        super().__init__()
        self.make, self.longest = make, longest

    def __missing__(self, key):
        value = self.make(key)
        if self.longest is None or len(key) <= self.longest:
            self[key] = value
        return value

    def trim(self) -> None:
        """Starts anew beyond so many entries."""
        if len(self) > CACHE_ENTRIES:
            self.clear()


_ENCODERS: dict[tuple[str, str], Encoder] = {}
KEPT.append(_ENCODERS)


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder in each worker process, until a task of another operator begins there."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>): whole texts; null counts as empty and has no ids. A narrow map, no shuffle."""
    path, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path, pattern)
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "ids": [own.encode(t) if isinstance(t, str) else [] for t in part["text"]]})

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return rows.mapInPandas(batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, data (binary): the bytes of the ids; null ids give empty bytes."""
    path, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path, pattern)
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "data": [b"" if ids is None else own.decode(list(ids)) for ids in part["ids"]]})

    rows = encoded.select("doc_id", "ids")
    return rows.mapInPandas(batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, data binary")


def bpe_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None, with_ids: bool = False, batch_rows: int = 256) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids if asked for. Encodes and decodes whole texts.

    Null and empty texts have no tokens and the digests of empty input. Rows are independent,
    so repeated ids and extra columns do no harm. A worker holds ``batch_rows`` texts and a
    bounded memory of pieces.
    """
    import pyarrow as pa

    path, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for whole in parts:
            for at in range(0, whole.num_rows, batch_rows):
                part = whole.slice(at, batch_rows)
                n, whole_ids, ids, data = [], [], [], []
                for text in part.column(1):
                    k, s, b = own.round_trip(text.as_py() or "")
                    n.append(k)
                    if with_ids:
                        whole_ids.append(list(map(int, s.split())))
                    ids.append(hashlib.sha256(s.encode()).hexdigest())
                    data.append(hashlib.sha256(b).hexdigest())
                columns = {"doc_id": part.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(data, pa.string())}
                if with_ids:
                    columns["ids"] = pa.array(whole_ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        own.forget()  # workers live on, and the next stage needs the room
        tidy()

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS STRING) AS text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{', ids array<int>' * with_ids}")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
ORACLES: dict[str, str] = {}
