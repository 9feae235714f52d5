"""Token counts by field and section, from one encoding of the whole document.

A document's fields are joined by line ends and encoded once. The tokens' spans are then
joined with the spans of the sections (each metadata field, and each line of the text). A token
that crosses a boundary is allocated by an explicit rule.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_pattern, default_vocabulary
from .common import table
from .shingles import few_rows

#: To whom a token that crosses boundaries belongs: the section of its first byte, of its last, or of most of its bytes (of equal shares the first).
RULES = ("first", "last", "most")
_CODECS: dict = {}


def codec(path: str, pattern: str):
    """(encoding, bytes of each id), once in each worker."""
    if (path, pattern) not in _CODECS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        lengths[list(ranks.values())] = list(map(len, ranks))
        _CODECS[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _CODECS[path, pattern]


def allocate(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses): tokens end at ``ends``, section i is bounds[i] to bounds[i + 1], both in bytes."""
    starts = np.concatenate(([0], ends[:-1]))
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    if rule == "first":
        return first, first != last
    if rule == "last":
        return last, first != last
    best, most = first.copy(), np.minimum(ends, bounds[first + 1]) - starts
    for i in np.flatnonzero(first != last):
        for s in range(first[i] + 1, last[i] + 1):
            share = min(ends[i], bounds[s + 1]) - bounds[s]
            if share > most[i]:
                best[i], most[i] = s, share
    return best, first != last


def sections(values: list[str | None], names: list[str]) -> tuple[str, list[tuple[str, int]], np.ndarray]:
    """The document, (field, section number) of its sections, and where each begins in characters, with the end last.

    Fields that are null or empty are left out. The last field is cut into lines; a line end
    belongs to what it ends.
    """
    parts, found, at = [], [], [0]
    filled = [(n, v) for n, v in zip(names, values, strict=True) if v]
    for k, (name, value) in enumerate(filled):
        more = value + ("\n" if k < len(filled) - 1 else "")
        for i, line in enumerate(_lines(more) if name == names[-1] else [more]):
            found.append((name, i))
            at.append(at[-1] + len(line))
        parts.append(more)
    return "".join(parts), found, np.array(at, np.int64)


def _lines(text: str) -> list[str]:
    lines = [x + "\n" for x in text.split("\n")]
    lines[-1] = lines[-1][:-1]
    return lines if lines[-1] else lines[:-1]


def count_tokens(docs: DataFrame, fields: list[str], id_col: str = "doc_id", rule: str = "first", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """A row per document and section: doc_id, field, section, start_char, n_chars, n_tokens, n_crossing.

    n_tokens adds up to the tokens of the whole document; n_crossing of them also cover another
    section. A document whose fields are all null or empty has no sections and gives no row.
    Repeated rows are counted each. Only the named columns are read.
    """
    if rule not in RULES:
        raise ValueError(f"the rule is one of {RULES}")
    path, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = codec(path, pattern)
        for part in few_rows(parts):
            ids, columns = part.column(0).to_pylist(), [part.column(i + 1).to_pylist() for i in range(len(fields))]
            held: list[list] = [[] for _ in range(7)]
            for doc, *values in zip(ids, *columns, strict=True):
                text, found, chars = sections(values, fields)
                if not found:
                    continue
                data = np.frombuffer(text.encode(), np.uint8)
                begins = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of characters
                bounds = np.concatenate((begins, [len(data)]))[chars]
                ends = np.cumsum(lengths[np.asarray(encoding.encode_ordinary(text), np.int64)])
                owner, crosses = allocate(ends, bounds, rule)
                n = len(found)
                for column, x in zip(held, ([doc] * n, [f for f, _ in found], [s for _, s in found], chars[:-1].tolist(), np.diff(chars).tolist(), np.bincount(owner, minlength=n).tolist(), np.bincount(owner[crosses], minlength=n).tolist()), strict=True):
                    column += x
                if len(held[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(held, schema, strict=True)], schema=schema)
                    held = [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(held, schema, strict=True)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("field", pa.string()), ("section", pa.int64()), ("start_char", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), *[F.col(f).cast("string").alias(f"_{i}") for i, f in enumerate(fields)])
    return rows.mapInArrow(run, "doc_id long, field string, section long, start_char long, n_chars long, n_tokens long, n_crossing long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), ["source", "lang", "text"])


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLES: dict[str, str] = {}
