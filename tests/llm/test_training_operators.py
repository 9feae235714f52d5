"""Each training-data operator against a brute-force version, and on odd input: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, chat_format, components, decontaminate, exact_dedup, fm_index, jaccard_join, language_id, license_scan, quality, shingles, substring_dedup, token_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a table may have them too.
CLASHING = ["norm", "key", "row", "node", "anchor", "kept", "score", "words"]


def table(spark, texts, schema="doc_id long, text string", clash=True):
    rows = spark.createDataFrame(list(texts), schema)
    for c in CLASHING if clash else []:
        rows = rows.withColumn(c, F.lit("x"))
    return rows


def empty(spark):
    return table(spark, [])


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def prose(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# ---- exact deduplication
@pytest.mark.parametrize("capacity", [exact_dedup.CAPACITY, 1])
def test_exact(spark, capacity):
    rows = [(1, "Ab É"), (2, "aB É"), (3, "ab é"), (4, None), (5, ""), (6, "x" * 200_000), (7, "X" * 200_000), (7, "x" * 200_000), (None, "ab É"), (None, "only")]
    got = exact_dedup.exact_dedup(table(spark, rows), capacity=capacity).collect()
    want = {}
    for i, t in rows:
        want.setdefault((t or "").translate(LOWER), []).append(i)
    expected = sorted((str(i), str(max((x for x in g if x is not None), default=None)), len(g), i == max((x for x in g if x is not None), default=None), sha(t)) for t, g in want.items() for i in g)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in got) == expected
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_collisions_are_told_apart(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "a", "b", "b"])], "doc_id long, norm string")
    keyed = rows.select("doc_id", "norm", F.lit(0).cast("long").alias("bucket"), F.lit(1).cast("long").alias("key"), F.lit("s").alias("sha"), F.lit(1).alias("n_bytes"))
    index = keyed.groupBy("bucket", "key", "sha", "n_bytes").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("size"))
    assert sorted(r["doc_id"] for r in exact_dedup.collisions(keyed, index, salt_rows=2).collect()) == [0, 2]


def test_directory_splits(spark):
    groups = spark.range(1000).select(F.xxhash64("id").alias("key"))
    leaves = exact_dedup.directory(groups, 100, 6)
    per = exact_dedup.routed(groups, leaves, 6).groupBy("bucket").count().collect()
    assert len(per) > 4 and sum(r["count"] for r in per) == 1000 and max(r["count"] for r in per) <= 100
    ranges = {(r["bucket"], r["local_depth"]) for r in leaves.collect()}
    assert max(d for _, d in ranges) > 2 and all(b % (1 << 6 - d) == 0 for b, d in ranges)
    covered = sorted((b, b + (1 << 6 - d)) for b, d in ranges)  # buckets are ranges of keys that follow each other
    assert all(x[1] <= y[0] for x, y in zip(covered, covered[1:], strict=False))
    assert {r["local_depth"] for r in exact_dedup.directory(groups, 1000, 6).collect()} == {0}


def test_index_files_hold_ranges(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 300).cast("string").alias("text"))
    _, _, index = exact_dedup.build_index(docs, capacity=8)
    files = index.groupBy(F.input_file_name().alias("f")).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).orderBy("a").collect()
    assert index.select("bucket").distinct().count() > 8 and all(x["b"] < y["a"] for x, y in zip(files, files[1:], strict=False))
    got = exact_dedup.exact_dedup(docs, capacity=8).collect()
    assert all((r["keep_id"], r["group_size"]) == ((r["doc_id"] % 300) + 300, 2) if r["doc_id"] % 300 < 200 else r["group_size"] == 1 for r in got) and len(got) == 500


# ---- decontamination
def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_decontaminate(docs, items):
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            k = min(10, len(v))
            for a in range(len(v) - k + 1 if k else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[a : a + k]:
                        hit |= set(range(p, p + k))
                        found.add(item)
        out.append((str(i), len(w), len(hit), len(found), sha(",".join(sorted(str(x) for x in found if x is not None))), bool(hit)))
    return sorted(out)


def brute_near(docs, items):
    """Items without an exact window of which a window has four fifths of its words near its place, wherever its two rarest terms are nearly as far apart."""
    counts = {}
    for w in (w for _, t in docs for w in words(t)):
        counts[w] = counts.get(w, 0) + 1
    out = []
    for i, text in docs:
        w, found = words(text), set()
        exact = {item for item, t in items for v in [words(t)] for k in [min(10, len(v))] for a in range(len(v) - k + 1 if k else 0) for p in range(len(w) - k + 1) if w[p : p + k] == v[a : a + k]}
        for item, t in items:
            v = words(t)
            k = min(10, len(v))
            for a in range(len(v) - k + 1 if k else 0):
                rare = sorted((counts[v[q]], q) for q in range(a, a + k) if v[q] in counts)[:2]
                if len(rare) < 2:
                    continue
                (_, q1), (_, q2) = rare
                for shift in {x - q1 for x in range(len(w)) for y in range(len(w)) if w[x] == v[q1] and w[y] == v[q2] and abs(y - x - q2 + q1) <= 3}:
                    for p in range(len(v) - k + 1):
                        at = max(0, p + shift - 3)
                        if len(set(v[p : p + k]) & set(w[at : at + k + 6])) >= 0.8 * len(set(v[p : p + k])):
                            found.add(item)
        out.append((str(i), ",".join(sorted(str(x) for x in found - exact if x is not None))))
    return sorted(out)


def test_decontaminate(spark):
    item = prose(1, 25, 30)
    items = [(1, " ".join(item)), (2, "Short One"), (3, None), (4, ""), (10, " ".join(prose(2, 12, 30))), (1, " ".join(item)), (5, "the the the the the the the the the the the"), (None, "an item without any name"), (None, "another one")]
    docs = [(1, " ".join(item)), (2, "x " + " ".join(item[3:14]) + " y"), (3, "a short, one! SHORT one"), (4, None), (5, ""), (6, " ".join(prose(3, 300, 30))), (7, " ".join(item[10:] + item[:12])), (7, "another"), (None, " ".join(item)), (8, "the " * 40), (9, " ".join(item[:9])), (11, "an item without any name, another one, short one"), (12, "x " * 30_000 + " ".join(item))]
    got = decontaminate.decontaminate(table(spark, docs), table(spark, items, "item_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == brute_decontaminate(docs, items)
    assert decontaminate.decontaminate(empty(spark), table(spark, items, "item_id long, text string")).count() == 0
    assert not decontaminate.decontaminate(table(spark, docs), spark.createDataFrame([], "item_id long, text string")).filter("contaminated").count()


def test_proximity(spark):
    item = [f"t{i}" for i in range(12)]
    changed = lambda *at: " ".join("gone" + w if i in at else w for i, w in enumerate(item))
    docs = [(1, " ".join(item).replace("t5", "t5 extra")), (2, " ".join(item)), (3, "nothing here"), (4, changed(2, 7)), (5, changed(0, 2, 4, 6, 8)), (6, "x y " + changed(5) + " t5"), (7, " ".join(item[::-1])), (8, None), (None, changed(6))]
    items = [(1, " ".join(item)), (2, "short one"), (3, None)]
    got = decontaminate.decontaminate(table(spark, docs), table(spark, items, "item_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["near_items"]) for r in got) == brute_near(docs, items)
    assert {r["doc_id"] for r in got if r["near_items"]} >= {1, 6} and not {2, 3, 5} & {r["doc_id"] for r in got if r["near_items"]}


# ---- Jaccard join
def brute_join(docs):
    sets = {}
    for k, (i, text) in enumerate(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[k] = {tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = list(range(len(docs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        x, y = sets[a], sets[b]
        if docs[a][0] is not None and docs[b][0] is not None and ((x and y and 100 * len(x & y) >= 75 * len(x | y)) or (docs[a] == docs[b] and x)):
            parent[top(a)] = top(b)
    out = []
    for k, (i, _) in enumerate(docs):
        same = [docs[j][0] for j in range(len(docs)) if top(j) == top(k) and docs[j][0] is not None]
        out.append((str(i), len(sets[k]), str(i if i is None or not sets[k] else min(same))))
    return sorted(out)


def near_copies(seed, n, length, edits):
    rng, base = random.Random(seed), prose(seed, length)
    found = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(length)] = f"e{k}x{rng.random()}"
        found.append(" ".join(w))
    return found


@pytest.mark.parametrize("group_rows", [48, 3])
def test_join(spark, monkeypatch, group_rows):
    monkeypatch.setattr(jaccard_join, "GROUP_ROWS", group_rows)
    texts = near_copies(1, 40, 120, 9) + near_copies(2, 30, 60, 5) + [" ".join(prose(9, 60) + prose(i, 100)) for i in range(10, 40)] + ["one two", "One  TWO", "a b c d e", "x", None, "", "   "]
    docs = [(1000 - i, t) for i, t in enumerate(texts)] + [(1000, texts[0]), (None, texts[0]), (2000, "long " * 30_000)]
    got = jaccard_join.near_duplicates(table(spark, docs)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_join(docs)
    assert jaccard_join.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    ids = [rng.getrandbits(60) for _ in range(60)]
    links = [(ids[i], ids[i + 1]) for i in range(40)] + [(ids[45], ids[50]), (ids[50], ids[45])]
    comps = {r["node"]: r["comp"] for r in components.contract(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({comps[i] for i in ids[:41]}) == 1 and comps[ids[45]] == comps[ids[50]] != comps[ids[0]] and len(comps) == 43


def test_shingles_of_equal_texts_are_equal():
    bounds, hashes = shingles.shingle_sets([b"a b c d e f", b"x", b"A  b\tc d e F", b"", b"a b c d f e"])
    one = [hashes[bounds[i] : bounds[i + 1]].tolist() for i in range(5)]
    assert one[0] == one[2] and len(one[0]) == 2 and len(one[1]) == 1 and not one[3] and one[4] != one[0]


# ---- substring removal
def brute_remove(docs, window=50):
    spans = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    for (i, _), w in zip(docs, split, strict=True):
        for p in range(len(w) - window + 1):
            if i is not None:
                spans.setdefault(tuple(w[p : p + window]), []).append(i)
    out = []
    for (i, _), w in zip(docs, split, strict=True):
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and min(spans[tuple(w[p : p + window])]) < i:
                gone |= set(range(p, p + window))
        out.append((str(i), len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out)


@pytest.mark.parametrize(("hot", "listed"), [(4096, 0), (3, 1000), (3, 1)])
def test_remove(spark, hot, listed):
    passage, other = prose(1, 80), prose(2, 49)
    docs = [(i, " ".join(prose(100 + i, 60) + passage + prose(200 + i, 70))) for i in range(1, 20)] + [(30 + i, " ".join(other + prose(300 + i, 30))) for i in range(3)]
    docs += [(50, " ".join(passage)), (51, " ".join(passage[:50]).upper()), (52, None), (53, ""), (54, "a " * 5000), (55, "a " * 300), (60, docs[0][1]), (61, docs[0][1]), (61, docs[0][1]), (None, docs[0][1]), (0, "  ".join(passage[10:70]))]
    got = substring_dedup.remove_repeats(table(spark, docs), hot_segments=hot, listed_windows=listed).select("*", F.sha2("kept", 256).alias("h")).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["h"]) for r in got) == brute_remove(docs)
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def brute_lengths(indexed, of, streamed, own, window):
    """From each place of each streamed sequence, the longest match (at most a window) in a sequence of a smaller owner."""
    def common(x, y):
        return next((k for k in range(min(window, len(x), len(y))) if x[k] != y[k]), min(window, len(x), len(y)))

    return [max([common(s[i:], t[j:]) for t, e in zip(indexed, of, strict=True) if e < d for j in range(len(t))], default=0) for s, d in zip(streamed, own, strict=True) for i in range(len(s))]


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics(seed):
    rng = np.random.default_rng(seed)
    window, k = int(rng.integers(2, 9)), int(rng.integers(2, 6))
    indexed, of = [rng.integers(1, k, rng.integers(window, 30)) for _ in range(6)], rng.integers(0, 6, 6)
    streamed, own = [rng.integers(0, k, rng.integers(window, 30)) for _ in range(5)] + [indexed[0]], rng.integers(0, 7, 6)
    text = np.concatenate([np.append(s, 0) for s in indexed])
    index = fm_index.FmIndex(text, k, np.repeat(of, [len(s) + 1 for s in indexed]).astype(np.int32), window)
    ends = np.cumsum([len(s) for s in streamed])
    starts, flat = np.concatenate(([0], ends[:-1])), np.concatenate(streamed)
    want = np.array(brute_lengths(indexed, of, streamed, own, window))
    assert (index.repeated(flat, starts, ends, own, window) == (want == window)).all()
    got, _ = index.statistics(flat, starts, ends, own, window)
    for a, b in zip(starts, ends, strict=True):  # exact until a sequence is left, from its end on
        left = np.flatnonzero(got[a:b] != want[a:b]).max(initial=-1)
        assert left < 0 or ((got[a : a + left + 1] == 0).all() and left + want[a + left] < window)


def test_backward_search():
    rng = np.random.default_rng(5)
    text = np.concatenate([np.append(rng.integers(1, 4, 30), 0) for _ in range(6)])
    index = fm_index.FmIndex(text, 4, np.zeros(len(text), np.int32), 7)
    for n in (1, 3, 7):
        for at in range(len(text) - n):
            pattern = text[at : at + n]
            if 0 in pattern:
                continue
            low, high = np.array([0]), np.array([len(text)])
            for symbol in pattern[::-1]:
                low, high = index.extend(low, high, np.array([symbol]))
            assert high[0] - low[0] == sum((text[p : p + n] == pattern).all() for p in range(len(text) - n + 1))
            for k in range(1, n):  # the interval of a prefix, from that of the whole
                a, b = np.array([0]), np.array([len(text)])
                for symbol in pattern[:k][::-1]:
                    a, b = index.extend(a, b, np.array([symbol]))
                assert [x[0] for x in index.widen(low, high, np.array([k]))] == [a[0], b[0]]


def test_range_minima():
    values = np.random.default_rng(1).integers(0, 1000, 300).astype(np.int32)
    least = fm_index.RangeMin(values)
    for a in range(0, 300, 7):
        for b in range(a + 1, 301, 5):
            assert least.least(np.array([a]), np.array([b]))[0] == values[a:b].min()


# ---- licenses
def test_licenses(spark):
    docs = [(1, "Under the MIT License and the mit-license."), (2, "Apache license, general PUBLIC license"), (3, None), (4, ""), (5, "mit"), (6, "Permission is hereby granted, free of charge, to any person obtaining one copy of this software"), (7, "x " * 50_000 + "MIT License"), (8, "mit lic ense"), (8, "GNU General Public License"), (None, "BSD license")]
    got = {(str(r["doc_id"]), r["base_labels"], r["labels"], r["n_words"], r["n_base"], r["first_word"], r["last_word"]) for r in license_scan.license_scan(table(spark, docs)).collect()}
    assert got == {("1", "mit", "mit", 8, 2, 2, 6), ("2", "apache,gpl", "apache,gpl", 5, 2, 0, 2), ("3", "", "", 0, 0, None, None), ("4", "", "", 0, 0, None, None), ("5", "", "", 1, 0, None, None), ("6", "", "mit", 16, 0, None, None),
                   ("7", "mit", "mit", 50_002, 1, 50_000, 50_000), ("8", "", "", 3, 0, None, None), ("8", "gpl", "gpl", 4, 1, 1, 1), ("None", "", "bsd", 2, 0, None, None)}
    assert license_scan.license_scan(empty(spark)).count() == 0


# ---- byte-level BPE
@pytest.fixture(scope="module")
def own():
    return bpe.encoder(bpe.default_vocabulary(), bpe.default_pattern())


@pytest.fixture(scope="module")
def known():
    import tiktoken

    with open(bpe.default_vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(own, known):
    rng = random.Random(4)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "ab", "a", "  \n\t\r\x1c\x85\xa0", "éüñßœ", "中文字 ", "0123 ²½", "<|endoftext|>", "'stdmrvel ", "_-=+#!? ", "\U0001f600́‍ "]
    for alphabet in alphabets * 30:
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([1, 5, 30, 200])))
        assert own.encode(text) == known.encode_ordinary(text), text
        n, ids, data = own.round_trip(text)
        assert list(map(int, ids.split())) == known.encode_ordinary(text) and n == len(ids.split()) and data == text.encode()


def test_bpe_is_linear(own, known):
    text = "ab" * 20_000
    assert own.encode(text) == known.encode_ordinary(text)


def test_bpe_rows(spark, known):
    docs = [(1, "Hello world"), (2, None), (3, ""), (4, "é" * 9000), (1, "Hello world"), (None, "x")]
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.bpe_digests(table(spark, docs)).collect())
    assert got == sorted((str(i), len(known.encode_ordinary(t or "")), sha(" ".join(map(str, known.encode_ordinary(t or "")))), sha(t or "")) for i, t in docs)
    encoded = bpe.encode_documents(table(spark, docs))
    assert {bytes(r["data"]).decode() for r in bpe.decode_documents(encoded).collect()} == {t or "" for _, t in docs}
    assert bpe.bpe_digests(empty(spark)).count() == 0


# ---- token counts
def test_tokens_by_section(spark, known):
    docs = [(1, "src", "A first line\nand a second\n\nlast"), (2, None, None), (3, "", ""), (4, "s", "é" * 3000 + "\n" + "x y " * 2000), (1, "src", "A first line"), (None, "n", "t")]
    frame = table(spark, docs, "doc_id long, source string, text string")
    for rule in token_counts.RULES:
        rows = token_counts.count_tokens(frame, ["source", "text"], rule=rule).collect()
        total = {}
        for r in rows:
            total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
        want = {}
        for i, s, t in docs:
            text = "\n".join(x for x in (s, t) if x)
            if text:
                want[i] = want.get(i, 0) + len(known.encode_ordinary(text))
        assert total == want
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, source string, text string"), ["source", "text"]).count() == 0


def brute_sections(known, values, names, rule):
    """(field, section, start, characters, tokens, crossing) of a document: every byte is looked at."""
    filled = [(n, v) for n, v in zip(names, values, strict=True) if v]
    parts = []
    for k, (name, value) in enumerate(filled):
        whole = value + ("\n" if k < len(filled) - 1 else "")
        parts += [(name, i, x) for i, x in enumerate(re.findall(r"[^\n]*\n|[^\n]+", whole) if name == names[-1] else [whole])]
    owner = [k for k, (_, _, x) in enumerate(parts) for _ in x.encode()]
    tokens, crossing, at = [0] * len(parts), [0] * len(parts), 0
    for token in known.encode_ordinary("".join(x for _, _, x in parts)):
        n = len(known.decode_single_token_bytes(token))
        own = owner[at : at + n]
        at += n
        best = own[0] if rule == "first" else own[-1] if rule == "last" else min(set(own), key=lambda k: (-own.count(k), k))
        tokens[best] += 1
        crossing[best] += own[0] != own[-1]
    starts = [0, *itertools.accumulate(len(x) for _, _, x in parts)]
    return [(f, i, s, len(x), a, b) for (f, i, x), s, a, b in zip(parts, starts, tokens, crossing, strict=False)]


def test_every_section(spark, known):
    rng = random.Random(12)
    docs = [(i, rng.choice([None, "", "src 1", "a\nb"]), "".join(rng.choice(["a", " ", "\n", "\n\n", "é", "\U0001f600", "the ", "12", "  \n"]) for _ in range(rng.randrange(40)))) for i in range(40)]
    docs += [(50, "s", "long line " * 40_000), (51, "x", "\n" * 500), (52, None, None), (53, "only", None)]
    frame = table(spark, docs, "doc_id long, source string, text string").withColumn("field", F.lit("x")).withColumn("section", F.lit("x"))
    for rule in token_counts.RULES:
        got = {}
        for r in token_counts.count_tokens(frame, ["source", "text"], rule=rule).collect():
            got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
        want = {i: brute_sections(known, (s, t), ("source", "text"), rule) for i, s, t in docs}
        assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items() if x}


def test_allocation():
    ends, bounds = np.array([2, 6, 9]), np.array([0, 3, 9])
    assert [token_counts.allocate(ends, bounds, r)[0].tolist() for r in token_counts.RULES] == [[0, 0, 1], [0, 1, 1], [0, 1, 1]]


# ---- chats
def brute_repairs(roles):
    """(cost, rendered roles) of every repair of a conversation, by its own rules: each turn is merged into the one before at 1, or stands as any role (another than its own at 3), after an empty turn at 2 where that makes it legal."""
    after = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    found = [(0, ())]
    for role in roles:
        step = []
        for cost, done in found:
            last = done[-1] if done else None
            for new in ("system", "user", "assistant"):
                relabel = 3 * (new != role)
                if new == last:
                    step.append((cost + 1 + relabel, done))
                if new in after[last]:
                    step.append((cost + relabel, (*done, new)))
                else:
                    step += [(cost + 2 + relabel, (*done, gap, new)) for gap in after[last] if gap != "system" and new in after[gap]]
        found = step
    return found


def headers(pieces):
    return re.findall(r"<\|(system|user|assistant)\|>\n", "".join(pieces))


def legal(pieces):
    roles = headers(pieces)
    return all(b == ("assistant" if a == "user" else "user") for a, b in zip(roles, roles[1:], strict=False)) and roles[0] in ("system", "user")


def test_chats(spark):
    rng = random.Random(6)
    convs = {c: [rng.choice(["user", "assistant", "system", "tool", None]) for _ in range(rng.randrange(1, 7))] for c in range(30)}
    convs[30] = ["user", "assistant"] * 700
    rows = [(c, t, r, f"text {t}" if t % 5 else None) for c, roles in convs.items() for t, r in enumerate(roles)] + [(None, 0, "user", "x"), (31, None, "user", "a"), (31, 0, "user", "b"), (31, 0, "user", "b")]
    frame = table(spark, rows, "conv_id long, turn long, role string, text string")
    for block in (512, 3):
        got = {}
        for r in chat_format.format_chats(frame, block_turns=block).collect():
            got.setdefault(r["conv_id"], []).append(r)
        assert sum(map(len, got.values())) == len(rows)
        for c, roles in convs.items():
            own = sorted(got[c], key=lambda r: r["rank"])
            pieces = [r["piece"] for r in own]
            assert [r["turn"] for r in own] == list(range(len(roles))) and legal(pieces)
            if c < 30:
                repairs = brute_repairs(roles)
                assert own[0]["conv_cost"] == min(x for x, _ in repairs) and (own[0]["conv_cost"], tuple(headers(pieces))) in repairs
            spent = sum(2 * r["n_inserted"] + 3 * ("relabel" in r["action"]) + r["action"].startswith("merge") for r in own)
            assert spent == own[0]["conv_cost"]
            want = ""
            for r, text in zip(own, [f"text {t}" if t % 5 else "" for t in range(len(roles))], strict=True):  # the whole string, from the decisions
                if r["action"].startswith("merge"):
                    want += f"\n{text}"
                    continue
                gap = "" if not r["n_inserted"] else f"<|{'user' if r['new_role'] == 'assistant' else 'assistant'}|>\n\n<|end|>\n"
                want += ("\n<|end|>\n" if want else "") + gap + f"<|{r['new_role']}|>\n{text}"
            assert "".join(pieces) == want + "\n<|end|>\n"
        assert all(r["action"] == "keep" for r in got[30])
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chats_without_numbers(spark):
    """Very many turns without a number, or with the same one, are cut into blocks too."""
    rows = [(None, None, "user" if i % 2 else "assistant", f"{i:04}") for i in range(300)] + [(1, 7, "user", "same")] * 50 + [(2, 1, "user", "x" * 300_000)]
    frame = table(spark, rows, "conv_id long, turn long, role string, text string").withColumn("rank", F.lit("x")).withColumn("block", F.lit("x")).repartition(7)
    whole = chat_format.format_chats(frame).select("conv_id", "rank", "conv_cost", "piece")
    cut = chat_format.format_chats(frame, block_turns=4)
    assert cut.count() == len(rows) and {r["conv_cost"] for r in cut.filter("conv_id = 1").collect()} == {49.0}
    costs = lambda df: {(r["conv_id"], r["conv_cost"]) for r in df.collect()}
    assert costs(cut) == costs(whole)
    own = cut.filter("conv_id is null").orderBy("rank").collect()
    assert [r["rank"] for r in own] == list(range(300)) and legal([r["piece"] for r in own])


# ---- language
def test_language(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = language_id.train(docs)
    rows = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    odd = [(1, None), (2, ""), (3, "123 !!"), (4, "é" * 100_000), (4, "the of and"), (None, "the and of")]
    got = language_id.identify(table(spark, odd), model).collect()
    assert [r["lang_pred"] for r in got[:3]] == ["und"] * 3 and all(r["lang_pred"] in model.labels for r in got[3:]) and not got[-1]["held_out"]
    assert language_id.identify(empty(spark), model).count() == 0
    assert language_id.train(spark.createDataFrame([], DOCS)) is None and {r["lang_pred"] for r in language_id.identify(table(spark, odd), None).collect()} == {"und"}


def test_language_sample(spark):
    """A rare language is learned beside a hot one, and copies count once."""
    docs = [(i, "the river and the stone of the house " * 3, "en", "s", 1) for i in range(200)] + [(1000 + i, f"der fluss und das haus mit stein {i}", "de", "s", 1) for i in range(40)] + [(2000 + i, "la maison avec une riviere et pierre", "fr", "s", 1) for i in range(8)]
    model = language_id.train(spark.createDataFrame(docs, DOCS), documents=5, words=60)
    assert model.labels == ["de", "en", "fr"] and model.documents(["une maison et la riviere", "und das haus"])[0][0] == "fr"


def test_language_spans(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = language_id.train(docs)
    by = {r["lang"]: r["text"].split("\n")[0] for r in docs.filter("lang is not null and length(text) > 400").collect()}
    one, two = sorted(by)[:2]
    texts = [(1, f"{by[one]} {by[two]}\n12 !!\n{by[two]}"), (2, None), (3, "9"), (4, ""), (None, by[one])]
    rows = language_id.language_spans(table(spark, texts), model).collect()
    assert {r["doc_id"] for r in rows} == {1, None}
    own = sorted((r for r in rows if r["doc_id"] == 1), key=lambda r: r["start"])
    assert all(x["stop"] <= y["start"] for x, y in zip(own, own[1:], strict=False))
    text = texts[0][1]
    marks = [lang for r in own for lang in [r["lang"]] * r["n_words"]]
    assert len(marks) == len(language_id.WORD.findall(text)) and all(len(language_id.WORD.findall(text[r["start"] : r["stop"]])) == r["n_words"] and 0 < r["score"] <= 1 for r in own)
    truth = [one] * len(language_id.WORD.findall(by[one])) + [two] * 2 * len(language_id.WORD.findall(by[two]))
    assert sum(a == b for a, b in zip(marks, truth, strict=True)) > 0.8 * len(truth)
    want = [model.labels[k] for line in language_id.lines_of(text) for k in model.word_labels([line])[0].argmax(axis=1)]
    assert marks == want and language_id.language_spans(table(spark, texts), None).count() == 0


def test_forward_backward():
    rng = np.random.default_rng(0)
    emit, move, start = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    scores = {p: start[p[0]] + sum(emit[0, i, s] for i, s in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:], strict=False)) for p in itertools.product(range(3), repeat=4)}
    total = np.logaddexp.reduce(list(scores.values()))
    p, pairs, z = language_id.forward_backward(emit, np.array([4]), move, start)
    assert z == pytest.approx(total) and pairs.sum() == pytest.approx(3)
    for i, s in itertools.product(range(4), range(3)):
        assert p[0, i, s] == pytest.approx(sum(np.exp(v - total) for k, v in scores.items() if k[i] == s))


# ---- quality
def test_quality(spark):
    rng = random.Random(2)
    good = [(i, " ".join(rng.choice("alpha beta gamma delta river stone".split()) for _ in range(40)), "en", f"s{i % 3}", 200) for i in range(120)]
    bad = [(200 + i, "BUY NOW!!! " * 30 + "### $$$ " * 10, None, f"s{i % 3}", None) for i in range(60)]
    docs = spark.createDataFrame(good + bad + [(900, None, None, None, None), (901, "", "en", "s1", 0), (1, good[0][1], "en", "s1", 200)], DOCS).withColumn("kept", F.lit("x")).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in good[:90]] + [(i, 0, 0) for i, *_ in bad[:40]] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == 183 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if 90 <= r["doc_id"] < 120 or 240 <= r["doc_id"] < 260]
    assert all(r["kept"] == (r["doc_id"] < 200) for r in held)
    none = quality.quality_scores(docs, labels.limit(0)).collect()
    assert all(r["kept"] and r["score"] == 0.5 for r in none)
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_confident_pseudo_labels(spark, monkeypatch):
    """Of all documents without a label those a view is sure of, by content, copies once, whatever the partitioning."""
    import xxhash

    rng = random.Random(4)
    texts = [" ".join(rng.choice("alpha beta gamma delta river stone house".split()) for _ in range(30)) for _ in range(60)] + ["BUY NOW!!! $$$ " * (5 + i % 7) for i in range(60)]
    docs = [(i, t, "en" if i % 3 else None, f"s{i % 4}", len(t)) for i, t in enumerate(texts)] + [(500 + i, texts[0], "en", "s1", 7) for i in range(40)] + [(None, texts[1], "en", "s1", 7)]
    frame = spark.createDataFrame(docs, DOCS)
    known = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 120, 5)], "doc_id long, y int")
    text, page = quality._Logistic(1 << quality.WORD_BITS, quality.N_FORM), quality._Logistic(1 << quality.META_BITS, 1)
    row, feature, form = quality.text_view([t.encode() for t in texts])
    text.fit(row, feature, form, np.array([1.0] * 60 + [0.0] * 60), np.ones(120))
    meta = quality.meta_view([d[3] for d in docs], [d[2] for d in docs], [d[4] for d in docs])
    page.fit(*quality._meta_rows(meta[:120]), np.array([1.0] * 60 + [0.0] * 60), np.ones(120))
    views = ((text, np.array([1.0, 0.0])), (page, np.array([1.0, 0.0])))
    want = {k: {} for k in range(4)}
    labelled = set(range(0, 120, 5))
    for (i, t, *_), m in zip(docs, meta, strict=True):
        row, feature, form = quality.text_view([t.encode()])
        p = [1 / (1 + np.exp(-text.logits(row, feature, form, 1)[0])), 1 / (1 + np.exp(-quality._meta_logits(page, m[None])[0]))]
        for kind in range(4):
            if i is not None and (p[kind // 2] if kind % 2 else 1 - p[kind // 2]) >= 0.6:
                key = xxhash.xxh3_64_intdigest(feature.astype(np.uint16).tobytes() + m.tobytes()) >> 1
                want[kind][key] = min(want[kind].get(key, i), i)
    for parts in (1, 9):
        got = quality._confident(frame.repartition(parts), known, views, 0.6, 12)
        for kind in range(4):
            first = sorted(want[kind].items())[:24]  # twice as many are looked at as are handed over, as some are labelled
            assert [(r["key"], r["doc_id"]) for r in got if r["kind"] == kind] == [(k, i) for k, i in first if i not in labelled][:12]
    assert len([r for r in got if r["kind"] == 1]) > 5
