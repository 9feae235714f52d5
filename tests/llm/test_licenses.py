"""License scan against a brute-force version, on repeated rows, adjacent notices, half phrases and whole texts."""

import random
import re

from tessera.llm import license_scan as L

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def scan(spark, docs):
    return L.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()


def brute(text):
    """(n_words, n_base, first, last, base labels, labels, score): every alignment of every template is tried."""
    w = re.findall(L.WORD, (text or "").translate(LOWER))
    base, found = [], []
    for number, (label, phrase) in enumerate([*L.BASE, *L.NOTICES]):
        t = re.findall(L.WORD, phrase.lower())
        if number < len(L.BASE):
            base += [(label, s) for s in range(len(w) - len(t) + 1) if w[s : s + len(t)] == t]
            continue
        k = 4 if len(t) > 8 else 2
        for d in range(-len(t), len(w)):
            met = lambda x, p, k=k, t=t: x >= 0 and w[x : x + k] == t[p : p + k]
            own = any(met(d + p, p) for p in range(len(t) - k + 1))
            near = sum(any(met(d + p + q, p) for q in range(-2, 3)) for p in range(len(t) - k + 1))
            if not own or near < 0.4 * (len(t) - k + 1):
                continue
            last, n = -1, 0
            for p, word in enumerate(t):
                x = next((x for x in (d + p, d + p - 1, d + p + 1, d + p - 2, d + p + 2) if last < x < len(w) and x >= 0 and w[x] == word), None)
                if x is not None:
                    last, n = x, n + 1
            if n >= (0.75 if len(t) > 8 else 1) * len(t):
                found.append((label, n / len(t)))
    places = [s for _, s in base]
    return len(w), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for x, _ in base})), ",".join(sorted({x for x, _ in base + found})), max([1.0] * bool(base) + [f for _, f in found], default=0.0)


def test_identical_rows_are_judged_each(spark):
    got = scan(spark, [(1, "Under the MIT License")] * 2 + [(2, "the general public")] * 2 + [(3, "permission is hereby granted free of charge")] * 2)
    assert sorted((r["doc_id"], r["base_labels"], r["labels"], r["n_base"], r["first_word"], r["last_word"], r["score"]) for r in got) == [(1, "mit", "mit", 1, 2, 2, 1.0)] * 2 + [(2, "", "", 0, None, None, 0.0)] * 2 + [(3, "", "", 0, None, None, 0.0)] * 2


def test_adjacent_notices(spark):
    texts = ["BSD license " * 3, "BSD license " * 500, "all rights all rights all rights reserved", "x " * 40 + "ISC license ISC license ISC license", "creative commons creative commons", "license bsd", "all rights all rights", "gnu affero gnu affero gnu affero"]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in scan(spark, list(enumerate(texts)))}
    assert got == {0: ("bsd", 1.0), 1: ("bsd", 1.0), 2: ("reserved", 1.0), 3: ("isc", 1.0), 4: ("", 0.0), 5: ("", 0.0), 6: ("", 0.0), 7: ("", 0.0)}


def test_adjacent_spans_stand_each(spark):
    docs = L.numbered(spark.createDataFrame([(1, "BSD license " * 4)], "doc_id long, text string"), "doc_id", "text")
    assert sorted((r["start"], r["end"], r["fit"]) for r in L.spans(L.found_licenses(docs)).collect()) == [(0, 1, 1.0), (2, 3, 1.0), (4, 5, 1.0), (6, 7, 1.0)]


def test_brute_force(spark):
    rng = random.Random(8)
    pool = [p for _, p in [*L.BASE, *L.NOTICES]]
    texts = [None, "", "mit", "é mit-license É"]
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 4)):
            own = rng.choice(pool).split()
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = [rng.choice(["x", "the", "of", "License", "software"])] * rng.randrange(3)
                own = own or ["y"]
            words += own[rng.randrange(max(1, len(own) // 3)) :] + ["filler"] * rng.randrange(3)
        texts.append(" ".join(words))
    got = scan(spark, list(enumerate(texts)))
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {i: brute(t) for i, t in enumerate(texts)}
    assert sum(r["score"] > 0 for r in got) > 20
