"""License scan by diagonal voting.

Every run of two and of four consecutive words of a document is joined by its hash to the places
where it stands in a license template. Each match votes for a diagonal, the document position
minus the template position. Votes are added up by document, template and diagonal; those of
neighbouring diagonals are merged, so that a span survives missing and added words; and where enough places
of a template have a vote, the words of the document are compared with the template's, in order.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NON_WORD, UPPER, WORD, alnum_words, materialize, table, text_or_empty

# Phrases and texts of public licenses.
#: (label, phrase): places of these are counted as they stand, word for word.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
#: (label, notice or text): of short ones a span must hold every word, of longer ones most.
NOTICES = [
    ("agpl", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "bsd license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc", "creative commons attribution"),
    ("cc", "licensed under a creative commons license"),
    ("cc", "licensed under cc by"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("gpl", "licensed under the gnu general public license"),
    ("isc", "isc license"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "mozilla public license"),
    ("reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
#: Words of a run: of two in templates of up to so many words, of four in longer ones, as pairs such as "of the" are everywhere.
SHORT, WIDTHS = 8, (2, 4)
#: Share of a notice's runs that need a vote, share of a longer one's words that a span must hold, and how many words it may have gained or lost.
VOTES, SHARE, DRIFT = 0.4, 0.75, 2
#: Where a word is looked for, from its place on the diagonal.
NEAREST = sorted(range(-DRIFT, DRIFT + 1), key=abs)


def template_words(base=BASE, notices=NOTICES) -> list[list[str]]:
    return [re.findall(WORD, phrase.lower()) for _, phrase in [*base, *notices]]


def _width(words: list[str]) -> int:
    return WIDTHS[len(words) > SHORT]


LONGEST = max(map(len, template_words()))


def templates(spark: SparkSession, base=BASE, notices=NOTICES) -> DataFrame:
    """template, base, runs (number of them), h, place: a row per run of words of a template. A fixed list."""
    rows = []
    for number, words in enumerate(template_words(base, notices)):
        k = _width(words)
        rows += [(number, number < len(base), len(words) - k + 1, place, words[place : place + k]) for place in range(len(words) - k + 1)]
    found = spark.createDataFrame(rows, "template int, base boolean, runs int, place int, run array<string>")
    short, long = ([F.col("run")[i] for i in range(k)] for k in WIDTHS)
    return found.select("template", "base", "runs", "place", F.when(F.size("run") == WIDTHS[0], F.xxhash64(*short)).otherwise(F.xxhash64(*long)).alias("h"))


def votes(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """doc_id, row, template, base, runs, diagonal, places: the template places met, each once however often the row is repeated."""
    words = docs.select("doc_id", "row", alnum_words(F.col("text")).alias("w"))
    ahead = F.arrays_zip(F.col("w").alias("a"), *[F.expr(f"slice(w, {i + 1}, greatest(size(w) - {i}, 0))").alias(c) for i, c in ((1, "b"), (2, "c"), (3, "d"))])
    runs = words.select("doc_id", "row", F.posexplode(ahead).alias("pos", "p")).select("doc_id", "row", "pos", F.xxhash64("p.a", "p.b").alias("h2"), F.xxhash64("p.a", "p.b", "p.c", "p.d").alias("h4"))
    met = runs.select("doc_id", "row", "pos", F.explode(F.array("h2", "h4")).alias("h")).join(F.broadcast(grams), "h").withColumn("diagonal", F.col("pos") - F.col("place"))
    return met.groupBy("doc_id", "row", "template", "base", "runs", "diagonal").agg(F.collect_set("place").alias("places"))


def merged(voted: DataFrame, share: float = VOTES, drift: int = DRIFT) -> DataFrame:
    """doc_id, row, cands (array of struct template, diagonal): where a template may stand. A base phrase needs every run on one diagonal; of notices ``share`` of the runs, on diagonals at most ``drift`` away."""
    near = Window.partitionBy("doc_id", "row", "template").orderBy("diagonal").rangeBetween(-drift, drift)
    held = F.when(F.col("base"), F.size("places")).otherwise(F.size(F.array_distinct(F.flatten(F.collect_list("places").over(near)))))
    asked = F.when(F.col("base"), F.col("runs")).otherwise(share * F.col("runs"))
    kept = voted.withColumn("held", held).filter(F.col("held") >= asked)
    return kept.groupBy("doc_id", "row").agg(F.collect_set(F.struct("template", "diagonal")).alias("cands"))


def _held(words: Column, own: Column, diagonal: Column, drift: Column) -> Column:
    """first, last, n: how many of a template's words stand in the document in order, each at most ``drift`` words from its place on the diagonal, the nearest first."""
    def step(now: Column, p: Column) -> Column:
        found = F.coalesce(*[F.when((F.abs(F.lit(k)) <= drift) & (diagonal + p + k > now["last"]) & (F.get(words, diagonal + p + k) == F.get(own, p)), diagonal + p + k) for k in NEAREST])
        return F.when(found.isNull(), now).otherwise(F.struct(F.when(now["n"] == 0, found).otherwise(now["first"]).alias("first"), found.alias("last"), (now["n"] + 1).alias("n")))

    return F.aggregate(F.sequence(F.lit(0), F.size(own) - 1), F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(0).alias("n")), step)


def verified(docs: DataFrame, cands: DataFrame, base=BASE, notices=NOTICES, share: float = SHARE) -> DataFrame:
    """doc_id, row, found (array of struct template, label, base, start, end, fit): the candidates with enough of the template's words; start and end are words of the document."""
    same = [F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")), F.col("d.row") == F.col("c.row")]
    rows = docs.alias("d").join(cands.alias("c"), same).select("d.doc_id", "d.row", alnum_words(F.col("d.text")).alias("words"), "c.cands")
    known = F.from_json(F.lit(json.dumps(template_words(base, notices))), "array<array<string>>")
    labels = F.array(*[F.lit(label) for label, _ in [*base, *notices]])

    def check(c: Column) -> Column:
        own, is_base = F.get(known, c["template"]), c["template"] < len(base)
        held = _held(F.col("words"), own, c["diagonal"], F.when(is_base, 0).otherwise(DRIFT))
        return F.struct(c["template"].alias("template"), F.get(labels, c["template"]).alias("label"), is_base.alias("base"), held.alias("held"), F.size(own).alias("m"))

    found = F.filter(F.transform("cands", check), lambda x: x["held"]["n"] >= F.when(x["base"] | (x["m"] <= SHORT), x["m"]).otherwise(share * x["m"]))
    found = F.transform(found, lambda x: F.struct(x["template"].alias("template"), x["label"].alias("label"), x["base"].alias("base"), x["held"]["first"].alias("start"), x["held"]["last"].alias("end"), (x["held"]["n"] / x["m"]).alias("fit")))
    return rows.select("doc_id", "row", found.alias("found")).filter("size(found) > 0")


def spans(found: DataFrame) -> DataFrame:
    """doc_id, row, template, label, base, start, end, fit: the verified spans. Of spans of one template that overlap the best stays: most words, then shortest, then first."""
    rows = found.select("doc_id", "row", F.explode("found").alias("f")).select("doc_id", "row", "f.*").distinct()
    rows = rows.withColumn("worth", F.struct(-F.col("fit"), F.col("end") - F.col("start"), F.col("start"), F.col("end").alias("e"), F.col("start").alias("s")))
    around = Window.partitionBy("doc_id", "row", "template").orderBy("start").rangeBetween(-LONGEST - DRIFT, LONGEST + DRIFT)
    rows = rows.withColumn("near", F.collect_list("worth").over(around)).withColumn("near", F.filter("near", lambda x: (x["s"] <= F.col("end")) & (x["e"] >= F.col("start"))))
    return rows.filter(F.array_min("near") == F.col("worth")).drop("near", "worth")


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row (the same for rows that are the same), text."""
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("row"), text.alias("text"))


def found_licenses(corpus: DataFrame) -> DataFrame:
    """verified() of numbered() rows, each once."""
    cands = materialize(merged(votes(corpus, templates(corpus.sparkSession))), "license-candidates")
    return materialize(verified(corpus, cands).dropDuplicates(["doc_id", "row"]), "license-spans")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words and no labels. Repeated rows are judged each; null ids are
    kept. Of equally good spans each counts. score is the best fit of a span (the share of the template's
    words that it holds), 0 without one. Only the named columns are looked at.
    """
    corpus = numbered(docs, id_col, text_col)
    per = found_licenses(corpus)
    places = F.array_distinct(F.transform(F.filter("found", lambda x: x["base"]), lambda x: F.struct(x["template"], x["start"])))
    starts = F.transform(F.filter("found", lambda x: x["base"]), lambda x: x["start"])
    joined = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda x: x["label"]))), ",")
    per = per.select(
        "doc_id", "row", F.size(places).alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(F.filter("found", lambda x: x["base"])).alias("base_labels"), joined(F.col("found")).alias("labels"), F.array_max(F.transform("found", lambda x: x["fit"])).alias("score"),
    )
    all_docs = corpus.select("doc_id", "row", F.size(alnum_words(F.col("text"))).cast("long").alias("n_words"))
    same = [F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")), F.col("d.row") == F.col("p.row")]
    return all_docs.alias("d").join(per.alias("p"), same, "left").select(
        "d.doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _values() -> str:
    rows = []
    for number, ((label, _), words) in enumerate(zip([*BASE, *NOTICES], template_words(), strict=True)):
        rows.append(f"({number}, '{label}', {number < len(BASE)}, {_width(words)}, {words})")
    return ", ".join(rows)


# Base phrases are found as text; notices by comparing words one after the other from every place where a run of theirs stands.
SQL = f"""
WITH RECURSIVE t(template, label, base, k, tw) AS (VALUES {_values()}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{NON_WORD}'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT r, label, i - 1 AS s FROM (SELECT r, w, label, tw, unnest(range(1, CAST(greatest(len(w) - len(tw) + 2, 1) AS BIGINT))) AS i FROM d, t WHERE base AND list_has_all(w, tw)) WHERE w[i:i + len(tw) - 1] = tw),
g AS (SELECT template, k, len(tw) - k + 1 AS runs, p - 1 AS place, array_to_string(tw[p:p + k - 1], ' ') AS x FROM (SELECT *, unnest(range(1, CAST(len(tw) - k + 2 AS BIGINT))) AS p FROM t WHERE NOT base)),
v AS (SELECT DISTINCT r, template, runs, place, i - 1 - place AS diagonal FROM (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS x FROM (SELECT r, w, k, unnest(range(1, CAST(greatest(len(w) - k + 2, 1) AS BIGINT))) AS i FROM d, (VALUES (2), (4)) AS ks(k))) JOIN g USING (k, x)),
c AS (SELECT a.r, a.template, a.diagonal FROM (SELECT DISTINCT r, template, runs, diagonal FROM v) a JOIN v z ON z.r = a.r AND z.template = a.template AND abs(z.diagonal - a.diagonal) <= {DRIFT} GROUP BY a.r, a.template, a.diagonal, a.runs HAVING count(DISTINCT z.place) >= {VOTES} * a.runs),
s AS (SELECT c.r, c.template, diagonal, 0::BIGINT AS p, -1::BIGINT AS last, 0::BIGINT AS n, w, tw FROM c JOIN d USING (r) JOIN t USING (template)
  UNION ALL SELECT r, template, diagonal, p + 1, coalesce(x, last), n + (x IS NOT NULL)::INT, w, tw FROM (SELECT *, list_filter([{', '.join(f'diagonal + p + {k}' for k in NEAREST)}], lambda y: y > last AND y >= 0 AND y < len(w) AND w[y + 1] = tw[p + 1])[1] AS x FROM s WHERE p < len(tw))),
f AS (SELECT r, label, n::DOUBLE / len(tw) AS fit FROM s JOIN t USING (template, tw) WHERE p = len(tw) AND n >= CASE WHEN len(tw) > {SHORT} THEN {SHARE} ELSE 1 END * len(tw)),
o AS (SELECT r, label, 1.0::DOUBLE AS fit, s, label AS base FROM b UNION ALL SELECT r, label, fit, NULL, NULL FROM f),
a AS (SELECT r, count(s) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT base, ',' ORDER BY base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(fit) AS score FROM o GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN a USING (r)
"""

QUERIES = {"op2_license_scan": op2_license_scan}
ORACLES = {"op2_license_scan": SQL}
