"""License scans with a positional rare-token index, in SQL expressions only.

Templates are clauses of licences. The index holds, for every template, the positions of its rarest
words by inverse document frequency, where a licence with all its clauses is a document. A file
looks up all its licence words; each hit votes for the template's start relative to the file, a
template with enough votes at one start is a candidate, and it counts if its mandatory key phrase
stands where that start puts it.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.runtime import ready, table

# The clauses of each licence as published, in lower case and without signs, each with its key phrase.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "www apache org licenses"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "required by applicable law or agreed to in writing"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "hereby granted free of charge"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included in all copies or substantial portions"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "with or without fee"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "retain the above copyright notice"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "reproduce the above copyright notice"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mozilla public license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "will the authors be held liable"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "plainly marked as such"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work", "has waived all copyright and related or neighboring rights"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", "creative commons attribution noderivatives"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "either in source code form or as a compiled binary"),
)
#: Phrases of the base labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: One word of each phrase; a text without any has no phrase.
_PHRASE_WORDS = frozenset(("cc", "public", "reserved"))

#: Anchors a template has at most, and votes at one start that make it a candidate.
ANCHORS = 8
VOTES = 2
_BREAK = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]
    key_at: int
    anchors: tuple[tuple[str, int], ...]


@cache
def index() -> tuple[tuple[str, ...], tuple[Template, ...]]:
    """Licence words by falling IDF, and the templates with their rarest words' positions."""
    texts = [(label, tuple(words.split()), tuple(key.split())) for label, words, key in TEMPLATES]
    licences: dict[str, set[str]] = {}
    for label, words, _ in texts:
        licences.setdefault(label, set()).update(words)
    df = Counter(w for words in licences.values() for w in words)
    idf = {w: math.log(len(licences) / n) for w, n in df.items()}
    made, used = [], set()
    for label, words, key in texts:
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        rank = sorted(range(len(words)), key=lambda i: (-idf[words[i]], i))[:ANCHORS]
        # The key phrase's two rarest words are always among the anchors.
        rank = sorted({*rank, *sorted(range(at, at + len(key)), key=lambda i: (-idf[words[i]], i))[:VOTES]})
        anchors = tuple((words[i], i) for i in rank)
        used |= {w for w, _ in anchors}
        made.append(Template(label, words, key, at, anchors))
    return tuple(sorted(used, key=lambda w: (-idf[w], w))), tuple(made)


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _phrase_pattern() -> str:
    joined = "|".join(f"[{_BREAK}]+".join(p.split()) for p, _ in PHRASES)
    return f"(?<![^{_BREAK}])(?i:{joined})(?![^{_BREAK}])"


def _size(parts: Column) -> Column:
    """Words among the parts between breaks; only the first and the last part can be empty."""
    ends = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - ends).cast("long")


def _count(text: Column) -> Column:
    return _size(F.split(text, f"[{_BREAK}]+"))


def _votes(templates: tuple[Template, ...]) -> Column:
    """Votes (template, start) of every hit, its place less the posting's, in order."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(templates):
        for w, i in t.anchors:
            postings.setdefault(w, []).append((k, i))
    entry = lambda w: F.array(*[F.struct(F.lit(k).alias("t"), F.lit(i).alias("p")) for k, i in postings[w]])
    index_ = F.create_map(*[x for w in postings for x in (F.lit(w), entry(w))])
    return F.sort_array(F.flatten(F.transform("hits", lambda h: F.transform(F.element_at(index_, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["p"]).alias("s"))))))


def _counted() -> Column:
    """Distinct votes with their number, from the runs of equal ones."""
    first = F.filter(F.transform("votes", lambda v, i: F.when((i == 0) | (v != F.get("votes", F.greatest(i - 1, F.lit(0)))), i)), lambda i: i.isNotNull())
    return F.transform(first, lambda i: F.struct(i.alias("i"), F.get("votes", i).alias("v")))


def _verified(templates: tuple[Template, ...]) -> Column:
    """Candidates with enough votes whose key phrase stands where the start puts it, as (template, share of anchors)."""
    numbers = lambda values: F.array(*[F.lit(v) for v in values])
    key_at, length, anchors = numbers(t.key_at for t in templates), numbers(len(t.key) for t in templates), numbers(len(t.anchors) for t in templates)
    keys = F.array(*[F.lit(" ".join(t.key)) for t in templates])
    counted = F.transform(
        "runs",
        lambda r, k: F.struct(r["v"]["t"].alias("t"), r["v"]["s"].alias("s"), (F.coalesce(F.get("runs", k + 1)["i"], F.size("votes")) - r["i"]).alias("n")),
    )

    def holds(c: Column) -> Column:
        start = c["s"] + F.get(key_at, c["t"])
        phrase = F.array_join(F.slice("w", F.greatest(start + 1, F.lit(1)), F.get(length, c["t"])), " ")
        return F.when((c["n"] >= VOTES) & (start >= 0), phrase == F.get(keys, c["t"])).otherwise(F.lit(False))

    return F.transform(F.filter(counted, holds), lambda c: F.struct(c["t"].alias("t"), F.round(c["n"] / F.get(anchors, c["t"]), 6).alias("share")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License labels of every text.

    Returns ``id``, ``n_words``, ``n_base`` (places of base phrases), ``first_word`` and ``last_word``
    (their smallest and largest start, null without one), ``base_labels``, ``labels`` (both with the
    index's own, distinct, sorted, comma-joined, empty without any) and ``score``: 0 without a
    label, 0.5 for base labels alone, up to 1 by the share of a template's anchors at one start.
    A-Z is lower-cased; words are runs of characters other than ASCII breaks. Null and empty texts
    have no words. Rows are scanned one by one: repeats give repeats, nothing is shuffled, other
    columns are not read. Texts without two licence words never reach the index.
    """
    ready(docs.sparkSession)
    words, templates = index()
    pattern = _phrase_pattern()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    # The Kelvin sign is the one letter whose lower case is ASCII; the ohm sign stands for it, in no licence word either.
    # One split of the text serves the word count and the look-up; what follows runs for few rows.
    rows = rows.withColumn("parts", F.split(F.lower(F.replace("t", F.lit("\u212a"), F.lit("\u2126"))), f"[{_BREAK}]+"))
    rows = rows.withColumn("own", F.array_intersect("parts", _strings(sorted({*words, *_PHRASE_WORDS}))))
    some_phrase = F.arrays_overlap("own", _strings(sorted(_PHRASE_WORDS)))
    rows = rows.withColumn("places", F.when(some_phrase, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("n_words", _size(F.col("parts"))).withColumn("n_base", F.size("places").cast("long"))
    some = F.col("n_base") > 0
    rows = rows.withColumn("between", F.when(some, F.split("t", pattern)))
    label = lambda x: F.coalesce(*[F.when(F.startswith(F.lower(x), F.lit(p.split()[0])), F.lit(name)) for p, name in PHRASES])
    base = F.sort_array(F.array_distinct(F.transform("places", label)))
    rows = (
        rows.withColumn("first_word", F.when(some, _count(F.get("between", F.lit(0)))))
        .withColumn("last_word", F.when(some, F.col("n_words") - _count(F.element_at("between", -1)) - _count(F.element_at("places", -1))))
        .withColumn("base", base)
    )
    licence = F.array_intersect("own", _strings(words))
    rows = rows.withColumn("licence", F.when(F.size("own") >= VOTES, licence))
    known = F.coalesce(F.size("licence") >= VOTES, F.lit(False))
    rows = rows.withColumn("w", F.when(known, F.filter("parts", lambda w: w != "")))
    placed = F.transform("w", lambda x, i: F.struct(x.alias("w"), i.alias("i")))
    rows = rows.withColumn("hits", F.filter(placed, lambda h: h["w"].isin(*words)))
    rows = rows.withColumn("votes", _votes(templates)).withColumn("runs", _counted()).withColumn("found", _verified(templates))
    labels = _strings(t.label for t in templates)
    own = F.coalesce(F.transform("found", lambda c: F.get(labels, c["t"])), F.array().cast("array<string>"))
    rows = rows.withColumn("all", F.sort_array(F.array_distinct(F.concat("base", own))))
    best = F.array_max(F.transform("found", lambda c: c["share"]))
    return rows.select(
        "id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join("all", ",").alias("labels"),
        F.when(best.isNotNull(), F.round(0.5 + best / 2, 6)).when(some, F.lit(0.5)).otherwise(F.lit(0.0)).cast("double").alias("score"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every row of ``documents``."""
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _sql() -> str:
    words, templates = index()
    text = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    hits, shares = [], []
    for k, t in enumerate(templates):
        aw, ap = text(w for w, _ in t.anchors), "[" + ", ".join(str(i) for _, i in t.anchors) + "]"
        hits.append(f"flatten(list_transform(hits, lambda i: list_transform(list_filter(range(1, {len(t.anchors) + 1}), lambda k: {aw}[k] = w[i + 1]), lambda k: i - {ap}[k]))) AS v{k}")
        shares.append(
            f"list_max(list_transform(list_filter(list_distinct(v{k}), lambda s: len(list_filter(v{k}, lambda x: x = s)) >= {VOTES} AND s + {t.key_at} >= 0"
            f" AND w[s + {t.key_at + 1}:s + {t.key_at + len(t.key)}] = {text(t.key)}), lambda s: round(len(list_filter(v{k}, lambda x: x = s)) / {len(t.anchors)}, 6)))"
        )
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    gap = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    places = " UNION ALL ".join(
        f"SELECT doc_id, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + {len(p.split())}] = {text(p.split())})) AS i, '{name}' AS label FROM d" for p, name in PHRASES
    )
    return f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{gap}'), lambda x: x <> '') AS w FROM documents),
p AS ({places}),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS base FROM p GROUP BY doc_id),
c AS (SELECT doc_id, w, list_filter({text(words)}, lambda x: list_contains(w, x)) AS chosen FROM d),
h AS (SELECT doc_id, w, list_filter(range(0, len(w)), lambda i: list_contains(chosen, w[i + 1])) AS hits FROM c WHERE len(chosen) >= {VOTES}),
v AS (SELECT doc_id, w, {", ".join(hits)} FROM h),
s AS (SELECT doc_id, [{", ".join(shares)}] AS shares FROM v),
m AS (SELECT doc_id, list_max(shares) AS best, list_filter(list_transform(range(1, {len(templates) + 1}), lambda k: CASE WHEN shares[k] IS NOT NULL THEN {text(t.label for t in templates)}[k] END), lambda x: x IS NOT NULL) AS own FROM s)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(base, ','), '') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ',') AS labels,
  CAST(CASE WHEN best IS NOT NULL THEN round(0.5 + best / 2, 6) WHEN n_base > 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score
FROM d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""


QUERIES = {"op7_licenses": op7}
SQL = {"op7_licenses": _sql()}
