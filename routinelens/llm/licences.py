"""License scans by a positional rare-token index, in DataFrame operations only.

Templates are word sequences with the positions of their words; ``STOP`` words keep their position but are not
indexed. A template matches at a start if at least ``SHARE`` of its indexed words stand at their relative
positions there and all words of its mandatory key phrases do. A match lacks at most n - m of a template's n words
(m = ceil(SHARE * n)), so it holds one of the template's n - m + 1 words of highest IDF over all documents: only a file's
words among these are looked up, each posting gives a (template, start) by relative position, and only the starts found
are verified, by looking at the words that stand at the template's relative positions. Starts that the rare words do not point to are
never looked at, and the selection by IDF loses none.

The base phrases are templates whose every word is mandatory; each of their places is a match, and the rarest word of each finds it.

Defined results: a null or empty text has no words and score 0. The score is the largest share of a matched template.
Repeated rows give repeated results, and equal IDFs are settled by position. Columns other than the id and the text are not read, so
their names cannot clash. Whole texts are read once; what is kept of a text is the codes of its words, in the row that held it, and
verifying takes time in proportion to its rare words, however long it is. No documents give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routinelens.storage import materialise

SHARE = 0.8
#: Words in upper case are matched too, so the pattern of lower-case text gains A-Z.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The phrases of the base labels.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Words of licence texts (label, template, mandatory key phrase), short notices first, then whole grants.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "associated documentation files"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "except in compliance"),
    ("apache", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "without fee is hereby granted"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "creative commons attribution 4 0 international", "creative commons attribution"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is "
        "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or "
        "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "to deal in the software without restriction",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright "
        "notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution",
        "retain the above copyright notice",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "the author disclaims all warranties",
    ),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "unless required by applicable law",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your "
        "option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        "free software foundation",
    ),
    (
        "unlicense",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "commercial or non commercial",
    ),
)
#: Frequent words that are not indexed.
STOP = frozenset("a an and any are by can for in into is it may not of or the this to under use with you".split())

_SHIFT, _BIAS = 1 << 40, 1 << 10


class Index:
    """The postings of all templates; sizes follow from the fixed values above."""

    def __init__(self) -> None:
        texts = [(label, phrase, phrase) for label, phrase in BASE] + list(TEMPLATES)
        self.labels = [t[0] for t in texts]
        self.words: list[list[tuple[int, str]]] = []
        self.mandatory: list[set[int]] = []
        for _, text, key in texts:
            w, k = text.split(), key.split()
            at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
            kept = [(i, x) for i, x in enumerate(w) if x not in STOP]
            self.words.append(kept)
            self.mandatory.append({i for i, _ in kept if at <= i < at + len(k)})
        self.vocabulary = sorted({x for kept in self.words for _, x in kept})
        self.code = {x: i for i, x in enumerate(self.vocabulary)}
        self.need = [len(kept) if t < len(BASE) else math.ceil(SHARE * len(kept) - 1e-9) for t, kept in enumerate(self.words)]

    def postings(self, chosen: list[set[int]]) -> Column:
        """By word code, the (template, position) pairs of the chosen positions as template * _SHIFT - position."""
        by: list[list[int]] = [[] for _ in self.vocabulary]
        for t, kept in enumerate(self.words):
            for i, x in kept:
                if i in chosen[t]:
                    by[self.code[x]].append(t * _SHIFT + _BIAS - i)
        return F.array(*[F.array(*map(F.lit, p)).cast("array<bigint>") for p in by])

    def templates(self) -> Column:
        """By template, the codes and positions of its indexed words and whether each is mandatory."""
        word = lambda t, i, x: F.struct(F.lit(i).alias("at"), F.lit(self.code[x]).alias("code"), F.lit(i in self.mandatory[t]).alias("must"))
        return F.array(*[F.array(*[word(t, i, x) for i, x in kept]) for t, kept in enumerate(self.words)])

    def rare(self, idf: dict[int, float]) -> list[set[int]]:
        """Of each template the positions of its n - m + 1 words of highest IDF."""
        out = []
        for kept, m in zip(self.words, self.need):
            ranked = sorted(kept, key=lambda w: (-idf.get(self.code[w[1]], math.inf), w))
            out.append({i for i, _ in ranked[: len(kept) - m + 1]})
        return out


def word_codes(docs: DataFrame, index: Index, id_col: str, text_col: str) -> DataFrame:
    """Per row, written once: id, n_words and codes, the code of each word, -1 of a word of no template; null if there is none but these."""
    words = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0)).alias("words"))
    numbers = F.create_map(*[x for w, c in index.code.items() for x in (F.lit(w), F.lit(c))])
    # a letter outside ASCII may have a lower case inside it, which the contract's A-Z does not
    known = lambda w: F.lower(w).isin(index.vocabulary) & (F.octet_length(w) == F.length(w))
    codes = F.when(F.exists("words", known), F.transform("words", lambda w: F.when(known(w), F.element_at(numbers, F.lower(w))).otherwise(F.lit(-1))))
    return materialise(words.select("id", F.size("words").cast("long").alias("n_words"), codes.alias("codes")), "licence-words")


def inverse_frequencies(found: DataFrame) -> dict[int, float]:
    """IDF by word code, over all documents; at most one row a template word is collected."""
    total = found.count()
    seen = found.filter("codes is not null").select(F.explode(F.array_distinct("codes")).alias("code")).filter("code >= 0").groupBy("code").count().collect()
    return {r["code"]: math.log((total + 1) / (r["count"] + 1)) for r in seen}


def _template(key: Column) -> Column:
    return F.floor(key / _SHIFT).cast("int")


def _start(key: Column) -> Column:
    return (key - _template(key).cast("long") * _SHIFT - _BIAS).cast("int")


def looked_up(found: DataFrame, index: Index, rare: list[set[int]]) -> DataFrame:
    """Adds looked: the (template, start) keys, each once and sorted, that the rare words of a row point to."""
    codes = sorted({index.code[x] for t, kept in enumerate(index.words) for i, x in kept if i in rare[t]})
    postings = index.postings(rare)
    i = F.when(F.size("codes") > 0, F.sequence(F.lit(0), F.size("codes") - 1))
    places = F.filter(i, lambda k: F.get("codes", k).isin(codes))
    keys = F.flatten(F.transform(places, lambda k: F.transform(F.get(postings, F.get("codes", k)), lambda p: p + k)))
    return found.withColumn("looked", F.coalesce(F.array_sort(F.array_distinct(keys)), F.array().cast("array<bigint>")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score and n_looked, the starts that were verified."""
    index = Index()
    found = word_codes(docs, index, id_col, text_col)
    found = looked_up(found, index, index.rare(inverse_frequencies(found)))
    ints = lambda values: F.array(*map(F.lit, values))
    templates, need, sizes = index.templates(), ints(index.need), ints([len(kept) for kept in index.words])

    def there(key, w):
        at = _start(key) + w["at"]
        return F.coalesce((at >= 0) & (F.get("codes", at) == w["code"]), F.lit(False))

    def verified(key):
        words = F.get(templates, _template(key))
        hits = F.size(F.filter(words, lambda w: there(key, w)))
        whole = F.forall(words, lambda w: ~w["must"] | there(key, w))
        return F.struct(key.alias("key"), F.when(whole, hits).otherwise(F.lit(0)).alias("hits"))

    tried = found.withColumn("matches", F.filter(F.transform("looked", verified), lambda m: m["hits"] >= F.get(need, _template(m["key"]))))
    names = F.array(*map(F.lit, index.labels))
    base = F.filter("matches", lambda m: _template(m["key"]) < len(BASE))
    place = F.transform(base, lambda m: _start(m["key"]).cast("long"))
    label = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: F.get(names, _template(m["key"]))))), ",")
    share = F.transform("matches", lambda m: m["hits"] / F.get(sizes, _template(m["key"])))
    return tried.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(place).alias("first_word"),
        F.array_max(place).alias("last_word"),
        label(base).alias("base_labels"),
        label(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(share), F.lit(0.0)).alias("score"),
        F.size("looked").cast("long").alias("n_looked"),
    )


def oracle() -> str:
    """The same rows in SQL, without the index: all starts of all postings are counted."""
    index = Index()
    postings = [(t, i, x, i in index.mandatory[t]) for t, kept in enumerate(index.words) for i, x in kept]
    values = ", ".join(f"({t}, {i}, '{x}', {m})" for t, i, x, m in postings)
    kinds = ", ".join(f"({t}, '{index.labels[t]}', {len(index.words[t])}, {index.need[t]}, {len(index.mandatory[t])}, {t < len(BASE)})" for t in range(len(index.words)))
    return rf"""
        WITH p(t, rel, w, must) AS (VALUES {values}),
        k(t, label, size, need, n_must, base) AS (VALUES {kinds}),
        d AS (SELECT doc_id, row_number() OVER () AS r,
                     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        u AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM d),
        m AS (SELECT r, p.t, pos - rel AS start, count(*) AS n, count(*) FILTER (must) AS n_m
              FROM u JOIN p USING (w) GROUP BY ALL),
        f AS (SELECT r, start, label, base, n / size AS share FROM m JOIN k USING (t) WHERE n >= need AND n_m = n_must),
        a AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
                     string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
                     string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM f GROUP BY r)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
        FROM d LEFT JOIN a USING (r)"""
