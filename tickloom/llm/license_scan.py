"""License scans by a positional index of rare words, in DataFrame operations only.

Fixed templates of licence notices hold words at known places, and mandatory key phrases. The document frequency of each
word of the templates is counted over the whole table. The index lists, for the RARE words of highest inverse document
frequency of each template, and for the rarest word of each phrase, the places where they stand. A file looks up its
own words that the index lists; each listing gives a start, the word's place less the place in the template. Starts
that agree within a bucket of DRIFT words are one place: its coverage is the weight of its distinct rare words. A
template is found where the coverage reaches LEAST percent and all its key phrases, verified word by word, start there.

A phrase of the base list is found at every place: each occurrence holds the phrase's rarest word, whose listing gives
the start, and the words there are compared. All work on a text stays in its row: no text is shuffled, and a text of
any length costs a sort of its listed words.

Defined results: a null text is the empty text (0 words, no places, no labels, score 0); each row gives one row, repeated
rows equal ones, also with a null id; other columns are not read; ties between words of one frequency go to the earlier
place in the template.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import ids_and_text

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Label, notice, and the phrases of the notice that must stand in its place.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["apache license version 2 0", "except in compliance with the license"]),
    ("bsd-conditions", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from this software"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["redistribute it and or modify it", "gnu general public license as published by the free software foundation"]),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["for any purpose with or without fee is hereby granted"]),
    ("lgpl-notice", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted free of charge", "deal in the software without restriction"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"]),
]
#: Words of highest inverse document frequency that the index lists for each template.
RARE = 6
#: Starts that differ by at most half as many words share a bucket of one of two grids.
DRIFT = 32
#: Percent of the weight of a template's rare words.
LEAST = 60
_BREAK = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VOCABULARY = sorted({w for text in [*BASE, *(t for _, t, _ in TEMPLATES)] for w in text.split()})


def words_of(text: Column) -> Column:
    """Words in their own case; `_small` lowers those that matter."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _BREAK), lambda w: w != "")


def _small(word: Column) -> Column:
    return F.translate(word, _UPPER, _LOWER)


def _among(word: Column, some: list[str]) -> Column:
    """Whether the word in lower case may be one of some; lower() is fast, and also maps a few letters beyond A-Z."""
    return F.lower(word).isin(*some)


def frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows of the table, and in how many of them each word of the fixed vocabulary stands."""
    own = F.array_distinct(F.transform(F.filter("words", lambda w: _among(w, VOCABULARY)), _small))
    # one row for each word of the vocabulary, and one for all rows
    marked = docs.select(words_of(F.col("text")).alias("words")).select(F.explode(F.concat(own, F.array(F.lit("")))).alias("word"))
    found = {r["word"]: r["n"] for r in marked.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return found.get("", 0), {w: found.get(w, 0) for w in VOCABULARY}


def weight(n_rows: int, n_with: int) -> int:
    """Inverse document frequency in thousandths, at least 1."""
    return 1 + round(1000 * math.log((n_rows + 1) / (n_with + 1)))


class Index:
    """The listings, as literals: their number is fixed by the templates."""

    def __init__(self, n_rows: int, n_with: dict[str, int]) -> None:
        self.phrases = [p.split() for p in BASE]
        self.totals, self.n_keys = [], []
        self.postings: dict[str, list[tuple[int, int, int, int, int]]] = {}  # template, token, place, weight, phrase
        rank = lambda words: min(range(len(words)), key=lambda i: (n_with[words[i]], i))
        for p, words in enumerate(self.phrases):
            self._add(words[rank(words)], -1, p, rank(words), 0, p)
        for t, (_, text, keys) in enumerate(TEMPLATES):
            words = text.split()
            first = {w: i for i, w in reversed(list(enumerate(words)))}
            rare = sorted(first, key=lambda w: (n_with[w], first[w]))[:RARE]
            for token, w in enumerate(rare):
                self._add(w, t, token, first[w], weight(n_rows, n_with[w]), -1)
            for k, key in enumerate(keys):
                phrase = key.split()
                at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
                self._add(phrase[rank(phrase)], t, RARE + k, at + rank(phrase), at, len(self.phrases))
                self.phrases.append(phrase)
            self.totals.append(sum(weight(n_rows, n_with[w]) for w in rare))
            self.n_keys.append(len(keys))

    def _add(self, word: str, *listing: int) -> None:
        self.postings.setdefault(word, []).append(listing)

    def listings(self) -> str:
        """The index as an SQL literal: from each listed word to its listings."""
        row = lambda x: "named_struct('t', {}, 'token', {}, 'at', {}, 'weight', {}, 'phrase', {})".format(*x)
        return f"map({', '.join(f'{chr(39)}{w}{chr(39)}, array({chr(44).join(map(row, some))})' for w, some in self.postings.items())})"


def _literal(values: list) -> Column:
    """An array of numbers, names or lists of names, written as SQL: one call for all of it."""
    text = lambda v: f"array({', '.join(map(text, v))})" if isinstance(v, list) else f"'{v}'" if isinstance(v, str) else str(v)
    return F.expr(text(values))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places (start, phrase) of the base phrases, found (numbers of templates), coverage (0 to 1).

    Coverage is the best share of a template's weight at one place; places without all key phrases count half.
    """
    docs = ids_and_text(df, id_col, text_col)
    index = Index(*frequencies(docs))
    listed = list(index.postings)
    phrases, totals, n_keys, listings = _literal(index.phrases), _literal(index.totals), _literal(index.n_keys), F.expr(index.listings())
    nothing = F.array().cast("array<struct<t:int,token:int,at:int,weight:int,phrase:int>>")
    # the places of the file's own listed words
    at = F.array_compact(F.transform("words", lambda w, i: F.when(_among(w, listed), i)))
    every = F.flatten(F.transform("at", lambda i: F.transform(F.coalesce(F.element_at(listings, _small(F.get("words", i))), nothing), lambda x: F.struct(x["t"].alias("t"), x["token"].alias("token"), (i - x["at"]).alias("start"), x["weight"].alias("weight"), x["phrase"].alias("phrase")))))
    # a phrase stands where its words do; weight holds the place of a key phrase in its template
    begins = lambda x: F.when(x["t"] >= 0, x["start"] + x["weight"]).otherwise(x["start"])
    words_at = lambda x, phrase: F.transform(F.slice("words", F.greatest(begins(x), F.lit(0)) + 1, F.size(phrase)), _small)
    true = F.filter(every, lambda x: (x["phrase"] < 0) | ((begins(x) >= 0) & (words_at(x, F.get(phrases, x["phrase"])) == F.get(phrases, x["phrase"]))))
    marks = F.sort_array(
        F.flatten(
            F.transform(
                F.filter("true", lambda x: x["t"] >= 0),
                lambda x: F.array(
                    *(F.struct(x["t"].alias("t"), (F.shiftright(x["start"] + g * DRIFT // 2, int(math.log2(DRIFT))) * 2 + g).alias("b"), x["token"].alias("token"), F.when(x["phrase"] < 0, x["weight"]).otherwise(0).alias("weight"), (x["phrase"] >= 0).cast("int").alias("key")) for g in (0, 1))
                ),
            )
        )
    )
    last = F.struct(F.lit(1 << 20).alias("t"), F.lit(0).alias("b"), F.lit(0).alias("token"), F.lit(0).alias("weight"), F.lit(0).alias("key"))
    none = F.struct(F.lit(-1).alias("t"), F.lit(0).alias("b"), F.lit(-1).alias("token"), F.lit(0).alias("weight"), F.lit(0).alias("keys"), F.lit(0.0).alias("best"), F.array().cast("array<int>").alias("found"))

    def fold(seen: Column, x: Column) -> Column:
        same = (seen["t"] == x["t"]) & (seen["b"] == x["b"])
        again = same & (seen["token"] == x["token"])
        share = F.coalesce(seen["weight"] / F.get(totals, seen["t"]), F.lit(0.0))
        whole = seen["keys"] == F.get(n_keys, seen["t"])
        hit = ~same & whole & (seen["weight"] * 100 >= F.get(totals, seen["t"]) * LEAST)
        return F.struct(
            x["t"].alias("t"),
            x["b"].alias("b"),
            x["token"].alias("token"),
            F.when(again, seen["weight"]).when(same, seen["weight"] + x["weight"]).otherwise(x["weight"]).alias("weight"),
            F.when(again, seen["keys"]).when(same, seen["keys"] + x["key"]).otherwise(x["key"]).alias("keys"),
            F.when(same | (seen["t"] < 0), seen["best"]).otherwise(F.greatest(seen["best"], F.when(whole, share).otherwise(share / 2))).alias("best"),
            F.when((seen["t"] >= 0) & hit, F.array_union(seen["found"], F.array(seen["t"]))).otherwise(seen["found"]).alias("found"),
        )

    # each step is a column of its own, so that it is computed once
    steps = docs.select("doc_id", words_of(F.col("text")).alias("words")).withColumn("at", at).withColumn("true", true).withColumn("marks", marks)
    folded = F.aggregate(F.concat("marks", F.array(last)), none, fold)
    places = F.array_sort(F.transform(F.filter("true", lambda x: x["t"] < 0), lambda x: F.struct(x["start"].alias("start"), x["phrase"].alias("phrase"))))
    out = steps.withColumn("fold", folded).withColumn("places", places)
    return out.select("doc_id", F.size("words").cast("long").alias("n_words"), "places", F.col("fold.found").alias("found"), F.col("fold.best").alias("coverage"))


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of each row: counts, first and last place, labels and score."""
    bases, names = _literal(list(BASE.values())), _literal([n for n, _, _ in TEMPLATES])
    base = F.array_distinct(F.transform("places", lambda p: F.get(bases, p["phrase"])))
    own = F.transform("found", lambda t: F.get(names, t))
    joined = lambda x: F.array_join(F.sort_array(x), ",")
    n = F.size("places")
    return scan(df, id_col, text_col).select(
        "doc_id",
        "n_words",
        n.cast("long").alias("n_base"),
        F.when(n > 0, F.get("places", F.lit(0))["start"]).cast("long").alias("first_word"),
        F.when(n > 0, F.get("places", n - 1)["start"]).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.array_union(base, own)).alias("labels"),
        F.round(F.when(n > 0, F.lit(1.0)).otherwise(F.col("coverage")), 6).alias("score"),
    )


def _values(rows: list[tuple], names: str) -> str:
    quoted = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) v({names})"


def _oracle() -> str:
    """The same result in DuckDB: phrases are compared at every word, and all words of the text are joined."""
    keys = [(t, RARE + k, " ".join(text.split()).split(f"{key}")[0].count(" "), key) for t, (_, text, some) in enumerate(TEMPLATES) for k, key in enumerate(some)]
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM d
), n AS (SELECT count(*) AS n_rows FROM d
), template AS (SELECT * FROM {_values([(t, i, w) for t, (_, text, _) in enumerate(TEMPLATES) for i, w in enumerate(text.split())], "t, i, word")}
), freq AS (SELECT word, count(DISTINCT r) AS n_with FROM w GROUP BY 1
), rare AS (
  SELECT t, word, place, 1 + CAST(round(1000 * ln((n_rows + 1.0) / (n_with + 1.0))) AS BIGINT) AS weight, row_number() OVER (PARTITION BY t ORDER BY n_with, place) - 1 AS token
  FROM (SELECT t, word, min(template.i) AS place, coalesce(max(n_with), 0) AS n_with FROM template LEFT JOIN freq USING (word) GROUP BY 1, 2), n QUALIFY token < {RARE}
), key AS (SELECT * FROM {_values(keys, "t, token, place, phrase")}
), base AS (SELECT * FROM {_values(list(BASE.items()), "phrase, label")}
), start AS (
  SELECT w.r, w.i, phrase FROM (SELECT phrase, string_split(phrase, ' ') AS p FROM key UNION SELECT phrase, string_split(phrase, ' ') FROM base) JOIN w ON w.word = p[1] JOIN d ON d.r = w.r AND d.words[w.i + 1 : w.i + len(p)] = p
), mark AS (
  SELECT r, t, i - place AS s, token, weight, 0 AS k FROM w JOIN rare USING (word) UNION ALL SELECT r, t, i - place, token, 0, 1 FROM start JOIN key USING (phrase)
), place AS (
  SELECT r, t, b, sum(weight) AS weight, sum(k) AS n_keys FROM (SELECT DISTINCT r, t, CAST(floor((s + g * {DRIFT // 2}) / {DRIFT}.0) AS BIGINT) * 2 + g AS b, token, weight, k FROM mark, (VALUES (0), (1)) v(g)) GROUP BY ALL
), total AS (SELECT t, sum(weight) AS total, (SELECT count(*) FROM key WHERE key.t = rare.t) AS all_keys FROM rare GROUP BY t
), name AS (SELECT * FROM {_values([(t, n) for t, (n, _, _) in enumerate(TEMPLATES)], "t, label")}
), score AS (
  SELECT r, max(weight / total / CASE WHEN n_keys = all_keys THEN 1 ELSE 2 END) AS best, list(label) FILTER (n_keys = all_keys AND weight * 100 >= total * {LEAST}) AS own
  FROM place JOIN total USING (t) JOIN name USING (t) GROUP BY r
), found AS (SELECT r, count(*) AS n_base, min(i) AS a, max(i) AS z, list(label) AS labels FROM start JOIN base USING (phrase) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(labels)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(labels, own))), ','), '') AS labels,
  round(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END, 6) AS score
FROM d LEFT JOIN found USING (r) LEFT JOIN score USING (r)
"""


ORACLE = _oracle()
