"""Licence scans: an exact set-similarity join of text blocks with notice templates.

A block is every run of as many words as a template has, wherever lines end, so a
wrapped notice is found like any other. One scan splits the texts and keeps of each the
places of words that templates or base phrases use; all else works on those places.
Words are ordered by how many documents hold them, rarest first, counted over the whole
corpus. A block that holds at least ``threshold`` of a template's distinct words must
hold one of the first n - ceil(threshold n) + 1 in that order (prefix filter); a text
meets a template at the first word in the order that both have, and goes on only if that
word leaves enough of the template behind it (positional filter) and the text holds
enough of its words at all (length filter). What is left is verified exactly, window by
window. Base phrases are places whose next words stand at the next places.

Only DataFrame operations run here.

Cases: a null or empty text has no words and no labels, score 0; repeated rows are rows
of their own (a number made with the first scan names them), as are rows without an id;
long texts and lines are scanned whole; of several windows the best counts, so ties
decide nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import keep, lower_ascii

#: What separates words: ASCII but digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# fixed values: the base phrases and their labels
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# fixed values: notices of common licences, as labels and texts
TEMPLATES = [
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "licensed under the gnu affero general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("public-domain", "this work has been dedicated to the public domain"),
    ("reserved", "copyright all rights reserved"),
    ("reserved", "no part of this publication may be reproduced or transmitted in any form without prior written permission of the publisher"),
]
THRESHOLD = 0.8


def places_of(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[str]) -> DataFrame:
    """``row, doc_id, n_words`` and of the words in ``vocabulary`` the places ``at``
    (words from 0) and the words ``w`` themselves, in text order."""
    text = lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    # pieces between separators: only the first and the last one can be empty
    df = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.split(text, SEPARATORS).alias("ws"))
    lead = (F.get("ws", F.lit(0)) == "").cast("int")
    trail = ((F.size("ws") > 1) & (F.element_at("ws", -1) == "")).cast("int")
    held = lambda w: w.isin(vocabulary)
    return df.select(
        "row", "doc_id", (F.size("ws") - lead - trail).cast("long").alias("n_words"),
        F.array_compact(F.transform("ws", lambda w, i: F.when(held(w), i))).alias("raw"), F.filter("ws", held).alias("w"), lead.alias("lead"),
    ).select("row", "doc_id", "n_words", F.transform("raw", lambda i: i - F.col("lead")).alias("at"), "w")


def phrase_places(phrase: str) -> Column:
    """Places where a phrase's words stand one after another; looked for only in texts
    that hold all of them."""
    parts = phrase.split(" ")
    w, at = (lambda i, k: F.get(F.col("w"), i + k)), (lambda i, k: F.get(F.col("at"), i + k))
    here = lambda i: reduce(lambda a, b: a & b, [(w(i, k) == x) & (at(i, k) == at(i, 0) + k) for k, x in enumerate(parts)])
    starts = F.filter(F.sequence(F.lit(0), F.size("w") - 1), here)
    some = reduce(lambda a, b: a & b, [F.array_contains("w", x) for x in parts])
    return F.when(some, F.transform(starts, lambda i: F.get(F.col("at"), i))).otherwise(F.array().cast("array<int>"))


def block_matches(placed: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """``row, template, containment`` of every text with a block that meets the threshold;
    the best block counts."""
    spark = placed.sparkSession
    sets = [sorted(set(t.split())) for _, t in templates]
    # in how many documents each template word stands: at most one row for each
    seen = {r["w"]: r["count"] for r in placed.select(F.explode(F.array_distinct("w")).alias("w")).groupBy("w").count().collect()}
    rank = {w: i for i, w in enumerate(sorted({w for s in sets for w in s}, key=lambda w: (seen.get(w, 0), w)))}
    ordered = [sorted(s, key=rank.get) for s in sets]
    entry = lambda t, o, need, k, w: F.struct(
        F.lit(w).alias("word"), F.lit(t).alias("template"), F.lit(k).alias("t_pos"), F.lit(need).alias("need"),
        F.lit(len(templates[t][1].split())).alias("length"), F.array(*map(F.lit, o)).alias("held"),
    )
    need = [ceil(threshold * len(o) - 1e-9) for o in ordered]
    prefixes = [(t, o, n, k, w) for t, (o, n) in enumerate(zip(ordered, need)) for k, w in enumerate(o[: len(o) - n + 1])]
    index = F.broadcast(spark.range(1).select(F.inline(F.array(*[entry(*x) for x in prefixes]))))  # a row for each prefix word of fixed templates
    starts = F.array(*map(F.lit, sorted({x[-1] for x in prefixes})))
    texts = placed.select("row", "at", "w", F.array_distinct("w").alias("present"))
    met = texts.withColumn("word", F.explode(F.array_intersect(starts, "present"))).join(index, "word")
    both = F.array_intersect("held", "present")
    met = met.where((F.get(both, F.lit(0)) == F.col("word")) & (F.size("held") - F.col("t_pos") >= F.col("need")) & (F.size(both) >= F.col("need")))
    hits = F.filter(F.arrays_zip("at", "w"), lambda x: F.array_contains("held", x["w"]))
    length, need = F.col("length"), F.col("need")

    def best(h: Column) -> Column:
        at = lambda i: F.get(h, i)["at"]
        # the best block can begin at a template word; too few such words in its reach: no block
        begins = F.filter(F.sequence(F.lit(0), F.size(h) - need), lambda i: at(i + need - 1) - at(i) < length)
        block = lambda i: F.filter(F.slice(h, i + 1, length), lambda x: x["at"] - at(i) < length)
        return F.array_max(F.transform(begins, lambda i: F.size(F.array_distinct(F.transform(block(i), lambda x: x["w"])))))

    # places of a text are worked out once, however many blocks it has
    most = let(hits, best)
    pairs = met.select("row", "template", (most / F.size("held")).alias("containment"), (need / F.size("held")).alias("least"))
    return pairs.where(F.col("containment") >= F.col("least")).select("row", "template", "containment")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, base: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document. ``score`` is 1 where a base phrase stands, else the largest
    containment of a template in one of its blocks (0 where none meets the threshold)."""
    templates, base = templates or TEMPLATES, base or BASE
    vocabulary = sorted({w for _, t in templates for w in t.split()} | {w for p in base for w in p.split()})
    placed = keep(places_of(docs, id_col, text_col, vocabulary), "license-places")
    named = F.array(*[F.lit(label) for label, _ in templates])
    matched = block_matches(placed, templates, threshold).groupBy("row").agg(F.collect_set(F.get(named, F.col("template"))).alias("more"), F.max("containment").alias("best"))
    scanned = placed.select("row", "doc_id", "n_words", *[phrase_places(p).alias(f"p{i}") for i, p in enumerate(base)])
    every = [F.col(f"p{i}") for i in range(len(base))]
    labels = F.array_compact(F.array(*[F.when(F.size(x) > 0, F.lit(label)) for x, label in zip(every, base.values())]))
    scanned = scanned.select("row", "doc_id", "n_words", F.concat(*every).alias("places"), labels.alias("found"))
    joined = scanned.join(matched, "row", "left")
    text_of = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return joined.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"), text_of(F.col("found")).alias("base_labels"),
        text_of(F.concat("found", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def duckdb_sql(templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> str:
    """The same result by comparing every block with every template."""
    templates = templates or TEMPLATES
    rows = ", ".join(f"({i}, '{label}', {sorted(set(t.split()))}, {ceil(threshold * len(set(t.split())) - 1e-9)}, {len(t.split())})" for i, (label, t) in enumerate(templates))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrase = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS i, '{label}' AS label FROM spots WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) for p, label in BASE.items()
    )
    return f"""
WITH d AS (SELECT doc_id, {low} AS t FROM documents),
ws AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS w FROM d),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM ws),
hit AS ({phrase}),
base AS (SELECT doc_id, count(*) AS n, min(i) AS f, max(i) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hit GROUP BY 1),
tpl(t, label, words, need, length) AS (VALUES {rows}),
near AS (SELECT doc_id, t, label, need, length, len(words) AS n, i, w[i] AS x FROM spots, tpl WHERE list_contains(words, w[i])),
meets AS (SELECT a.doc_id, a.label, count(DISTINCT b.x) / any_value(a.n)::DOUBLE AS s FROM near a JOIN near b ON a.doc_id = b.doc_id AND a.t = b.t AND b.i >= a.i AND b.i < a.i + a.length
  GROUP BY a.doc_id, a.t, a.label, a.i, a.need HAVING count(DISTINCT b.x) >= a.need),
every AS (SELECT doc_id, label FROM hit UNION SELECT doc_id, label FROM meets),
names AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY 1),
best AS (SELECT doc_id, max(s) AS s FROM meets GROUP BY 1)
SELECT ws.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word,
  coalesce(base.labels, '') AS base_labels, coalesce(names.labels, '') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(s, 0.0) END::DOUBLE AS score
FROM ws LEFT JOIN base USING (doc_id) LEFT JOIN names USING (doc_id) LEFT JOIN best USING (doc_id)"""
