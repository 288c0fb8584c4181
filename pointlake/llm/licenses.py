"""License scanning by diagonal voting, in DataFrame operations only.

Every rolling word 2-gram of every text is hashed and equi-joined with the
hashes of the license templates. A hit votes for the diagonal (document position
less template position) of its template. Phrases (base templates) must stand word
for word on one diagonal. For notices, a diagonal and its neighbours up to
``reach`` either side are merged, so that a few inserted or missing words do not
split a notice, and a span is verified where they hold ``coverage`` of the
template's words; of verified diagonals that follow each other within ``reach`` the one
with the most votes of its own stands for all. However many notices a text has, and
however close they stand, each is verified by itself.

The texts are read and split once. Templates are a table of (label, words, exact),
``default_templates`` unless given; their grams are broadcast only while they are
few (``bounded``).

Edge cases: null text is empty; texts without a word have no label, null
positions and score 0. Repeated rows keep their own result row: hits are
gathered by id and text hash, so rows of one id and text share one set of spans.
Very long texts are one row an n-gram, and only hits are gathered. Ties between
neighbouring diagonals go to the lesser one. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointlake.llm.common import bounded, cut, table

#: Runs of characters that stand between words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that must stand exactly, and their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

#: Openings and characteristic clauses of public license notices, and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", "bsd"),
    ("released under the bsd license", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gfdl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("the contents of this file are subject to the mozilla public license version 1 1", "mpl-1.1"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("the contents of this file are subject to the terms of the common development and distribution license", "cddl"),
    ("licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl", "eupl"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noderivatives 4 0 international license", "cc-by-nd"),
    ("the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide", "cc0"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "zlib"),
    ("distributed under the boost software license version 1 0", "bsl-1.0"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "bsl-1.0"),
    ("everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", "wtfpl"),
    ("this font software is licensed under the sil open font license version 1 1", "ofl"),
    ("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "postgresql"),
    ("this work may be distributed and or modified under the conditions of the latex project public license", "lppl"),
    ("this package is free software you can redistribute it and or modify it under the terms of the artistic license", "artistic"),
    ("this database is made available under the open database license", "odbl"),
    ("the software shall be used for good not evil", "json"),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    exact: bool


def default_templates() -> list[Template]:
    return [Template(label, tuple(text.split()), True) for text, label in PHRASES] + [
        Template(label, tuple(text.split()), False) for text, label in NOTICES
    ]


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z only) words of a text column; null text gives none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), lambda w: w != "")


def _grams(templates: list[Template]) -> list[tuple]:
    """(template, place, word, next word) of all templates."""
    if any(len(t.words) < 2 for t in templates):
        raise ValueError("a template has two words at least")
    return [(n, at, a, b) for n, t in enumerate(templates) for at, (a, b) in enumerate(zip(t.words, t.words[1:], strict=False))]


def diagonals(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """(row, template, diagonal, seeds, n_words, copies) of (row, words), in one pass over the texts.

    ``seeds`` are the template places of the diagonal's hits. Every row also gives one
    row without a template, with its number of words and of copies.
    """
    grams = _grams(templates)
    seeds = docs.sparkSession.createDataFrame(grams, "template int, template_at int, a string, b string")
    seeds = seeds.select(F.xxhash64("a", "b").alias("h"), "template", "template_at", "a", "b")
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    pairs = F.zip_with("words", F.expr("slice(words, 2, size(words))"), pair)
    # the last word's pair lacks its second half: it stands for the text itself
    whole = F.array(F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")))
    rows = docs.select("row", F.size("words").alias("n_words"), F.posexplode(F.when(F.size("words") > 0, pairs).otherwise(whole)).alias("doc_at", "gram"))
    rows = rows.select("row", "n_words", "doc_at", "gram.a", "gram.b").withColumn("h", F.when(F.col("b").isNotNull(), F.xxhash64("a", "b")))
    hits = rows.join(bounded(seeds, len(grams)), ["h", "a", "b"], "left").filter("template is not null or h is null")
    return hits.groupBy("row", "template", (F.col("doc_at") - F.col("template_at")).alias("diagonal")).agg(
        F.sort_array(F.collect_set("template_at")).alias("seeds"), F.max("n_words").alias("n_words"), F.count_if(F.col("h").isNull()).alias("copies")
    )


def spans(found: DataFrame, templates: list[Template], reach: int = 4, coverage: float = 0.9) -> DataFrame:
    """(row, label, exact, first_word, end_word, score) for each verified span of ``diagonals``."""
    facts = [(n, len(t.words), t.exact, t.label) for n, t in enumerate(templates)]
    known = found.sparkSession.createDataFrame(facts, "template int, words int, exact boolean, label string")
    voted = found.filter("template is not null").select("row", "template", "diagonal", "seeds").join(bounded(known, len(facts)), "template")
    exact = voted.filter("exact and size(seeds) = words - 1").select(
        "row", "label", "exact", F.col("diagonal").alias("first_word"), (F.col("diagonal") + F.col("words")).alias("end_word"), F.lit(1.0).alias("score")
    )
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    near = F.collect_list(F.struct("diagonal", "seeds")).over(along.rangeBetween(-reach, reach))
    held = lambda places: F.size(F.array_distinct(F.concat(places, F.transform(places, lambda s: s + 1))))
    merged = (
        voted.filter("not exact")
        .withColumn("near", near)
        .withColumn("score", held(F.array_distinct(F.flatten(F.transform("near", lambda d: d["seeds"])))) / F.col("words"))
        .filter(F.col("score") >= coverage)
    )
    # verified diagonals that follow each other within reach are one notice
    numbered = merged.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > reach).cast("int"), F.lit(1))).withColumn("group", F.sum("new").over(along))
    best = numbered.groupBy("row", "template", "group").agg(F.min_by(F.struct("diagonal", "near", "words", "label", "score"), F.struct(-F.size("seeds"), "diagonal")).alias("b")).select("row", "b.*")
    # a place of the template that several diagonals hold counts on the nearest one
    hits = F.flatten(F.transform("near", lambda d: F.transform(d["seeds"], lambda s: F.struct(F.abs(d["diagonal"] - F.col("diagonal")).alias("far"), d["diagonal"].alias("on"), s.alias("at")))))
    used = F.filter("hits", lambda x: ~F.exists("hits", lambda y: (y["at"] == x["at"]) & ((y["far"] < x["far"]) | ((y["far"] == x["far"]) & (y["on"] < x["on"])))))
    places = F.transform(used, lambda x: x["on"] + x["at"])
    noticed = best.withColumn("hits", hits).select(
        "row", "label", F.lit(False).alias("exact"), F.array_min(places).alias("first_word"), (F.array_max(places) + 2).alias("end_word"), "score"
    )
    return exact.unionByName(noticed)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] | None = None) -> DataFrame:
    """One row a document: (id_col, n_words, spans array) with every verified span."""
    templates = templates or default_templates()
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"))
    found = cut(diagonals(docs.select(row.alias("row"), words_of(text).alias("words")), templates))
    listed = spans(found, templates).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first_word", "end_word", "label", "exact", "score"))).alias("spans"))
    each = found.filter("template is null").select("row", F.col("n_words").cast("long").alias("n_words"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return each.join(listed, "row", "left").select(
        F.col("row.id").alias(id_col), "n_words", F.coalesce("spans", F.array().cast(listed.schema["spans"].dataType)).alias("spans")
    )


def license_digest(docs: DataFrame) -> DataFrame:
    """The registered query's rows, from the operator's spans."""
    base = F.filter("spans", lambda s: s.exact)
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s.label))), ",")
    starts = F.transform(base, lambda s: s.first_word.cast("long"))
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s.score)), F.lit(0.0)).alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(table(spark, sf_dir, "documents"))


def digest_sql(templates: list[Template] | None = None, reach: int = 4, coverage: float = 0.9) -> str:
    """DuckDB SQL for the rows of ``license_digest``."""
    templates = templates or default_templates()
    facts = ", ".join(f"({n}, '{t.label}', {len(t.words)}, {str(t.exact).lower()})" for n, t in enumerate(templates))
    seeds = ", ".join(f"({n}, {at}, '{a}', '{b}')" for n, at, a, b in _grams(templates))
    return rf"""
WITH templates(template, label, n, exact) AS (VALUES {facts}),
seeds(template, template_at, a, b) AS (VALUES {seeds}),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
),
grams AS (SELECT rid, i - 1 AS doc_at, words[i] AS a, words[i + 1] AS b FROM (SELECT rid, words, unnest(range(1, len(words))) AS i FROM docs)),
diagonals AS (
  SELECT rid, template, doc_at - template_at AS diagonal, list(DISTINCT template_at) AS places
  FROM grams JOIN seeds USING (a, b) GROUP BY ALL
),
exact_spans AS (
  SELECT rid, label, diagonal AS first_word, 1.0::DOUBLE AS score FROM diagonals JOIN templates USING (template) WHERE exact AND len(places) = n - 1
),
around AS (
  SELECT *, list_distinct(flatten(list(places) OVER (PARTITION BY rid, template ORDER BY diagonal RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING))) AS held
  FROM diagonals JOIN templates USING (template) WHERE NOT exact
),
verified AS (
  SELECT rid, label, len(list_distinct(list_concat(held, list_transform(held, lambda x: x + 1)))) / n AS score, template, diagonal, len(places) AS votes
  FROM around WHERE len(list_distinct(list_concat(held, list_transform(held, lambda x: x + 1)))) / n >= {coverage}
),
marked AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) <= {reach} THEN 0 ELSE 1 END AS fresh FROM verified
),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, template ORDER BY diagonal) AS g FROM marked),
noticed AS (SELECT rid, label, score FROM grouped QUALIFY row_number() OVER (PARTITION BY rid, template, g ORDER BY votes DESC, diagonal) = 1),
base AS (
  SELECT rid, count(*) AS n_base, min(first_word) AS first_word, max(first_word) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM exact_spans GROUP BY rid
),
every AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM (SELECT rid, label, score FROM exact_spans UNION ALL SELECT rid, label, score FROM noticed) GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN base USING (rid) LEFT JOIN every USING (rid)
"""


def plain_words(text: str | None) -> list[str]:
    """The word rule in plain Python, for tests."""
    folded = (text or "").translate(str.maketrans(UPPER, LOWER))
    return [w for w in re.split("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", folded) if w]
