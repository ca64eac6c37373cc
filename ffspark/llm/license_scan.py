"""Licence scans: an exact set-similarity join of text blocks with licence templates, in built-in functions only.

Base finds are places where the words of a fixed phrase stand consecutively. The method finds, for every template, every
block whose words contain at least ``PERCENT`` of the template's distinct words. Template words are ordered by their
number of documents, rarest first; a pair is made only on a word of the template's prefix that also lies in the block's
prefix, must pass the length and positional filters, and is then compared in full.

A block is a window of words. Templates up to ``SHORT`` words are looked for within lines, longer ones within the whole
text, so that they may be wrapped; windows have twice as many words as the longest template of their class and start at
every such length, so every passage of a template's length lies inside one.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ffspark.llm.shared import fold_ascii, lookup, materialise
from ffspark.llm.spans import let, running_starts

#: Everything but digits, a-z and characters beyond ASCII; texts are folded first.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrase and label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


class Template(NamedTuple):
    label: str
    text: str


#: Notices by which common licences are given, as words.
TEMPLATES = (
    Template("agpl", "licensed under the gnu affero general public license version 3"),
    Template("all-rights-reserved", "all rights reserved"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("lgpl", "licensed under the gnu lesser general public license version 2 1"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)
PERCENT = 95
SHORT = 16


def needed(size: int, percent: int = PERCENT) -> int:
    """The least number of shared words that contain ``percent`` of a template of ``size`` words."""
    return -(-percent * size // 100)


def words_of(folded: Column) -> Column:
    return F.filter(F.split(folded, GAP, -1), lambda w: w != "")


def _classes(templates: tuple[Template, ...]) -> dict[str, int]:
    """The window step of each class of templates: its longest template's number of words."""
    sizes = {"line": [], "text": []}
    for t in templates:
        n = len(t.text.split())
        sizes["line" if n <= SHORT else "text"].append(n)
    return {name: max(found) for name, found in sizes.items() if found}


def template_words(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.text.split()})


def word_order(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text_col: str = "text") -> list[str]:
    """The templates' words, those in the fewest documents first (ties by the word). Only these words, whose number the
    templates fix, are counted and reach the driver."""
    vocabulary = template_words(templates)
    words = words_of(fold_ascii(F.coalesce(F.col(text_col), F.lit(""))))
    found = docs.select(F.explode(F.array_intersect(words, F.lit(vocabulary))).alias("w")).groupBy("w").count().collect()
    count = dict.fromkeys(vocabulary, 0) | {r.w: r["count"] for r in found}
    return sorted(vocabulary, key=lambda w: (count[w], w))


def _index(templates: tuple[Template, ...], order: list[str], percent: int) -> list[tuple]:
    """The prefixes: (scope, word, template, label, place of the word, all words in order, shared words needed)."""
    rank, out = {w: k for k, w in enumerate(order)}, []
    for k, t in enumerate(templates):
        words = sorted(set(t.text.split()), key=rank.get)
        need = needed(len(words), percent)
        scope = "line" if len(t.text.split()) <= SHORT else "text"
        out += [(scope, w, k, t.label, i, words, need) for i, w in enumerate(words[: len(words) - need + 1])]
    return out


INDEX_SCHEMA = "scope string, word string, template int, label string, i int, parts array<string>, need int"


def _windows(scope: str, words: Column, start: Column, step: int) -> Column:
    """(scope, start, words) of each window; a window that lies inside the one before is left out."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s + step < F.size(words)))
    return F.transform(starts, lambda s: F.struct(F.lit(scope).alias("scope"), (start + s).cast("long").alias("start"), F.slice(words, s + 1, 2 * step).alias("words")))


def find_templates(texts: DataFrame, order: list[str], templates: tuple[Template, ...] = TEMPLATES, percent: int = PERCENT, key: str = "key", text_col: str = "text") -> DataFrame:
    """key, scope, start and n_words (of the block, words counted from 0), template, label, shared, containment: every
    block of ``texts`` whose words contain ``percent`` of a template's. ``order`` is from ``word_order`` and decides the
    cost only. Null and empty texts have no block; very long ones have a block for every few words of theirs."""
    spark, rows = texts.sparkSession, _index(templates, order, percent)
    index = spark.createDataFrame(rows, INDEX_SCHEMA)
    least = {s: min(r[6] for r in rows if r[0] == s) for s in {r[0] for r in rows}}
    rank = F.create_map(*[F.lit(x) for k, w in enumerate(order) for x in (w, k)])
    steps = _classes(templates)
    folded = texts.select(F.col(key).alias("key"), F.transform(F.split(fold_ascii(F.coalesce(F.col(text_col), F.lit(""))), "\n", -1), words_of).alias("lines"))
    placed = folded.select("key", "lines", F.transform("lines", lambda x: F.size(x).cast("long")).alias("sizes")).withColumn("starts", running_starts(F.col("sizes")))
    parts = []
    if "line" in steps:
        parts.append(F.flatten(F.zip_with("lines", "starts", lambda x, s: _windows("line", x, s, steps["line"]))))
    if "text" in steps:
        parts.append(_windows("text", F.flatten("lines"), F.lit(0), steps["text"]))
    blocks = placed.select("key", F.explode(F.concat(*parts)).alias("b")).select("key", "b.scope", "b.start", F.size("b.words").alias("n_words"), F.array_intersect("b.words", F.lit(order)).alias("own"))
    fewest = F.coalesce(*[F.when(F.col("scope") == s, n) for s, n in least.items()])
    ordered = F.transform(F.array_sort(F.transform("own", lambda w: F.struct(F.element_at(rank, w).alias("k"), w.alias("w")))), lambda x: x["w"])
    long_enough = blocks.where(F.size("own") >= fewest).select("key", "scope", "start", "n_words", ordered.alias("own"), fewest.alias("fewest"))
    prefix = long_enough.select("key", "scope", "start", "n_words", "own", F.posexplode(F.slice("own", F.lit(1), F.size("own") - F.col("fewest") + 1)).alias("j", "word"))
    pairs = prefix.join(index, ["scope", "word"])
    pairs = pairs.where((F.size("own") >= F.col("need")) & (F.least(F.size("parts") - F.col("i"), F.size("own") - F.col("j")) >= F.col("need")))
    pairs = pairs.dropDuplicates(["key", "scope", "start", "template"]).withColumn("shared", F.size(F.array_intersect("own", "parts")))
    return pairs.where("shared >= need").select("key", "scope", "start", "n_words", "template", "label", "shared", (F.col("shared") / F.size("parts")).alias("containment"))


def _base(words: Column, folded: Column) -> Column:
    """The base finds: (pieces between the places, the phrases found), null if there are none."""
    pattern = f"(?<= )({'|'.join(PHRASES)})(?= )"
    spaced = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    may = F.contains(folded, F.lit("license")) | (F.contains(folded, F.lit("cc")) & F.contains(folded, F.lit("by")))
    both = let(F.when(may, spaced), lambda x: F.struct(F.split(x, pattern, -1).alias("between"), F.regexp_extract_all(x, F.lit(pattern), 1).alias("phrases")))
    return let(both, lambda b: F.when(F.size(b["phrases"]) > 0, b))


def license_labels(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks.

    ``labels`` are those of the base phrases and of every template that a block contains; ``score`` is the largest
    containment found, 1 where a base phrase stands, 0 where nothing is found; ``n_blocks`` counts pairs of block and
    template. A null or empty text has no words and no label. Very long texts are scanned whole, in blocks. Ids may be
    null or repeated: finds go by the text, and each distinct text that holds a word of a template's prefix is joined
    once. Ties in word order are broken by the word and change no result. An empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    order = word_order(docs, templates, text_col)
    prefixes = sorted({r[1] for r in _index(templates, order, percent)})
    spaces = lambda x: (F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")
    folded = docs.select(F.col(id_col).alias("doc_id"), fold_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("folded"))
    split = folded.select("doc_id", "folded", words_of(F.col("folded")).alias("words"))
    based = split.select("doc_id", "folded", F.size("words").cast("long").alias("n_words"), F.arrays_overlap("words", F.lit(prefixes)).alias("gate"), _base(F.col("words"), F.col("folded")).alias("base"))
    last = lambda x: F.try_element_at(x, F.lit(-1))
    label_of = F.create_map(*[F.lit(x) for pair in PHRASES.items() for x in pair])
    scanned = based.select(
        "doc_id",
        "n_words",
        F.coalesce(F.when(F.col("base").isNotNull(), F.size("base.phrases")), F.lit(0)).cast("long").alias("n_base"),
        (spaces(F.col("base.between")[0]) - 1).alias("first_word"),
        (F.col("n_words") - (spaces(last(F.col("base.between"))) - 1) - (spaces(last(F.col("base.phrases"))) + 1)).alias("last_word"),
        F.coalesce(F.array_distinct(F.transform("base.phrases", lambda p: F.element_at(label_of, p))), F.array().cast("array<string>")).alias("base"),
        F.when(F.col("gate"), F.sha2(F.col("folded"), 256)).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))).alias("key"),
        F.when(F.col("gate"), F.col("folded")).alias("folded"),
    )
    rows = materialise(scanned, "license")
    texts = rows.where("folded IS NOT NULL").groupBy("key").agg(F.first("folded").alias("text"))
    found = find_templates(texts, order, templates, percent).groupBy("key").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"), F.count(F.lit(1)).alias("n_blocks"))
    joined = lookup(rows.drop("folded"), "key", found, "left")
    none = F.array().cast("array<string>")
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        listed(F.col("base")).alias("base_labels"),
        listed(F.concat("base", F.coalesce("found", none))).alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"),
    )


def oracle_sql(templates: tuple[Template, ...] = TEMPLATES, percent: int = PERCENT) -> str:
    """DuckDB: base places by comparing words at every place, and every block with every template, without filters."""
    steps = _classes(templates)
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    own = ", ".join(f"({k}, '{t.label}', {['line', 'text'].index('line' if len(t.text.split()) <= SHORT else 'text')}, list_distinct(string_split('{t.text}', ' ')), {needed(len(set(t.text.split())), percent)})" for k, t in enumerate(templates))
    windows = " UNION ALL ".join(
        f"SELECT row, {scope} AS scope, words[s * {step} + 1:s * {step} + {2 * step}] AS b FROM (SELECT row, words, unnest(range(0, greatest(1, (len(words) - 1) // {step}))) AS s FROM {source})"
        for scope, source, step in [(k, ("lines", "texts")[k], steps[name]) for k, name in enumerate(("line", "text")) if name in steps]
    )
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = lambda x: f"list_filter(string_split_regex({x}, '{gap}'), lambda w: w <> '')"
    return f"""
WITH raw AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
texts AS (SELECT row, doc_id, {words("x")} AS words FROM raw),
lines AS (SELECT row, {words("line")} AS words FROM (SELECT row, unnest(string_split(x, chr(10))) AS line FROM raw)),
phrases(phrase, label, n) AS (VALUES {phrases}),
templates(template, label, scope, parts, need) AS (VALUES {own}),
holding AS (SELECT row, words FROM texts WHERE EXISTS (SELECT 1 FROM phrases WHERE contains(array_to_string(words, ' '), phrase))),
places AS (SELECT row, i, label FROM (SELECT row, words, unnest(range(0, len(words))) AS i FROM holding) JOIN phrases ON array_to_string(words[i + 1:i + n], ' ') = phrase),
base AS (SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY row),
blocks AS ({windows}),
pairs AS (SELECT row, label, len(list_intersect(b, parts)) / len(parts) AS c FROM (SELECT row, scope, list_distinct(b) AS b FROM blocks) JOIN templates USING (scope) WHERE len(list_intersect(b, parts)) >= need),
found AS (SELECT row, list(DISTINCT label) AS labels, max(c) AS best, count(*) AS n FROM pairs GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
       greatest(coalesce(best, 0), CASE WHEN n_base > 0 THEN 1 ELSE 0 END)::DOUBLE AS score, coalesce(found.n, 0)::BIGINT AS n_blocks
FROM texts LEFT JOIN base USING (row) LEFT JOIN found USING (row)
"""
