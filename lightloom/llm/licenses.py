"""License scans by diagonal voting, in DataFrame operations only.

1. All rolling grams of ``size`` words of a text are hashed and joined to the places of the same grams in the templates. A
   template may ask for longer grams: its vote counts only where all its words stand there, which is seen in the same pass.
2. A place in the text less the place in the template is a diagonal. Votes are added up by document, template and
   diagonal, before and after the shuffle; what moves is a row a diagonal, never a text.
3. Diagonals of one template that lie within its slack are neighbours (a word was put in or left out) and are merged.
4. A merged span is verified: the words of the template that its votes cover must be a sufficient share of the template,
   and no less than half of the words between its first and its last one. Phrases must be covered whole, on one diagonal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents
from .decontaminate import BROADCAST_WORDS, END, fits, words_of


@dataclass(frozen=True)
class Template:
    """A text to look for: its label, the words of a vote, the share that must be covered, and the slack of diagonals.

    base: a phrase whose places are counted.
    """

    label: str
    text: str
    size: int = 2
    share: float = 1.0
    slack: int = 0
    base: bool = False


#: Fixed phrases and their labels.
PHRASES = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
)
#: Fixed notices and passages of public licenses, and the labels that the method adds for them.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", 3, 0.8, 3),
    Template("mit", "released under the mit license", 3, 0.8, 3),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", 3, 0.8, 3),
    Template("lgpl", "gnu lesser general public license", 3, 0.8, 3),
    Template("agpl", "gnu affero general public license", 3, 0.8, 3),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", 3, 0.8, 3),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", 3, 0.8, 3),
    Template("cc-by-4.0", "licensed under cc by 4 0", 3, 0.8, 3),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", 3, 0.8, 3),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", 3, 0.8, 3),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        4, 0.6, 8,
    ),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 4, 0.6, 8),
    Template("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 4, 0.6, 8),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", 4, 0.6, 8),
)
TEMPLATES = (*PHRASES, *NOTICES)


def gram_hash(at, size: int) -> Column:
    """The hash of so many words of ``w`` from place ``at``; beyond the text's end words are null."""
    return F.xxhash64(*[F.get("w", at + i) for i in range(size)])


def places(spark: SparkSession, templates, size: int) -> DataFrame:
    """(h, t, pos, gram): a row for each gram of each template, t its number."""
    rows = spark.createDataFrame([(i, x.text, max(x.size, size)) for i, x in enumerate(templates)], "t int, text string, size int")
    own = rows.select("t", "size", words_of(F.col("text")).alias("w"))
    each = own.filter(F.size("w") >= F.col("size")).select("t", "w", "size", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))).alias("pos"))
    return each.select(gram_hash(F.col("pos"), size).alias("h"), "t", "pos", F.slice("w", F.col("pos") + 1, F.col("size")).alias("gram"))


def votes(words: DataFrame, table: DataFrame, keys: list[str], size: int, longest: int) -> DataFrame:
    """(keys, n_words, t, pos, at): every gram of a template in a text, and a row with null t for each text.

    words: keys and w. A table that no broadcast may hold is joined by shuffling each gram with its next ``longest`` words.
    """
    here = F.slice("w", F.col("at") + 1, F.size("gram")) == F.col("gram")
    if fits(table, BROADCAST_WORDS, F.octet_length(F.array_join("gram", " ")) + 24):
        # the sentinel after the last word meets a row of its own, so that texts without any vote come out of the same pass
        end = words.sparkSession.range(1).select(F.xxhash64(F.lit(END)).alias("h"), F.expr("cast(null as int)").alias("t"), F.lit(0).alias("pos"), F.array(F.lit(END)).alias("gram"))
        each = words.withColumn("w", F.concat("w", F.array(F.lit(END)))).select(*keys, "w", F.posexplode("w").alias("at", "_word")).withColumn("h", gram_hash(F.col("at"), size))
        joined = each.join(F.broadcast(table.unionByName(end)), "h").filter(here)
        return joined.select(*keys, (F.size("w") - 1).cast("long").alias("n_words"), "t", "pos", "at")
    n = F.size("w").cast("long").alias("n_words")
    each = words.select(*keys, "w", n, F.posexplode("w").alias("at", "_word")).select(*keys, "n_words", "at", gram_hash(F.col("at"), size).alias("h"), F.slice("w", F.col("at") + 1, longest).alias("w"))
    found = each.join(table, "h").filter(F.slice("w", 1, F.size("gram")) == F.col("gram")).select(*keys, "n_words", "t", "pos", "at")
    return found.unionByName(words.select(*keys, n, F.expr("cast(null as int)").alias("t"), F.lit(0).alias("pos"), F.lit(0).alias("at")))


def spans(docs: DataFrame, templates=TEMPLATES, size: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, copy, n_words, t, label, base, first, last, covered, coverage): every verified span of a template in a text,
    and a row with null t for each text. ``first`` and ``last`` are its first word and the one after its last, from 0;
    ``copy`` is xxhash64 of the text.

    Rows are told apart by key and text: repeated rows are one document. Null and wordless texts have no spans; null keys
    are keys like others; templates with fewer words than a gram match nothing. Other columns are not read.
    """
    spark = docs.sparkSession
    keys = ["key", "copy"]
    words = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("copy"), words_of(F.col(text)).alias("w"))
    longest = max([size, *(t.size for t in templates)])
    cast = votes(words, places(spark, templates, size), keys, size, longest)
    diagonal = cast.groupBy(*keys, "n_words", "t", (F.col("at") - F.col("pos")).alias("d")).agg(F.collect_set("pos").alias("pos"))  # no more places than the template has
    facts = spark.createDataFrame([(i, x.label, x.base, max(x.size, size), x.share, x.slack) for i, x in enumerate(templates)], "t int, label string, base boolean, size int, share double, slack int")
    lengths = spark.createDataFrame([(i, x.text) for i, x in enumerate(templates)], "t int, _text string").select("t", F.size(words_of(F.col("_text"))).alias("length"))
    facts = facts.join(lengths, "t")
    rows = diagonal.join(F.broadcast(facts) if fits(facts, BROADCAST_WORDS, F.octet_length("label") + 40) else facts, "t", "left")
    # neighbouring diagonals of a template in one text
    ordered = Window.partitionBy(*keys, "t").orderBy("d")
    new = F.when(F.col("d") - F.lag("d").over(ordered) <= F.col("slack"), 0).otherwise(1)
    merged = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(ordered)).groupBy(*keys, "n_words", "t", "label", "base", "size", "share", "length", "_run").agg(
        F.min(F.col("d") + F.array_min("pos")).alias("first"),
        F.max(F.col("d") + F.array_max("pos") + F.col("size")).alias("last"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("pos")))).alias("pos"),
    )
    # a vote covers ``size`` words from its place, but for those that the next vote covers
    steps = F.zip_with("pos", F.slice("pos", 2, F.greatest(F.size("pos") - 1, F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.col("size")), F.col("size")))
    covered = F.aggregate(steps, F.lit(0), lambda s, x: s + x)
    told = merged.withColumn("covered", F.when(F.col("t").isNotNull(), covered)).withColumn("coverage", F.col("covered") / F.col("length"))
    good = (F.col("coverage") >= F.col("share")) & (F.col("covered") * 2 >= F.col("last") - F.col("first"))
    return told.filter(F.col("t").isNull() | good).select(F.col("key").alias(key), "copy", "n_words", "t", "label", "base", "first", "last", "covered", "coverage")


def scan(docs: DataFrame, templates=TEMPLATES, size: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, copy, n_words, n_base, first_word, last_word, base_labels, labels, score): one row a document; score is the
    largest coverage of a verified span, 0 without any. See ``spans`` for nulls and repeated rows; an empty table gives none."""
    found = spans(docs, templates, size, key, text)
    base = F.col("base") & F.col("t").isNotNull()
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return found.groupBy(key, "copy", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
    )


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the fixed phrases and notices; see ``spans`` for nulls and repeated rows."""
    return scan(documents(spark, sf_dir)).drop("copy")


def oracle(templates=TEMPLATES, size: int = 2) -> str:
    """DuckDB SQL: grams as strings, joined place by place."""
    rows = ", ".join(f"({i}, '{x.label}', {str(x.base).lower()}, {max(x.size, size)}, {x.share}, {x.slack}, string_split('{x.text}', ' '))" for i, x in enumerate(templates))
    return rf"""
WITH f(t, label, base, size, share, slack, tw) AS (VALUES {rows}),
g AS (SELECT t, size, pos, array_to_string(tw[pos + 1 : pos + size], ' ') AS gram FROM (SELECT *, unnest(range(0, len(tw) - size + 1)) AS pos FROM f)),
k AS (SELECT DISTINCT size FROM f),
d AS MATERIALIZED (SELECT DISTINCT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT row_number() OVER () AS rid, doc_id, w FROM d),
p AS (SELECT rid, size, ix, array_to_string(w[ix + 1 : ix + size], ' ') AS gram FROM (SELECT rid, size, w, unnest(range(0, len(w) - size + 1)) AS ix FROM e, k WHERE len(w) >= size)),
v AS (SELECT DISTINCT p.rid, g.t, p.ix - g.pos AS dg, g.pos FROM p JOIN g ON p.gram = g.gram AND p.size = g.size),
n AS (SELECT rid, v.t, dg, CASE WHEN dg - lag(dg) OVER (PARTITION BY rid, v.t ORDER BY dg) <= slack THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT rid, t, dg FROM v) v JOIN f USING (t)),
r AS (SELECT rid, t, dg, sum(new) OVER (PARTITION BY rid, t ORDER BY dg) AS run FROM n),
s AS (SELECT rid, t, run, min(dg + pos) AS a, max(dg + pos) + any_value(f.size) AS b, list(DISTINCT pos) AS pos, any_value(f.size) AS size FROM v JOIN r USING (rid, t, dg) JOIN f USING (t) GROUP BY rid, t, run),
c AS (SELECT rid, t, run, a, b, len(list_distinct(flatten(list_transform(pos, lambda q: range(q, q + size))))) AS covered FROM s),
z AS (SELECT c.*, f.label, f.base, covered / len(f.tw) AS coverage FROM c JOIN f USING (t) WHERE covered / len(f.tw) >= share AND covered * 2 >= b - a)
SELECT e.doc_id, CAST(len(any_value(e.w)) AS BIGINT) AS n_words, count(z.t) FILTER (WHERE z.base) AS n_base, CAST(min(z.a) FILTER (WHERE z.base) AS BIGINT) AS first_word,
  CAST(max(z.a) FILTER (WHERE z.base) AS BIGINT) AS last_word, coalesce(string_agg(DISTINCT z.label, ',' ORDER BY z.label) FILTER (WHERE z.base), '') AS base_labels,
  coalesce(string_agg(DISTINCT z.label, ',' ORDER BY z.label), '') AS labels, coalesce(max(z.coverage), 0.0) AS score
FROM e LEFT JOIN z USING (rid) GROUP BY e.rid, e.doc_id
"""


ORACLE = oracle()
