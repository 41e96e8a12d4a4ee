"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

The sets are the benchmark's windows (ten consecutive words of an item). A document holds a window only if it holds
every word of it, so a prefix of one word is enough, if it is the window's rarest: words are ordered by how often they
occur in the whole corpus, and each window is looked up by its rarest one. A document word that equals a window's rarest
word fixes where the window would stand; it must lie within the document (length and position bounds), and then all its
words are compared, in order, over an item-sized slice of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, documents

#: What is no separator in a lower-cased text: letters, digits and everything beyond ASCII. The class is given by what it
#: holds: its complement is matched several times slower.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: The sentinel that ends each document's words; it holds separators, so no word equals it.
END = "\x01"
#: Broadcast limits, in rows (windows, or distinct words) and bytes: a larger benchmark is joined by shuffling.
BROADCAST_WINDOWS = 200_000
BROADCAST_WORDS = 1_000_000
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    """Lower-cased words; none for a null text."""
    return F.regexp_extract_all(F.coalesce(ascii_lower(text), F.lit("")), F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame, size: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, win): the distinct windows of each item; an item of fewer words, but some, is one window."""
    items = benchmark.select(F.col(item).alias("item"), words_of(F.col(text)).alias("w")).filter((F.size("w") > 0) & F.col("item").isNotNull())
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    return items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("win")).distinct()


def fits(rows: DataFrame, most: int, size: Column) -> bool:
    """At most so many rows, whose sizes add up to no more than the bytes that a broadcast may hold."""
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= most and total <= BROADCAST_BYTES


def prefixes(wins: DataFrame, words: DataFrame) -> DataFrame:
    """(word, k, win): of each distinct window its rarest word in the corpus and that word's 0-based position.

    words: (w): the corpus's words, an array a document. A word's frequency counts all its occurrences.
    """
    vocabulary = cut(wins.select(F.explode("win").alias("word")).distinct())
    # with a sentinel no array is empty: else Spark would filter by the array's size first, and match every text twice
    heard = words.select(F.explode(F.concat("w", F.array(F.lit(END)))).alias("word"))
    small = fits(vocabulary, BROADCAST_WORDS, F.octet_length("word"))
    if small:
        heard = heard.join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
        heard = F.broadcast(heard)  # no more rows than the vocabulary
    else:
        heard = heard.groupBy("word").agg(F.count("*").alias("n")).join(vocabulary, "word", "left_semi")
    each = wins.select("win").distinct().select("win", F.posexplode("win").alias("k", "word"))
    counted = each.join(heard, "word", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "k")).alias("rarest"), F.min(F.coalesce("n", F.lit(0))).alias("least"))
    # a window with a word that no document holds occurs nowhere
    return counted.filter("least > 0").select(F.col("rarest.word").alias("word"), F.col("rarest.k").alias("k"), "win")


def occurrences(words: DataFrame, prefix: DataFrame, keys: list[str], small: bool, size: int) -> DataFrame:
    """(keys, n_words, start, win): every occurrence of a window, and a row with null start for each document.

    words: keys and w. The sentinel after a document's last word meets a row of its own, so that documents without any
    occurrence come out of the same pass.
    """
    if not small:
        return _shuffled_occurrences(words, prefix, keys, size)
    end = words.sparkSession.range(1).select(F.lit(END).alias("word"), F.lit(0).alias("k"), F.expr("cast(null as array<string>)").alias("win"))
    table = F.broadcast(prefix.select("word", "k", "win").unionByName(end))
    long = words.select(*keys, "w", F.posexplode(F.concat("w", F.array(F.lit(END)))).alias("at", "word"))
    joined = long.join(table, "word")
    start = F.col("at") - F.col("k")
    here = (start >= 0) & (start + F.size("win") <= F.size("w")) & (F.slice("w", start + 1, F.greatest(F.size("win"), F.lit(1))) == F.col("win"))
    return joined.filter(F.col("win").isNull() | here).select(*keys, F.size("w").cast("long").alias("n_words"), F.when(F.col("win").isNotNull(), start).alias("start"), "win")


def _shuffled_occurrences(words: DataFrame, prefix: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The same for a benchmark that no broadcast may hold: what moves is a word with its ``size`` - 1 neighbours on each
    side, of the words that begin a prefix; the documents come as rows of their own, so no key holds them all."""
    w, reach = F.col("w"), size - 1
    n_words = F.size(w).cast("long").alias("n_words")
    low = F.greatest(F.col("at") - reach, F.lit(0))
    each = words.select(*keys, "w", n_words, F.posexplode(w).alias("at", "word"))
    each = each.select(*keys, "n_words", "at", "word", low.alias("low"), F.slice(w, low + 1, F.col("at") - low + size).alias("near"))
    start = F.col("at") - F.col("k")
    here = (start >= 0) & (start + F.size("win") <= F.col("n_words")) & (F.slice("near", F.greatest(start - F.col("low"), F.lit(0)) + 1, F.size("win")) == F.col("win"))
    hits = each.join(prefix, "word").filter(here).select(*keys, "n_words", start.alias("start"), "win")
    none = words.select(*keys, n_words, F.expr("cast(null as int)").alias("start"), F.expr("cast(null as array<string>)").alias("win"))
    return hits.unionByName(none)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, copy, n_words, n_hit, n_items, items_sha256, contaminated): one row for each document.

    ``copy`` is xxhash64 of the text. Rows are told apart by key and text: repeated rows are one document. Null, empty and wordless texts have no words
    and no hits; items without words or with a null id have no windows; null keys are a key like others. An empty
    benchmark hits nothing; an empty table gives no rows. Other columns are not read.
    """
    wins = cut(windows(benchmark, size, item, item_text))
    words = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("copy"), words_of(F.col(text)).alias("w"))
    prefix = cut(prefixes(wins, words))
    text_size = F.octet_length(F.array_join("win", " "))
    found = occurrences(words, prefix, ["key", "copy"], fits(prefix, BROADCAST_WINDOWS, text_size), size)
    # a document's occurrences as (start, window), once each; then its covered positions and its items
    own = found.groupBy("key", "copy", "n_words", "start", "win").agg(F.lit(1).alias("one")).drop("one")
    items = wins.join(prefix, "win", "left_semi").groupBy("win").agg(F.collect_set(F.col("item").cast("string")).alias("items"))
    items = cut(items)
    if fits(items, BROADCAST_WINDOWS, text_size + F.octet_length(F.array_join("items", ","))):
        own = own.join(F.broadcast(items), "win", "left")
    else:  # rows without a window would all meet in one task
        none = own.filter("win is null").withColumn("items", F.expr("cast(null as array<string>)"))
        own = own.filter("win is not null").join(items, "win").unionByName(none)
    own = own.withColumn("stop", F.col("start") + F.size("win"))
    ordered = Window.partitionBy("key", "copy").orderBy(F.col("start").asc_nulls_first(), "stop")
    reach = F.max("stop").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(reach, F.col("start"))))
    per = own.withColumn("new", F.when(F.col("start").isNotNull(), new).otherwise(0)).groupBy("key", "copy").agg(
        F.max("n_words").alias("n_words"),
        F.sum("new").cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return per.select(
        F.col("key").alias(key),
        "copy",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("copy")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT dw.doc_id, dw.i, bw.size, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(pos.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
  sha256(coalesce(its.items, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
