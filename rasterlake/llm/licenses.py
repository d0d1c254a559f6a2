"""License scans: base phrases, and an exact set-similarity join against notice templates. DataFrame functions only.

Blocks are runs of ``run`` neighbouring lines of a text (from each line on; fewer at the text's end), as sets of
words lower-cased in A-Z, so that wrapped notices are blocks, too. A template is found in a block if at
least ``threshold`` of its words are in it. The join is exact:

1. frequencies of the templates' words over all words of the corpus give one global order, rarest first;
2. length filter: a block with fewer template words than the smallest need of any template goes;
3. prefix filter: a template that needs a of its t words shares with any found block one of its first
   t - a + 1 words; a block's own prefix is cut for the smallest need. Prefixes meet in a hash join;
4. positional filter: the words left after the shared one, on the shorter side, must reach the need;
5. what is left is verified by the size of the intersection.

Templates are pairs (label, notice), or a table with these two columns and at most ``MOST_TEMPLATES`` rows (more are an error: their
words are literals of the plan and their side of the join is sent to every task). Only words of
templates are kept of a block; words no template has cannot change an overlap. Texts are cut into words once, to
the table of blocks; the frequencies are counted from it, each word of a line once for each block it lies in.

Defined results: null text is empty: no words, no labels, score 0; places are word numbers from 0; repeated rows each get
their row; a null doc_id stays null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import reduce
from math import ceil
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.llm._common import materialise

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notice lines and their labels.
TEMPLATES = (
    ("apache-2.0-notice", "licensed under the apache license version 2 0"),
    ("gpl-notice", "licensed under the gnu general public license version"),
    ("mit-notice", "released under the mit license"),
    ("cc-notice", "licensed under a creative commons attribution license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("warranty", "the software is provided as is without warranty of any kind express or implied"),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license"),
    ("gpl-grant", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("all-rights", "copyright all rights reserved"),
)
THRESHOLD = 0.8
#: Lines of a block: the longest notice, wrapped at some 60 characters, takes three.
RUN = 3
MOST_TEMPLATES = 2000


def words(text: Column) -> Column:
    """Lower-cased words in order; splitting leaves empty strings at either end, which go."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), GAP + "+"), lambda w: w != "")


def _table(spark, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small constant table made of literals."""
    cells = [F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r))) for r in rows]
    return spark.range(1).select(F.inline(F.array(*cells)))


def base(docs: DataFrame) -> DataFrame:
    """``(key, doc_id, n_words, n_base, first_word, last_word, base_labels)``: places where a phrase's words stand consecutively."""
    text = F.coalesce(F.col("text"), F.lit(""))
    any_phrase = "|".join((GAP + "+").join(p.split()) for p in PHRASES)
    rows = docs.withColumn("n_words", F.regexp_count(text, F.lit(WORD + "+")).cast("long"))
    # only texts that hold a phrase are cut into words
    rows = rows.withColumn("w", F.when(text.rlike(f"(?i)(?<!{WORD})(?:{any_phrase})(?!{WORD})"), words(text)))
    found = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        starts = F.filter(F.sequence(F.lit(0), F.size("w") - 1), _follows(p))
        found.append((starts, label))
    rows = rows.select("key", "doc_id", "n_words", *(F.when(F.size("w") > 0, s).alias(f"s{k}") for k, (s, _) in enumerate(found)))
    empty = F.array().cast("array<int>")
    starts = F.concat(*(F.coalesce(f"s{k}", empty) for k in range(len(found))))
    labels = F.array_distinct(F.concat(*(F.when(F.size(f"s{k}") > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for k, (_, label) in enumerate(found))))
    return rows.select(
        "key", "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), labels.alias("base_labels"),
    )


def _follows(phrase: list[str]):
    """Whether a phrase stands from word i on."""

    def test(i: Column) -> Column:
        return reduce(and_, (F.coalesce(F.get(F.col("w"), i + k), F.lit("")) == word for k, word in enumerate(phrase)))

    return test


def listed(templates) -> list[tuple[str, str]]:
    """Templates as pairs (label, notice)."""
    if not isinstance(templates, DataFrame):
        return list(templates)
    rows = templates.select("label", "notice").limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    return [(r["label"], r["notice"]) for r in rows if r["notice"]]


def notices(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, run: int = RUN) -> DataFrame:
    """``(key, block, label, containment)`` for each block (by its first line) and template that meet ``threshold``."""
    spark = docs.sparkSession
    sets: dict[str, list[str]] = {}
    for k, (label, t) in enumerate(listed(templates)):
        found = sorted({w for w in re.split(GAP + "+", t.translate(str.maketrans(UPPER, LOWER))) if w})
        if found:
            sets[f"{k}:{label}"] = found
    if not sets:
        return docs.select("key", F.lit(0).alias("block"), F.lit("").alias("label"), F.lit(0.0).alias("containment")).limit(0)
    vocabulary = sorted({w for s in sets.values() for w in s})
    need = {label: max(1, ceil(threshold * len(s) - 1e-9)) for label, s in sets.items()}
    lowest = min(need.values())
    known = F.array(*map(F.lit, vocabulary))
    lines = F.transform(F.split(F.translate("text", UPPER, LOWER), "\n"), lambda line: F.array_intersect(F.split(line, GAP + "+"), known))
    cut = docs.where("text is not null").select("key", lines.alias("lines"))
    around = F.transform("lines", lambda w, i: F.array_distinct(F.concat(w, *(F.coalesce(F.get("lines", i + k), F.array().cast("array<string>")) for k in range(1, run)))))
    blocks = cut.where(F.exists("lines", lambda w: F.size(w) > 0)).select("key", F.posexplode(around).alias("block", "w")).where(F.size("w") >= lowest)
    blocks = materialise(blocks, "license-blocks")
    counted = blocks.select(F.explode("w").alias("w")).groupBy("w").count()
    frequency = {r["w"]: r["count"] for r in counted.collect()}  # a row for each template word at most
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    ranks = F.create_map(*(F.lit(x) for w, k in rank.items() for x in (w, k)))
    blocks = blocks.select("key", "block", F.array_sort(F.transform("w", lambda w: F.element_at(ranks, w))).alias("b"))
    index = []
    for k, (label, s) in enumerate(sets.items()):
        mine = sorted(rank[w] for w in s)
        index += [(mine[i], k, label, i, mine, need[label]) for i in range(len(mine) - need[label] + 1)]
    side = spark.range(1).select(F.inline(F.array(*(
        F.struct(F.lit(w).alias("word"), F.lit(k).alias("template"), F.lit(label).alias("label"), F.lit(i).alias("t_at"), F.array(*map(F.lit, mine)).alias("t"), F.lit(a).alias("need"))
        for w, k, label, i, mine, a in index
    ))))
    prefix = blocks.select("key", "block", "b", F.posexplode(F.slice("b", 1, F.size("b") - lowest + 1)).alias("b_at", "word"))
    left = F.least(F.size("b") - F.col("b_at"), F.size("t") - F.col("t_at"))
    pairs = prefix.join(F.broadcast(side), "word").where((F.size("b") >= F.col("need")) & (left >= F.col("need")))
    found = pairs.where(F.size(F.array_intersect("b", "t")) >= F.col("need"))
    return found.select("key", "block", F.regexp_replace("label", "^[0-9]+:", "").alias("label"), (F.size(F.array_intersect("b", "t")) / F.size("t")).alias("containment")).distinct()


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates=TEMPLATES, threshold: float = THRESHOLD, run: int = RUN) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for each row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # rows with equal key are copies of one row and have equal results: the same doc_id, hash and length of the text
    rows = rows.withColumn("key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex(F.xxhash64("text")), F.length("text").cast("string")))
    labels = notices(rows, templates, threshold, run).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    out = base(rows).join(labels, "key", "left")
    every = F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("more", F.array().cast("array<string>")))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _oracle() -> str:
    """The same results in DuckDB SQL, without any filter: every block against every template."""
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    starts = []
    for phrase, label in PHRASES.items():
        test = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(phrase.split()))
        starts.append((f"list_filter(range(len(w)), lambda i: coalesce({test}, false))", label))
    lists = ", ".join(f"{s} AS s{k}" for k, (s, _) in enumerate(starts))
    every = "list_concat(list_concat(s0, s1), list_concat(s2, s3))"
    names = ", ".join(f"CASE WHEN len(s{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(starts))
    templates = ", ".join(f"('{label}', {sorted(set(t.split()))!r})" for label, t in TEMPLATES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), t AS (SELECT * FROM (VALUES {templates}) AS v(label, words)
), a AS (SELECT r, doc_id, list_filter(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '{gap}'), lambda x: x <> '') AS w FROM d
), b AS (SELECT r, doc_id, len(w) AS n_words, {lists} FROM a
), c AS (SELECT r, doc_id, n_words, {every} AS s, list_filter([{names}], lambda x: x IS NOT NULL) AS names FROM b
), g AS (SELECT r, string_split(translate(text, '{UPPER}', '{LOWER}'), chr(10)) AS lines FROM d
), l AS (SELECT r, list_distinct(regexp_split_to_array(block, '{gap}')) AS w FROM (SELECT r, unnest(list_transform(range(1, len(lines) + 1), lambda i: array_to_string(list_slice(lines, i, i + {RUN - 1}), chr(10)))) AS block FROM g)
), m AS (SELECT r, label, len(list_intersect(words, w)) / len(words) AS containment FROM l, t
), n AS (SELECT r, list(DISTINCT label) AS more, max(containment) AS best FROM m WHERE containment >= {THRESHOLD} - 1e-9 GROUP BY r)
SELECT doc_id, n_words, CAST(len(s) AS BIGINT) AS n_base, list_min(s) AS first_word, list_max(s) AS last_word,
  array_to_string(list_sort(names), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(names, coalesce(more, [])))), ',') AS labels,
  greatest(CASE WHEN len(s) > 0 THEN 1.0 ELSE 0.0 END, coalesce(best, 0.0))::DOUBLE AS score
FROM c LEFT JOIN n USING (r)
"""


ORACLE = _oracle()
