"""License scans as an exact set-similarity join of text blocks and templates.

Templates fall into classes by their number of words (repeated ones counted):
up to ``SHORT`` words, and then one class for each doubling.  For each class a
text's words are cut into blocks of ``2 * m`` words, one starting every ``m``
words, so every run of m words lies within a block.  m is the number of words of
the class's longest template, so a verbatim copy lies whole within a block.  For
the short class m is the largest number of distinct tokens (as in the query's
SQL) as long as that finds a verbatim copy of each template wherever it starts;
a block may then miss a few words at the copy's edge, and its score be below 1.

A block meets a template of its class if it holds at least ``threshold`` of the
template's distinct tokens.  Tokens are ordered by how many documents hold them
(rarest first, then by name); with o = the tokens needed,

* length filter: a block with fewer than o template tokens cannot meet it;
* prefix filter: template and block must share a token among the template's
  first |T| - o + 1 and the block's first |B| - o + 1 tokens;
* positional filter: the tokens behind that place must suffice for o;

and candidates are confirmed on the full token sets.  Tokens in no template
never count, so blocks are first cut down to template tokens, in global order.
Templates are a small table given as a parameter (``MAX_TEMPLATES`` bounds it),
which is why it can be broadcast.

Besides, places where a phrase's words stand consecutively are counted.

Defined results: a null text is an empty text; repeated rows are scanned alike;
ties in frequency go by name; an empty table gives an empty result; other
columns are neither read nor returned.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.llm.common import col, text_of, written

# words: letters and digits of ASCII, and everything outside ASCII
WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP_RE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
MAX_TEMPLATES = 1000
SHORT = 64          # words of the longest template of the short class

# phrases and their labels (fixed values)
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# short license notices by label (fixed values)
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
            " and associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the"
               " License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the"
            " GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"
            " provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]


def lower_ascii(text: Column) -> Column:
    a = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, a, a.lower())


def scan_words(text: Column) -> Column:
    w = F.split(lower_ascii(text), GAP_RE)
    # a text may begin or end with a gap
    return F.filter(w, lambda x: x != "")


def template_table(spark: SparkSession, templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """(tid, label, words, tokens, need): all words, the distinct ones and how many
    of these are needed."""
    rows = templates if templates is not None else TEMPLATES
    if len(rows) > MAX_TEMPLATES:
        raise ValueError(f"{len(rows)} templates; at most {MAX_TEMPLATES} are joined by broadcast")
    t = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "tid int, label string, body string")
    t = t.select("tid", "label", scan_words(F.col("body")).alias("words"))
    t = t.withColumn("tokens", F.array_distinct("words"))
    return t.where(F.size("tokens") > 0).withColumn(
        "need", F.ceil(F.size("tokens") * F.lit(threshold) - 1e-9).cast("int"))


def token_order(words: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' tokens, rarest first: by the number of documents that
    hold them (counted over all documents)."""
    held = words.select(F.explode(F.array_intersect(F.lit(vocabulary), F.col("_w"))).alias("token"))
    counts = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def class_of(n_words: int) -> int:
    """0 for up to SHORT words, then one class for each doubling."""
    return max(math.ceil(math.log2(n_words / SHORT)), 0)


def found_anywhere(words: list[str], need: int, span: int) -> bool:
    """Whether some block holds ``need`` distinct tokens of a verbatim copy,
    whatever the place in a block at which the copy starts."""
    def best(start):
        return max(len(set(words[max(at - start, 0):at + 2 * span - start]))
                   for at in range(0, start + len(words), span))
    return all(best(start) >= need for start in range(span))


def class_spans(table: list[dict]) -> dict[int, int]:
    """m of each class of the templates."""
    spans = {}
    for c in sorted({class_of(len(r["words"])) for r in table}):
        mine = [r for r in table if class_of(len(r["words"])) == c]
        span = max(len(r["tokens"]) for r in mine)
        if c > 0 or not all(found_anywhere(r["words"], r["need"], span) for r in mine):
            span = max(len(r["words"]) for r in mine)
        spans[c] = span
    return spans


def blocks(words: DataFrame, spans: dict[int, int]) -> DataFrame:
    """_key, the class and the words of each block, start + i * span, of 2 * span words."""
    def starts(c, span):
        last = F.greatest(F.ceil(F.size("_w") / span).cast("int") - 2, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
            F.lit(c).alias("c"), (i * span + 1).alias("at"), F.lit(2 * span).alias("n")))
    return words.where(F.size("_w") > 0).select(
        "_key", "_w", F.explode(F.concat(*[starts(c, m) for c, m in spans.items()])).alias("_i")).select(
        "_key", F.col("_i.c").alias("cls"), F.slice("_w", F.col("_i.at"), F.col("_i.n")).alias("_b"))


def matches(words: DataFrame, templates: DataFrame) -> DataFrame:
    """(_key, label, containment): every block and template at the threshold."""
    table = [r.asDict() for r in templates.collect()]            # a parameter, bounded above
    if not table:
        return words.select("_key").limit(0).withColumns({"label": F.lit(""), "containment": F.lit(0.0)})
    order = token_order(words, sorted({x for r in table for x in r["tokens"]}))
    rank = {t: i for i, t in enumerate(order)}
    spans = class_spans(table)
    least = F.lit(0)
    for c in spans:
        least = F.when(F.col("cls") == c, min(r["need"] for r in table if class_of(len(r["words"])) == c)).otherwise(least)
    index = []
    for r in table:
        toks = sorted(r["tokens"], key=rank.__getitem__)
        for at, token in enumerate(toks[:len(toks) - r["need"] + 1]):
            index.append((class_of(len(r["words"])), token, at, r["tid"], r["label"], toks, r["need"]))
    prefix = F.broadcast(words.sparkSession.createDataFrame(
        index, "cls int, token string, t_at int, tid int, label string, t_tokens array<string>, need int"))
    # array_intersect keeps the order of its first argument: the global order
    b = blocks(words, spans).select("_key", "cls", F.array_intersect(F.lit(order), F.col("_b")).alias("_t"))
    b = b.where(F.size("_t") >= least)                                             # length filter
    heads = b.select("_key", "cls", "_t", F.posexplode(F.slice("_t", F.lit(1), F.size("_t") - least + 1))
                     .alias("b_at", "token"))
    cand = heads.join(prefix, ["cls", "token"]).where(
        (F.col("b_at") <= F.size("_t") - F.col("need"))                            # the block's own prefix
        & (F.least(F.size("t_tokens") - F.col("t_at"), F.size("_t") - F.col("b_at")) + F.least("t_at", "b_at")
           >= F.col("need")))                                                      # positional filter
    common = F.size(F.array_intersect("t_tokens", "_t"))
    return (cand.withColumn("_c", common).where(F.col("_c") >= F.col("need"))
            .select("_key", "label", (F.col("_c") / F.size("t_tokens")).alias("containment")))


def phrase_places(w: Column, phrase: str) -> Column:
    """Starts (from 0) of the places where the phrase's words stand."""
    parts = phrase.split()
    hit = reduce(lambda a, b: a & b, [F.array_contains(w, p) for p in parts])
    starts = F.filter(F.transform(w, lambda x, i: F.when(reduce(
        lambda a, b: a & b, [(x if k == 0 else F.get(w, i + k)) == p for k, p in enumerate(parts)]), i)),
        lambda i: i.isNotNull())
    return F.when(hit, starts).otherwise(F.array().cast("array<int>"))


def license_scan(docs: DataFrame, templates: DataFrame | None = None, phrases: dict | None = None,
                 threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    templates = templates if templates is not None else template_table(spark, threshold=threshold)
    phrases = PHRASES if phrases is None else phrases
    w = (docs.select(col("doc_id").alias("doc_id"), text_of().alias("_text"))
         .select("doc_id", F.struct("doc_id", F.md5(F.col("_text").cast("binary")).alias("h")).alias("_key"),
                 scan_words(F.col("_text")).alias("_w")))
    found = matches(w.select("_key", "_w"), templates)
    per = written(found.groupBy("_key").agg(F.collect_set("label").alias("_labels"),
                                            F.max("containment").alias("score")), "license-matches")
    per = per.withColumnRenamed("_key", "_k2")
    places = {label: phrase_places(F.col("_w"), p) for p, label in phrases.items()}
    d = w.select("doc_id", "_key", F.size("_w").cast("long").alias("n_words"),
                 *[c.alias(f"_p{i}") for i, c in enumerate(places.values())])
    all_ = F.concat(*[F.col(f"_p{i}") for i in range(len(places))])
    base = F.filter(F.array(*[F.when(F.size(f"_p{i}") > 0, F.lit(label))
                              for i, label in enumerate(places)]), lambda x: x.isNotNull())
    d = d.select("doc_id", "_key", "n_words", all_.alias("_all"), base.alias("_base"))
    d = d.join(per, F.col("_key").eqNullSafe(F.col("_k2")), "left")
    labels = F.array_sort(F.array_union("_base", F.coalesce("_labels", F.array().cast("array<string>"))))
    return d.select(
        "doc_id", "n_words", F.size("_all").cast("long").alias("n_base"),
        F.array_min("_all").cast("long").alias("first_word"), F.array_max("_all").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("_base")), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.round(F.coalesce("score", F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0))), 6).alias("score"))
