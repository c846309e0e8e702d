"""License scan: an exact set-similarity join of text blocks with license templates. Only DataFrame functions.

Words are runs of digits, lower-case letters and characters beyond ASCII, after A-Z is lower-cased. A template of up
to 2^k words is looked for in blocks of 2^(k+1) words that start every 2^k words, so every run of a template's length
lies in one block whole, wherever lines break. A block meets a template when it contains at least ``THRESHOLD`` of the
template's distinct words, that is ``need`` of them.

The join has one global order of the words of all templates, by the number of documents that hold them (rarest first,
ties by the word), counted over all documents. Then, for a template with s words and a block with b words of that
order: (length) b is at least ``need``; (prefix) the two meet in the template's first s - need + 1 words and the
block's first b - need + 1, so only documents with a word of some template's prefix are cut to blocks at all, and a
block finds its templates by an equality join on prefix words; (position) the words matched within the prefixes and
what is left behind the last of them suffice for ``need``. What remains is counted exactly. The templates are a parameter of
a few dozen texts (``MOST_WORDS`` words in all at most, else an error), so their index is small enough for a
broadcast, which the session's own limit decides.

Templates that contain each other to the threshold are rivals: of rivals in one block the one with the larger share,
then with more words, counts for a document's labels.

Defined results: a null text is empty. Repeated rows are scanned like others. Texts may be long: a document is a row
with its words, a block a bounded piece of it. An empty table gives an empty result, no templates give no matches.
Columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemweave.plans.durable import written

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
MOST_WORDS = 4096

#: Phrases and the labels that they give.
PHRASES: tuple[tuple[str, str], ...] = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

#: Wordings of public license notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
)


def _lower(text: Column) -> Column:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text, F.lit("")), letters, letters.lower())


def words(text: Column) -> Column:
    return F.array_remove(F.split(_lower(text), BETWEEN), "")


class Template:
    def __init__(self, number: int, label: str, text: str, threshold: float) -> None:
        listed = [w for w in re.split(BETWEEN, "".join(c.lower() if c.isascii() else c for c in text)) if w]
        self.number, self.label, self.words = number, label, sorted(set(listed))
        self.need = max(1, ceil(threshold * len(self.words) - 1e-9))
        self.stride = 1 << max(0, len(listed) - 1).bit_length()


def templates_of(texts: Sequence[tuple[str, str]], threshold: float = THRESHOLD) -> list[Template]:
    found = [Template(i, label, text, threshold) for i, (label, text) in enumerate(texts)]
    if sum(len(t.words) for t in found) > MOST_WORDS:
        raise ValueError(f"the templates have more than {MOST_WORDS} words")
    return [t for t in found if t.words]


def _rivals(t: Template, templates: list[Template], threshold: float) -> list[int]:
    inside = lambda a, b: len({*a.words} & {*b.words}) >= threshold * len(a.words) - 1e-9
    return [o.number for o in templates if o is not t and (inside(o, t) or inside(t, o))]


def _ordered(docs: DataFrame, templates: list[Template]) -> list[str]:
    """The words of the templates, those in the fewest documents first (one row a word comes to the driver)."""
    known = sorted({w for t in templates for w in t.words})
    held = docs.select(F.explode(F.array_intersect(words(F.col("text")), _literal(known))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.w: r.n for r in held.collect()}
    return sorted(known, key=lambda w: (counts.get(w, 0), w.encode()))


def _literal(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _blocks(listed: Column, stride: int, first_words: list[str]) -> Column:
    """Blocks (2 x stride words every stride words) that hold a word of some prefix: (stride, block, words)."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(listed) - 1) / stride).cast("int")))
    cut = F.transform(starts, lambda i: F.struct(F.lit(stride).alias("stride"), i.alias("block"), F.slice(listed, i * stride + 1, F.lit(2 * stride)).alias("words")))
    return F.filter(cut, lambda b: F.arrays_overlap(b.words, _literal(first_words)))


def _scanned(docs: DataFrame, templates: list[Template], phrases: Sequence[tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    """Written (rid, id, base measures, blocks) of every document, and the order of the words."""
    ranked = _ordered(docs, templates)
    place = {w: i for i, w in enumerate(ranked)}
    strides = {}
    for t in templates:
        prefix = sorted(t.words, key=place.__getitem__)[: len(t.words) - t.need + 1]
        strides.setdefault(t.stride, set()).update(prefix)
    nothing = F.array().cast("array<struct<stride:int,block:int,words:array<string>>>")
    rare = _literal(sorted(set().union(*strides.values()))) if strides else None
    df = docs.select("id", words(F.col("text")).alias("_words")).withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("_line", F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")))
    # pieces of the line from one place of a phrase to the next
    for i, (phrase, _) in enumerate(phrases):
        df = df.withColumn(f"_cut{i}", F.split("_line", f"(?<= )(?={re.escape(phrase)} )"))
    counted = lambda piece: F.size(F.filter(F.split(piece, " "), lambda w: w != ""))
    per = [F.struct(
        (F.size(f"_cut{i}") - 1).cast("long").alias("n"),
        F.when(F.size(f"_cut{i}") > 1, counted(F.get(f"_cut{i}", F.lit(0))).cast("long")).alias("first"),
        F.when(F.size(f"_cut{i}") > 1, F.col("n_words") - counted(F.element_at(f"_cut{i}", -1))).alias("last"),
        F.lit(label).alias("label"),
    ) for i, (_, label) in enumerate(phrases)]
    kinds = "array<struct<n:bigint,first:bigint,last:bigint,label:string>>"
    df = df.withColumn("_found", F.filter(F.array(*per).cast(kinds), lambda p: p.n > 0))
    if strides:
        every = F.concat(*[_blocks(F.col("_words"), stride, sorted(first)) for stride, first in sorted(strides.items())])
        df = df.withColumn("_blocks", F.when(F.arrays_overlap("_words", rare), every).otherwise(nothing))
    else:
        df = df.withColumn("_blocks", nothing)
    # of a block only the words of the order count; the intersection has them in that order
    ordered = _literal(ranked)
    df = df.select(
        F.monotonically_increasing_id().alias("rid"), "id", "n_words", "_found",
        F.transform("_blocks", lambda b: F.struct(b.stride.alias("stride"), b.block.alias("block"), F.array_intersect(ordered, b.words).alias("words"))).alias("blocks"),
    )
    return written(df, "scanned"), ranked


def _matches(scanned: DataFrame, ranked: list[str], templates: list[Template], threshold: float) -> DataFrame:
    """(rid, stride, block, template, label, share, size, rivals) of every block that meets a template."""
    spark = scanned.sparkSession
    place = {w: i for i, w in enumerate(ranked)}
    rows = []
    for t in templates:
        own = sorted(t.words, key=place.__getitem__)
        rows += [(w, t.number, t.label, own, t.need, t.stride, _rivals(t, templates, threshold)) for w in own[: len(own) - t.need + 1]]
    index = spark.createDataFrame(rows, "word string, template int, label string, own array<string>, need int, stride int, rivals array<int>")
    block = scanned.select("rid", F.explode("blocks").alias("b")).select("rid", "b.stride", "b.block", F.col("b.words").alias("held"))
    least = min((t.need for t in templates), default=1)
    hit = block.filter(F.size("held") >= least).withColumn("word", F.explode(F.slice("held", F.lit(1), F.greatest(F.size("held") - least + 1, F.lit(0)))))
    met = hit.join(index, ["word", "stride"]).filter(F.size("held") >= F.col("need"))
    prefix = lambda words_, need: F.slice(words_, F.lit(1), F.greatest(F.size(words_) - need + 1, F.lit(0)))
    met = met.withColumn("_both", F.array_intersect(prefix(F.col("own"), F.col("need")), prefix(F.col("held"), F.col("need"))))
    last = F.element_at("_both", -1)
    rest = F.least(F.size("own") - F.array_position("own", last), F.size("held") - F.array_position("held", last))
    # a pair meets in several words; the first of them stands for it
    met = met.filter((F.size("_both") > 0) & (F.get("_both", F.lit(0)) == F.col("word")) & (F.size("_both") + rest >= F.col("need")))
    met = met.withColumn("_n", F.size(F.array_intersect("own", "held"))).filter(F.col("_n") >= F.col("need"))
    return met.select("rid", "stride", "block", "template", "label", (F.col("_n") / F.size("own")).alias("share"), F.size("own").alias("size"), "rivals")


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every block that meets a template: id, stride and number of the block (words from number x stride on), number
    of the template and its label, and the share of the template's words that the block holds."""
    templates = templates_of(texts, threshold)
    scanned, ranked = _scanned(_prepared(docs, id_col, text_col), templates, ())
    found = _matches(scanned, ranked, templates, threshold)
    return found.join(scanned.select("rid", "id"), "rid").select(F.col("id").alias(id_col), "stride", "block", "template", "label", "share")


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document: words, places of phrases (all, first, last), the phrases' labels, these with those of the
    templates, and a score: the largest share of a template that a block holds, 1 where a phrase stands."""
    templates = templates_of(texts, threshold)
    scanned, ranked = _scanned(_prepared(docs, id_col, text_col), templates, phrases)
    found = _matches(scanned, ranked, templates, threshold)
    per_block = found.groupBy("rid", "stride", "block").agg(F.collect_set(F.struct("template", "label", "share", "size", "rivals")).alias("all"))
    better = lambda a, b: F.array_contains(a.rivals, b.template) & (F.struct(b.share, b.size) > F.struct(a.share, a.size))
    best = F.filter("all", lambda a: ~F.exists("all", lambda b: better(a, b)))
    chosen = per_block.select("rid", F.explode(best).alias("t"))
    by_doc = written(chosen.groupBy("rid").agg(F.collect_set("t.label").alias("_more"), F.max("t.share").alias("_share")), "labels")
    base = F.array_distinct(F.transform("_found", lambda p: p.label))
    joined = scanned.drop("blocks").join(by_doc, "rid", "left").withColumn("_base", base)
    every = F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>")))
    return joined.select(
        F.col("id").alias(id_col), "n_words", F.aggregate("_found", F.lit(0).cast("long"), lambda n, p: n + p.n).alias("n_base"),
        F.array_min(F.transform("_found", lambda p: p["first"])).alias("first_word"), F.array_max(F.transform("_found", lambda p: p["last"])).alias("last_word"),
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"), F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )
