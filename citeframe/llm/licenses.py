"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame work only.

A block is a stretch of ``2 * width`` words of a text that begins at a multiple of ``width``; a template is looked for
in the blocks whose width is the power of two next above its length. Blocks overlap by half, so wherever a template's
words stand together, one block holds them all, however the text is wrapped, indented or marked as a comment. Its
tokens are the block's distinct lower-cased words. A template is found where a block holds at least ``THRESHOLD`` of
the template's tokens. Tokens are ordered by how many documents of the whole corpus have them, rarest first. Any block
that holds enough of a template shares a token of the template's prefix (as many of its rarest tokens as may miss, and
one) within its own prefix; the positions of a shared token bound how many can still follow; blocks with too few tokens
are left out at once. Only tokens that some template has are kept of a block, since no others can match. What remains
is verified by counting.

Besides that, phrases that name a license are counted where their words stand one after another.

Defined results: null and empty texts have no words and no labels; of several templates in a block, equally well held
or not, each is labelled; a template that two overlapping blocks hold is in ``matches`` twice; repeated rows are
separate rows with equal results; a very long text is cut to blocks like any other, its words being one array of its
row; an empty table gives an empty result; extra columns are ignored, whatever their names. Templates come as a mapping
or as a table (label, text); being a list of licenses, they go through the driver and into the plan.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store
from .arrow_text import text_column

THRESHOLD = 0.8
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Well-known wordings of public licenses.
TEMPLATES = {
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to "
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "apache-text": (
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "gpl-text": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version"
    ),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "mpl-text": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"
    ),
}

# Phrases with labels of their own, which don't count as base ones.
OWN_PHRASES = {"released under the mit license": "mit-phrase"}


def _words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def width_of(text: str) -> int:
    """Words by which the blocks for a template move on: the power of two next above its length."""
    return 1 << max(0, len(_words(text)) - 1).bit_length()


def needed(tokens: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * tokens - 1e-9))


def phrase_places(words: Column, phrases: Mapping[str, str]) -> Column:
    """Array of (start, label) of all places where a phrase's words stand one after another."""
    found = F.lit(None).cast("string")

    def label(word: Column, i: Column) -> Column:
        out = found
        for phrase, name in phrases.items():
            parts = phrase.split()
            hit = word == parts[0]
            for k, part in enumerate(parts[1:], 1):
                hit = hit & (F.get(words, i + k) == part)
            out = F.when(hit, F.lit(name)).otherwise(out)
        return F.struct(i.cast("long").alias("start"), out.alias("label"))

    return F.filter(F.transform(words, label), lambda x: x["label"].isNotNull())


def blocks_of(words: Column, width: int, vocabulary: list[str], least: int) -> Column:
    """Array of (width, first word, tokens) of the blocks with at least ``least`` tokens."""
    last = F.greatest(F.lit(0), F.ceil(F.size(words) / width).cast("int") - 2)

    def block(k: Column) -> Column:
        own = F.filter(F.slice(words, k * width + 1, 2 * width), lambda w: w.isin(vocabulary))
        return F.struct(F.lit(width).alias("width"), (k * width).alias("block"), F.array_distinct(own).alias("tokens"))

    return F.filter(F.transform(F.sequence(F.lit(0), last), block), lambda b: F.size(b["tokens"]) >= least)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: Mapping[str, str] = PHRASES,
         templates: Mapping[str, str] | DataFrame = TEMPLATES, threshold: float = THRESHOLD,
         own_phrases: Mapping[str, str] = OWN_PHRASES) -> DataFrame:
    """A row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the
    best containment of a template, 1 for a phrase, 0 for none) and matches (block's first word, template, containment)."""
    spark = docs.sparkSession
    if isinstance(templates, DataFrame):
        templates = {r["label"]: r["text"] for r in templates.select("label", "text").collect()}
    sets = {name: sorted(set(_words(whole))) for name, whole in templates.items() if _words(whole or "")}
    widths: dict[int, list[str]] = {}
    for name in sets:
        widths.setdefault(width_of(templates[name]), []).append(name)
    least = {w: min(needed(len(sets[n]), threshold) for n in names) for w, names in widths.items()}
    vocabulary = sorted({t for tokens in sets.values() for t in tokens})

    # phrases are looked for in texts that hold their last word at all
    last = "|".join(sorted({p.split()[-1] for p in (*phrases, *own_phrases)}))
    nowhere = F.array().cast("array<struct<start:bigint,label:string>>")
    words = F.regexp_extract_all(F.translate("_text", UPPER, LOWER), F.lit(WORD), F.lit(0))
    slim = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"), text_column(docs, text).alias("_text"))
    slim = slim.select("_row", "doc_id", words.alias("words"), F.col("_text").rlike(f"(?i)({last})").alias("named"))

    def places(of: Mapping[str, str]) -> Column:
        return F.when(F.col("named"), phrase_places(F.col("words"), of)).otherwise(nowhere)

    blocks = [blocks_of(F.col("words"), w, sorted({t for n in names for t in sets[n]}), least[w]) for w, names in sorted(widths.items())]
    no_blocks = F.array().cast("array<struct<width:int,block:int,tokens:array<string>>>")
    slim = slim.select(
        "_row", "doc_id", F.size("words").cast("long").alias("n_words"), places(phrases).alias("places"),
        places(own_phrases).alias("own_places"), F.concat(no_blocks, *blocks).alias("blocks"),
        F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary))).alias("known"),
    )
    slim = store(slim, "blocks")

    counts = slim.select(F.explode("known").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    # one row per template token at most: the order is as small as the templates
    order = [r["token"] for r in counts.orderBy("n", "token").collect()]
    order = [t for t in vocabulary if t not in set(order)] + order
    rank = {t: k for k, t in enumerate(order)}
    index = []
    for width, names in widths.items():
        for name in names:
            own = sorted(sets[name], key=rank.__getitem__)
            need = needed(len(own), threshold)
            index += [(t, width, name, i, len(own), need, own) for i, t in enumerate(own[: len(own) - need + 1])]
    index = spark.createDataFrame(index, "token string, width int, template string, i int, size int, need int, own array<string>")

    ranks = F.create_map(*[x for t, k in rank.items() for x in (F.lit(t), F.lit(k))]) if rank else F.create_map().cast("map<string,int>")
    shortest = F.coalesce(*[F.when(F.col("width") == w, n) for w, n in least.items()], F.lit(1))
    ordered = F.transform(F.array_sort(F.transform("tokens", lambda t: F.struct(ranks[t].alias("rank"), t.alias("token")))), lambda s: s["token"])
    blocks = slim.select("_row", F.inline("blocks")).withColumn("tokens", ordered)
    heads = blocks.select("_row", "width", "block", "tokens", F.posexplode(F.slice("tokens", F.lit(1), F.size("tokens") - shortest + 1)).alias("j", "token"))
    reach = 1 + F.least(F.col("size") - 1 - F.col("i"), F.size("tokens") - 1 - F.col("j"))
    fits = (F.size("tokens") >= F.col("need")) & (reach >= F.col("need"))
    candidates = heads.join(F.broadcast(index), ["token", "width"]).where(fits).dropDuplicates(["_row", "width", "block", "template"])
    shared = F.size(F.array_intersect("tokens", "own"))
    matches = candidates.where(shared >= F.col("need")).select("_row", F.struct("block", "template", (shared / F.col("size")).alias("share")).alias("m"))
    # blocks times templates of one text at most
    matches = matches.groupBy("_row").agg(F.sort_array(F.collect_list("m")).alias("matches"))

    def labels(column: str) -> Column:
        return F.transform(column, lambda p: p["label"])

    base = F.array_sort(F.array_distinct(labels("places")))
    none = F.array().cast("array<struct<block:int,template:string,share:double>>")
    own = F.concat(labels("own_places"), F.transform(F.coalesce("matches", none), lambda m: m["template"]))
    starts = F.transform("places", lambda p: p["start"])
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))
    score = F.when((F.size("places") > 0) | (F.size("own_places") > 0), 1.0).otherwise(best)
    return slim.drop("blocks").join(matches, "_row", "left").select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"), score.alias("score"), "matches",
    )
