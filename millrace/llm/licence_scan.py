"""Licence scans: an exact containment join of text blocks with licence templates, in DataFrame operations only.

A text is a run of words, A-Z in lower case; its blocks are windows of ``BLOCK`` words, or ``SHORT_BLOCK`` for templates of at most
half as many, each starting half a block after the one before, so that a template lies whole in one. A block meets a template if
it holds at least 80 % of its distinct words. Words of templates and blocks are ordered by how many texts hold them, the rarest first. With
``needed`` words in common, the first common word is one of the first ``|template| - needed + 1`` of the template's and of the first
``|block| - needed + 1`` of the block's (prefix), the block has ``needed`` words (length), and as many are left from that word on in both
(position); only pairs that pass are counted in full.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import named, staged

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK = 400
SHORT_BLOCK = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a template that a block needs, in percent.
NEEDED = 80
#: Phrases whose places are counted, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Opening or identifying words of well-known licences, with their labels.
TEMPLATES = [
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the Software to deal in the Software without restriction including without limitation the "
            "rights to use copy modify merge publish distribute sublicense and or sell copies of the Software"),
    ("mit", "SPDX License Identifier MIT"),
    ("apache", "Licensed under the Apache License Version 2 0 the License you may not use this file except in compliance with "
               "the License You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License Version 2 0"),
    ("gpl", "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation either version 3 of the License or at your option any later "
            "version"),
    ("gpl", "This work is licensed under the GNU General Public License version 3"),
    ("lgpl", "This library is free software you can redistribute it and or modify it under the terms of the GNU Lesser General "
             "Public License as published by the Free Software Foundation"),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met Redistributions of source code must retain the above copyright notice this list of "
            "conditions and the following disclaimer"),
    ("isc", "Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License v 2 0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4 0 International License"),
    ("cc-by-nc", "Licensed under CC BY NC 4 0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SEPARATORS), "")


def literal_words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def template_words(templates: list[tuple[str, str]]) -> list[tuple[str, list[str], int, int]]:
    """Label, distinct words, how many of them a block needs, and the size of blocks."""
    out = []
    for label, text in templates:
        distinct = list(dict.fromkeys(text.lower().split()))
        if not 0 < len(distinct) <= BLOCK // 2:
            raise ValueError("a template must have words, at most half a block of distinct ones")
        block = SHORT_BLOCK if len(distinct) <= SHORT_BLOCK // 2 else BLOCK
        out.append((label, distinct, -(-NEEDED * len(distinct) // 100), block))
    return out


def phrase_places(w: Column, phrase: str) -> Column:
    """Starts of all places where the phrase's words follow each other."""
    parts = phrase.split()
    starts = F.when(F.size(w) >= len(parts), F.sequence(F.lit(0), F.size(w) - len(parts))).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: reduce(lambda a, b: a & b, [F.get(w, i + k) == p for k, p in enumerate(parts)]))


def block_words(w: str, size: int, known: Column) -> Column:
    """The known words of each block of ``size`` words."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - size // 2, F.lit(1)), F.lit(size // 2))
    return F.transform(starts, lambda s: F.array_intersect(F.slice(w, s, size), known))


def scan_texts(docs: DataFrame, id_col: str, text_col: str, templates: list[tuple[str, str]]) -> DataFrame:
    """One pass over the texts: word counts, places of phrases, words shared with the templates, blocks worth a look.

    Blocks are kept only of texts that as a whole have enough words of some template, the length filter for all blocks at
    once.
    """
    sets = template_words(templates)
    vocabulary = sorted({x for _, ws, _, _ in sets for x in ws} | {p.split()[-1] for p in PHRASES})
    base = docs.select(named(id_col).alias("_id"), words(named(text_col)).alias("_w"))
    base = base.withColumn("_shared", F.array_intersect("_w", literal_words(vocabulary)))
    none = F.array().cast("array<int>")
    for i, phrase in enumerate(PHRASES):
        last = phrase.split()[-1]
        base = base.withColumn(f"_p{i}", F.when(F.array_contains("_shared", last), phrase_places(F.col("_w"), phrase)).otherwise(none))
    blocks = {}
    for size in sorted({size for *_, size in sets}):
        own = [(ws, need) for _, ws, need, block in sets if block == size]
        known = literal_words(sorted({x for ws, _ in own for x in ws}))
        enough = reduce(lambda a, b: a | b, [F.size(F.array_intersect("_shared", literal_words(ws))) >= need for ws, need in own])
        blocks[f"_blocks{size}"] = F.when(enough, block_words("_w", size, known))
    return base.select(
        F.monotonically_increasing_id().alias("_row"), "_id", F.size("_w").cast("long").alias("_n"), "_shared",
        *[f"_p{i}" for i in range(len(PHRASES))], *[b.alias(name) for name, b in blocks.items()],
    )


def meet_templates(scanned: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """Pairs of blocks and templates: ``_row, _at`` (the block's first word), ``_template, label, held`` (the share of the template's words).

    The templates are a parameter: their words' counts over all texts, one row per word of the templates, order them on the driver, and
    their prefixes are the broadcast side of the join.
    """
    sets = template_words(templates)
    counted = scanned.select(F.explode("_shared").alias("word")).groupBy("word").agg(F.count("*").alias("texts"))
    texts = {r["word"]: r["texts"] for r in counted.collect()}
    order = sorted({x for _, ws, _, _ in sets for x in ws}, key=lambda x: (texts.get(x, 0), x))
    rank = {x: i for i, x in enumerate(order)}
    prefixes = []
    for i, (label, ws, need, size) in enumerate(sets):
        ranked = sorted(ws, key=rank.__getitem__)
        prefixes += [(i, label, need, size, ranked, at, ranked[at]) for at in range(len(ranked) - need + 1)]
    prefix = scanned.sparkSession.createDataFrame(
        prefixes, "_template int, label string, need int, _size int, _sorted array<string>, _of_template int, word string"
    )
    parts = []
    for size in sorted({size for *_, size in sets}):
        least = min(need for _, _, need, block in sets if block == size)
        held = scanned.filter(F.col(f"_blocks{size}").isNotNull()).select("_row", F.posexplode(f"_blocks{size}").alias("_block", "_words"))
        held = held.filter(F.size("_words") >= least).select(
            "_row", F.lit(size).alias("_size"), (F.col("_block") * (size // 2)).alias("_at"),
            F.array_intersect(literal_words(order), "_words").alias("_has"), F.lit(least).alias("_least"),
        )
        parts.append(held)
    blocks = reduce(DataFrame.unionByName, parts)
    front = F.slice("_has", F.lit(1), F.size("_has") - F.col("_least") + 1)
    probes = blocks.select("_row", "_size", "_at", "_has", F.posexplode(front).alias("_of_block", "word"))
    first = probes.join(F.broadcast(prefix), ["_size", "word"]).filter(F.col("_of_block") + F.col("need") <= F.size("_has"))
    first = first.groupBy("_row", "_size", "_at", "_template", "label", "need").agg(
        F.min("_of_block").alias("_of_block"), F.min("_of_template").alias("_of_template"),
        F.any_value("_has").alias("_has"), F.any_value("_sorted").alias("_sorted"),
    )
    left = F.least(F.size("_has") - F.col("_of_block"), F.size("_sorted") - F.col("_of_template"))
    held = F.size(F.array_intersect("_has", "_sorted"))
    return first.filter((left >= F.col("need")) & (held >= F.col("need"))).select(
        "_row", "_at", "_template", "label", (held / F.size("_sorted")).alias("held")
    )


def scan_licences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None,
    work: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, word count, places of phrases, the blocks that meet templates, labels and a score.

    Returns ``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks`` (blocks: first word, label and
    share). The score is 1 if a phrase occurs, else the largest share of a template that was met, else 0. Null and empty
    texts have no words, no labels and score 0; repeated rows and null ids are scanned as any other; other columns are
    not read. An empty table gives an empty result.
    """
    templates = templates or TEMPLATES
    scanned = staged(scan_texts(docs, id_col, text_col, templates), "licence-scan", work)
    met = meet_templates(scanned, templates).groupBy("_row").agg(
        F.array_sort(F.collect_set(F.struct(F.col("_at").alias("first_word"), "label", "held"))).alias("blocks")
    )
    places = F.array_sort(F.flatten(F.array(*[f"_p{i}" for i in range(len(PHRASES))])))
    base = F.array_compact(F.array(*[F.when(F.size(f"_p{i}") > 0, label) for i, label in enumerate(PHRASES.values())]))
    out = scanned.join(met, "_row", "left").withColumns(
        {"_places": places, "_base": base, "blocks": F.coalesce("blocks", F.array().cast(met.schema["blocks"].dataType))}
    )
    found = F.transform("blocks", lambda b: b["label"])
    return out.select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_words"), F.size("_places").cast("long").alias("n_base"),
        F.get("_places", F.lit(0)).cast("long").alias("first_word"),
        F.get("_places", F.size("_places") - 1).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("_base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", found)), ",").alias("labels"),
        F.when(F.size("_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["held"])), F.lit(0.0)))
        .alias("score"),
        "blocks",
    )
