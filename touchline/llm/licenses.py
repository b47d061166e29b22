"""License notices in documents: a MinHash sketch of every template nominates it, exact containment in the whole text verifies it.

All of it is DataFrame expressions. Texts and templates are words ``[a-z0-9]+`` in lower case, and shingles of three.
The sketch of a template is its smallest shingles in a seeded order, one more than a document may lack. A document that
holds enough of the template therefore holds one of the sketch, wherever in the text and in whatever order its shingles
are, so no match is lost. Only texts with an anchor, a word that is chosen from every template shingle, are split into
words; no other text holds a template shingle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.lineage import cut_lineage

SHINGLE = 3  # words
SEED = 9  # of the order of a template's shingles
CONTAINED = 0.8  # share of a template's shingles that a document must hold
BROADCAST_ROWS = 200_000
# Public license notices as projects print them. The opening that both BSD texts share is named BSD; the clause that only
# one of them has is BSD-3-Clause. Of licenses with like notices, only the words that tell them apart are listed.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                         "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                         "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("LGPL", "under the terms of the GNU Lesser General Public License"),
    ("AGPL", "under the terms of the GNU Affero General Public License"),
    ("ISC", "with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("EPL-1.0", "under the terms of the Eclipse Public License v1.0"),
    ("EPL-2.0", "under the terms of the Eclipse Public License 2.0"),
    ("EPL-2.0", "under the terms of the Eclipse Public License v2.0"),
    ("EPL-2.0", "under the terms of the Eclipse Public License v. 2.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(NOTICES)], "template_id int, license string, text string")


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """Hash of the three words from each word on; a text of fewer words has one, of all its words."""
    at = F.sequence(F.lit(1), F.greatest(F.size(words) - SHINGLE + 1, F.lit(1)))
    return F.when(F.size(words) > 0, F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " ")))).otherwise(
        F.lit([]).cast("array<bigint>"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a name for ``value``, so that lambdas in it do not work ``value`` out again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def template_sketches(templates: DataFrame) -> DataFrame:
    """``template_id``, ``license``, ``mine`` (its distinct shingles in the seeded order) and ``sketch`` (the first of them)."""
    split = templates.select("template_id", "license", _words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    ordered = F.array_sort(F.transform(F.array_distinct(_shingles(F.col("w"))), lambda s: F.struct(F.xxhash64(F.lit(SEED), s).alias("order"), s.alias("s"))))
    mine = split.select("template_id", "license", F.transform(ordered, lambda o: o["s"]).alias("mine"))
    may_lack = F.size("mine") - F.ceil(F.lit(CONTAINED) * F.size("mine")).cast("int")
    return mine.withColumn("sketch", F.slice("mine", F.lit(1), may_lack + 1))


def anchors(texts: list[str]) -> list[str]:
    """Words such that every shingle of the templates holds one: the longest of the shingle, where it has none yet."""
    chosen: set[str] = set()
    for text in texts:
        words = words_of(text)
        for i in range(max(len(words) - SHINGLE + 1, 1) if words else 0):
            three = words[i : i + SHINGLE]
            if not chosen.intersection(three):
                chosen.add(max(three, key=lambda w: (len(w), w)))
    return sorted(chosen)


def scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """For every row of ``docs``: ``doc_id``, ``licenses`` (names found, sorted, comma-separated; empty for none), ``n_licenses``,
    ``best`` (largest share of a found template's distinct shingles that the whole text holds, 0 for none).

    ``templates`` (``template_id``, ``license``, ``text``; default :data:`NOTICES`) are a table of reference texts, read
    by the driver for the anchors; texts may hold their shingles anywhere. NULL and empty texts have no license, a NULL
    doc_id stays NULL, rows that repeat are reported alike, other columns are left aside, an empty table (of either
    kind) gives no finding.
    """
    templates = default_templates(docs.sparkSession) if templates is None else templates
    sketches = cut_lineage(template_sketches(templates))
    known = [r["text"] or "" for r in templates.select("text").collect()]
    words = anchors(known)
    own = docs.select("doc_id", F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    rows = own.withColumn("same", F.xxhash64("text"))
    if not words:
        found = None
    else:
        every, nominating = (sorted(r["s"] for r in sketches.select(F.explode(c).alias("s")).distinct().collect()) for c in ("mine", "sketch"))
        anchored = rows.filter(F.col("text").rlike("(?<![a-z0-9])(?:" + "|".join(words) + ")(?![a-z0-9])"))
        theirs = _let(_words(F.col("text")), lambda w: F.array_distinct(F.filter(_shingles(w), lambda s: s.isin(every))))
        marked = anchored.select("doc_id", "same", theirs.alias("theirs"))
        opened = marked.select("doc_id", "same", "theirs", F.explode(F.filter("theirs", lambda s: s.isin(nominating))).alias("s"))
        lookup = sketches.select("license", "mine", F.explode("sketch").alias("_s"))
        if lookup.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            lookup = F.broadcast(lookup)
        met = opened.join(lookup, F.col("s") == F.col("_s"))
        held = met.select("doc_id", "same", "license", F.size("mine").alias("total"), F.size(F.array_intersect("mine", "theirs")).alias("n"))
        held = held.filter(F.col("n") >= CONTAINED * F.col("total")).withColumn("share", F.col("n") / F.col("total"))
        found = held.groupBy("doc_id", "same").agg(F.sort_array(F.collect_set("license")).alias("names"), F.max("share").alias("best"))
    slim = rows.select("doc_id", "same")
    if found is None:
        return slim.select("doc_id", F.lit("").alias("licenses"), F.lit(0).alias("n_licenses"), F.lit(0.0).alias("best"))
    found = found.select(F.col("doc_id").alias("_doc"), F.col("same").alias("_same"), "names", "best")
    joined = slim.join(found, slim["doc_id"].eqNullSafe(found["_doc"]) & (slim["same"] == found["_same"]), "left")
    return joined.select("doc_id", F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"), F.coalesce(F.size("names"), F.lit(0)).alias("n_licenses"),
                         F.coalesce("best", F.lit(0.0)).alias("best"))
