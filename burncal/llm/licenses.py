"""License scans, with DataFrame functions only.

Texts and templates are lower-cased word sequences (letters and digits), shingles are five words. For each template size n
(in words) the text is cut into windows of n words that overlap: they start at every STEP-th word (an eighth of n, at least
1) and are kept where they hold a shingle of some template of that size. A window's MinHash signature, BANDS bands of ROWS
values, retrieves the templates of its size that agree with it in some band. The window on the grid nearest to a notice with 0.8
of a template's shingles has a Jaccard similarity of about 0.6 at least, so it is retrieved with probability
1 - (1 - 0.6^2)^24 > 0.9999. Then exact containment decides: at least 0.8 of the template's shingles in the window and STEP
words on either side. So a place is reported too whose 0.8 of the shingles lie in a window wider by STEP words on both sides.

Scale. The templates are a fixed list of bounded size and are broadcast; a first look at the raw text for words that every match
has to contain keeps most texts out of all later steps. Only windows that matched are grouped, by document and template.

Cases: null and empty texts, and texts with fewer than five words, match nothing; a notice with a null doc_id is reported with it;
very long texts are cut into windows like any other; repeated rows give one row; of several places the best, then the first, is reported; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burncal.llm.common import id_and_text

SHINGLE = 5
BANDS, ROWS = 24, 2
CONTAINMENT = 0.8

#: Notices as their authors ask to write them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def required_words(templates: list[tuple[str, str]]) -> list[str]:
    """A word of each template, the longest that will do, without which CONTAINMENT of its shingles can't be there."""
    out = set()
    for _, text in templates:
        words = words_of(text)
        shingles = [words[i : i + SHINGLE] for i in range(len(words) - SHINGLE + 1)]
        needed = math.ceil(CONTAINMENT * len({*map(tuple, shingles)}) - 1e-9)
        fitting = [w for w in words if len({tuple(s) for s in shingles if w not in s}) < needed]
        # the longest such word; with none, every one of the words counts
        out |= {max(fitting, key=lambda w: (len(w), w))} if fitting else set(words)
    return sorted(out)


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _shingles(words: Column) -> Column:
    """Hashes of the runs of five words, in order."""

    def hashes(own: Column) -> Column:
        places = F.when(F.size(own) >= SHINGLE, F.sequence(F.lit(1), F.size(own) - (SHINGLE - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice(own, i, SHINGLE), " ")))

    return _let(words, hashes)


def _bands(shingles: Column) -> Column:
    """One hash for each band of the MinHash signature."""

    def least(own: Column, seed: int) -> Column:
        return F.array_min(F.transform(own, lambda h: F.xxhash64(h, F.lit(seed))))

    return _let(shingles, lambda own: F.array(*(F.xxhash64(F.lit(b), *(least(own, b * ROWS + r) for r in range(ROWS))) for b in range(BANDS))))


def template_table(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """template, license, n (words), step, shingles, bands: one row for each template."""
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, license string, text string").withColumn("words", _words(F.col("text")))
    table = table.withColumn("n", F.size("words")).withColumn("shingles", F.array_distinct(_shingles(F.col("words"))))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 8).cast("int"))
    return table.select("template", "license", "n", step.alias("step"), "shingles", _bands(F.col("shingles")).alias("bands"))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, template, containment, first_word, n_words, of the best place of each template in each document."""
    known = template_table(docs.sparkSession, templates)
    own = id_and_text(docs, id_col, text_col)
    low = F.lower(F.col("text"))
    maybe = own.filter(functools.reduce(operator.or_, (F.contains(low, F.lit(w)) for w in required_words(templates))))
    hashed = maybe.select("doc_id", F.xxhash64("text").alias("text_hash"), _shingles(_words(F.col("text"))).alias("sh"))
    sizes = known.select("n", "step", F.explode("shingles").alias("h")).distinct()
    every = sorted({r.h for r in sizes.select("h").collect()})  # the shingles of the fixed templates
    marked = hashed.filter(F.arrays_overlap("sh", F.array(*map(F.lit, every))))
    met = marked.select("doc_id", "text_hash", "sh", F.posexplode("sh").alias("p", "h")).join(F.broadcast(sizes), "h")
    # the starts on the grid of the windows of n words that hold this shingle
    low_end = F.greatest(F.lit(0), F.ceil((F.col("p") - (F.col("n") - SHINGLE)) / F.col("step")).cast("int") * F.col("step"))
    high_end = F.floor(F.col("p") / F.col("step")).cast("int") * F.col("step")
    starts = F.when(low_end <= high_end, F.sequence(low_end, high_end, F.col("step"))).otherwise(F.array(high_end))
    windows = met.select("doc_id", "text_hash", "n", "step", "sh", F.explode(starts).alias("start"))
    width = F.col("n") - (SHINGLE - 1)
    before = F.greatest(F.lit(0), F.col("start") - F.col("step"))
    windows = windows.select(
        "doc_id", "text_hash", "n", "start",
        F.slice("sh", F.col("start") + 1, width).alias("inside"),
        F.slice("sh", before + 1, F.col("start") - before + width + F.col("step")).alias("around"),
    ).dropDuplicates(["doc_id", "text_hash", "n", "start"])
    signed = windows.select("doc_id", "text_hash", "n", "start", "around", _bands(F.col("inside")).alias("bands"))
    t, w = F.broadcast(known.alias("t")), signed.alias("w")
    retrieved = w.join(t, (F.col("w.n") == F.col("t.n")) & F.arrays_overlap("w.bands", "t.bands"))
    share = F.size(F.array_intersect("t.shingles", "w.around")) / F.size("t.shingles")
    verified = retrieved.select("w.doc_id", "w.text_hash", "t.license", "t.template", "t.n", "w.start", share.alias("containment")).filter(F.col("containment") >= CONTAINMENT)
    best = verified.groupBy("doc_id", "text_hash", "license", "template", "n").agg(F.max(F.struct("containment", (-F.col("start")).alias("back"))).alias("b"))
    return best.select("doc_id", "license", "template", F.round("b.containment", 6).alias("containment"), (-F.col("b.back")).cast("int").alias("first_word"), F.col("n").alias("n_words"))
