"""License scans: MinHash bands over overlapping windows, then exact shingle containment (operator 1). DataFrame
functions only.

Templates are word sequences of license notices. A text's words are lower-cased runs of letters, digits and inner
points; shingles are ``SHINGLE`` words (a shorter template: all of its words). Templates of like length share a class,
and each class looks at overlapping windows of the text: as long as the longest template of the class, ``stride``
words apart. A window's MinHash bands are joined with those of the templates; a candidate counts if the window holds
``CONTAINED`` of the template's distinct shingles exactly.

Band settings: a window that holds CONTAINED of a template has a Jaccard similarity of at least ``LEAST_JACCARD`` with
it (the classes' bounds and ``stride_of`` see to that), and with ``BANDS`` bands of ``ROWS`` rows such a pair collides
with probability 1 - (1 - J^ROWS)^BANDS, over 0.9999.

Texts and windows that can't match are left out first, without loss: ``anchors`` picks words such that fewer than
CONTAINED of each template's shingles are free of them, so a window that matches has a shingle with an anchor.

Templates are literals of the plan, a list in code; the band join broadcasts up to ``BROADCAST_TEMPLATES`` of them and
leaves more to Spark. Candidates only meet the templates of their own bands.

Versions of a wording match each other's passages. Every template that a text holds is returned; ``in_fuller`` says that
each of its windows overlaps a fuller match of another version of the same wording.

Defined cases: null, empty and shorter texts match nothing. Rows that are equal in doc_id and text give one result, as do
two rows without doc_id that have the same text. A very long text is scanned whole; an empty table gives no rows;
columns beside doc_id and text don't matter, whatever their names.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINED = 0.8
BANDS = 32
ROWS = 2
LEAST_JACCARD = 0.55
BROADCAST_TEMPLATES = 1000

#: Wordings of well-known license notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    (
        "LGPL",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("all-rights-reserved", "All rights reserved."),
)


def words_of(text: Column) -> Column:
    """Words of a text: lower-cased runs of letters and digits, with points inside kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*"), F.lit(0))


def python_words(text: str) -> list[str]:
    """The words of a template: as ``words_of`` has them."""
    out, word = [], ""
    for k, c in enumerate(text.lower() + " "):
        if c.isalnum() or c == "." and word and k + 1 < len(text) and text[k + 1].isalnum():
            word += c
        elif word:
            out, word = [*out, word], ""
    return out


def shingles_of(words: list[str]) -> list[str]:
    n = min(SHINGLE, len(words))
    return list(dict.fromkeys(" ".join(words[k : k + n]) for k in range(len(words) - n + 1)))


def anchors(all_shingles: list[list[str]]) -> list[str]:
    """Words such that less than CONTAINED of any template's shingles are free of them: rare words first, those that
    serve most templates."""
    chosen: list[str] = []
    free = [set(s) for s in all_shingles]
    needy = lambda k: len(free[k]) >= CONTAINED * len(all_shingles[k])
    while left := [k for k in range(len(free)) if needy(k)]:
        gain = Counter(w for k in left for w in {w for s in free[k] for w in s.split() if len(w) > 2})
        if not gain:
            gain = Counter(w for k in left for s in free[k] for w in s.split())
        word = min(gain, key=lambda w: (-gain[w] * len(w), w))
        chosen.append(word)
        free = [{s for s in f if word not in s.split()} for f in free]
    return chosen


def stride_of(n: int) -> int:
    """Words between the windows of a class whose shortest template has n words: a window holds a template whole,
    and little else, wherever it stands."""
    return max(1, n // 8)


def classes(templates=TEMPLATES) -> list[list[tuple[int, str, list[str]]]]:
    """Templates (number, license, words) of like length together: the longest is at most an eighth longer."""
    found = sorted(((k, name, python_words(text)) for k, (name, text) in enumerate(templates)), key=lambda t: (len(t[2]), t[0]))
    out: list[list] = []
    for t in found:
        if not t[2]:
            raise ValueError("a template has no words")
        small = min(len(t[2]), SHINGLE)
        if out and len(t[2]) <= len(out[-1][0][2]) * 1.125 and small == min(len(out[-1][0][2]), SHINGLE):
            out[-1].append(t)
        else:
            out.append([t])
    return out


def bands(hashes: Column) -> Column:
    """An array of BANDS hashes, each of ROWS minima over an array of shingle hashes."""
    least = lambda k: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(k))))
    return F.array(*[F.xxhash64(F.lit(b), *[least(b * ROWS + r) for r in range(ROWS)]) for b in range(BANDS)])


def starts_of(group: list[tuple[int, str, list[str]]], number: int, anchor: Column) -> Column:
    """(class, start, length, shingle) of each window of a class with an anchor in it, of the column words."""
    size, shingle = max(len(w) for _, _, w in group), min(SHINGLE, len(group[0][2]))
    stride = stride_of(len(group[0][2]))
    length = size + stride - 1
    last = F.greatest(F.lit(0), F.ceil((F.size("words") - length) / stride).cast("int"))
    # the windows k with k * stride <= hit < k * stride + length
    near = F.transform("hits", lambda i: F.sequence(F.greatest(F.lit(0), F.ceil((i - length + 1) / stride).cast("int")), F.greatest(F.lit(0), F.least(last, F.floor(i / stride).cast("int")))))
    found = F.filter(F.array_distinct(F.flatten(near)), lambda k: k * stride + shingle <= F.size("words"))
    return F.transform(found, lambda k: F.struct(F.lit(number).alias("class"), (k * stride).alias("start"), F.lit(length).alias("length"), F.lit(shingle).alias("shingle")))


def windows_of(rows: DataFrame, groups: list, anchor: Column) -> DataFrame:
    """doc_id, digest, class, start, shingle, held of all windows that can match, their shingles as hashes in order. rows: doc_id, digest, words."""
    hits = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(anchor, w), i)), lambda i: i.isNotNull())
    starts = F.concat(*[starts_of(g, c, anchor) for c, g in enumerate(groups)])
    windows = rows.select("*", hits.alias("hits")).where(F.size("hits") > 0).select("doc_id", "digest", "words", F.explode(starts).alias("x"))
    windows = windows.select("doc_id", "digest", "x.class", "x.start", "x.shingle", F.slice("words", F.col("x.start") + 1, F.col("x.length")).alias("part"))
    held = F.transform(F.sequence(F.lit(0), F.size("part") - F.col("shingle")), lambda i: F.xxhash64(F.array_join(F.slice("part", i + 1, F.col("shingle")), " ")))
    return windows.select("doc_id", "digest", "class", "start", "shingle", held.alias("held"))


def variants_of(templates) -> dict[int, list[int]]:
    """For each template the others whose wording alone is a match of it: a text that holds one of these more fully
    holds that one instead."""
    every = [set(shingles_of(python_words(text))) for _, text in templates]
    return {k: [j for j, other in enumerate(every) if j != k and len(mine & other) >= CONTAINED * len(mine)] for k, mine in enumerate(every)}


def template_table(spark, groups: list[list[tuple[int, str, list[str]]]], variants: dict[int, list[int]]) -> DataFrame:
    """class, template, license, variants, wanted: the templates, shingles as hashes."""
    rows = [(c, k, name, variants[k], shingles_of(words)) for c, group in enumerate(groups) for k, name, words in group]
    table = spark.createDataFrame(rows, "class int, template int, license string, variants array<int>, shingles array<string>")
    return table.select("class", "template", "license", "variants", F.transform("shingles", lambda s: F.xxhash64(s)).alias("wanted"))


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, template, license, containment, start, windows, in_fuller of each document and template that it holds: the
    best window's share of the template's shingles, the first such window's word, how many windows hold it, and whether
    all of them overlap a fuller match of another version of the wording (windows that don't come first)."""
    groups = classes(templates)
    words = sorted(anchors([shingles_of(w) for group in groups for _, _, w in group]))
    anchor = F.array(*map(F.lit, words))
    text = F.col("text").cast("string")
    # a match has an anchor among its words, so the text has it as a string
    rough = F.lower(text).rlike("|".join(w.replace(".", r"\.") for w in words))
    rows = docs.where(rough).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), words_of(text).alias("words"))
    windows = windows_of(rows, groups, anchor)
    keyed = windows.select("*", F.posexplode(bands(F.col("held"))).alias("band", "key"))
    table = template_table(docs.sparkSession, groups, variants_of(templates))
    keys = table.select("*", F.posexplode(bands(F.col("wanted"))).alias("band", "key"))
    met = keyed.join(F.broadcast(keys) if len(templates) <= BROADCAST_TEMPLATES else keys, ["class", "band", "key"])
    share = F.size(F.array_intersect("wanted", "held")) / F.size("wanted")
    at = F.filter(F.transform("held", lambda h, i: F.when(F.array_contains("wanted", h), i)), lambda i: i.isNotNull())
    held = met.withColumn("containment", share).where(F.col("containment") >= CONTAINED).withColumn("at", at)
    match = F.struct("template", "license", "variants", "containment", "start", (F.col("start") + F.array_min("at")).alias("begin"), (F.col("start") + F.array_max("at") + F.col("shingle")).alias("end"))
    held = held.select("doc_id", "digest", match.alias("x")).distinct()
    # matches meet in pieces of the text as long as the longest window, so however many a text has, few are together
    piece = max(max(len(w) for _, _, w in group) + stride_of(len(group[0][2])) for group in groups)
    pieces = F.array_distinct(F.array(F.floor(F.col("x.begin") / piece), F.floor((F.col("x.end") - 1) / piece)))
    near = held.withColumn("piece", F.explode(pieces)).groupBy("doc_id", "digest", "piece").agg(F.collect_list("x").alias("all"))
    fuller = lambda x, y: F.array_contains(x.variants, y.template) & (y.containment > x.containment) & (y.begin < x.end) & (x.begin < y.end)
    told = F.transform("all", lambda x: F.struct(x.alias("x"), F.exists("all", lambda y: fuller(x, y)).alias("hidden")))
    each = near.select("doc_id", "digest", F.explode(told).alias("t")).groupBy("doc_id", "digest", "t.x").agg(F.max("t.hidden").alias("hidden"))
    best = F.max(F.struct((~F.col("hidden")).alias("shown"), "x.containment", (-F.col("x.start")).alias("before")))
    found = each.groupBy("doc_id", "digest", "x.template", "x.license").agg(best.alias("best"), F.count_distinct("x.start").alias("windows"))
    return found.select("doc_id", "template", "license", F.col("best.containment").alias("containment"), (-F.col("best.before")).cast("int").alias("start"), "windows", (~F.col("best.shown")).alias("in_fuller"))
