"""Licence statements by Dice coefficient over word bigrams.

Text is normalised (lower case, everything but letters and digits becomes one
space), so comment signs and line breaks do not count.  Passages are compared to
licence templates by the Dice coefficient of their sets of word bigrams:

* windows of a template's number of words, anywhere in a text: a licence in
  wrapped lines, in comments, inside a longer line or file.  A window is placed
  where a bigram of the template's prefix stands as in the template; it counts
  unless one that overlaps it has a higher score.
* each line, and the text as a whole, against the notices (short templates): a
  statement with words put in.

Both are pruned without losing a match.  With threshold t a passage of a bigrams
can match a template of b only if b * t / (2 - t) <= a <= b * (2 - t) / t (a
window has a = b or fewer), and a match shares more bigrams than are left when
any ``prefix`` of the template's bigrams is removed, so texts without one of
those are not looked at any further.  DataFrame functions only, one scan, no
shuffle.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Short notices and opening statements of public licences.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Where the full texts and the headers of public licences begin, or what they grant.
FULL_TEXTS = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
            "the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                     "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                     "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
                     "the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                     "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                     "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
                     "the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the "
                     "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
                     "specific prior written permission."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under "
                   "the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and "
                "distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to "
                 "copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted "
                 "to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                "file, You can obtain one at"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
                  "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and "
                  "by any means."),
)

KEEP = r"[^\p{L}\p{N}\n]+"  # becomes one space; line ends stay


@dataclass(frozen=True)
class Template:
    license: str
    bigrams: tuple[str, ...]
    least: int  # bigrams of a passage that can still match
    most: int
    prefix: tuple[str, ...]  # a match has at least one of these
    words: int
    anchors: tuple[tuple[str, int], ...]  # a window that matches has one of these bigrams; the places where they stand


def template_words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def compiled(license: str, text: str, threshold: float) -> Template:
    words = template_words(text)
    bigrams = tuple(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))
    n = len(bigrams)
    if not n:
        raise ValueError(f"template of {license} has fewer than two words")
    least, most = math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)
    shared = math.ceil(threshold * (least + n) / 2 - 1e-9)  # of the smallest passage, so of any
    rare = sorted(bigrams, key=lambda g: (-len(g), g))  # long bigrams are rare; any choice is exact
    of_windows = set(rare[:n - math.ceil(threshold * n / 2 / (1 - threshold / 2) - 1e-9) + 1])  # 2 s >= t (s + n), as the window has s bigrams or more
    anchors = tuple((f"{a} {b}", i) for i, (a, b) in enumerate(zip(words, words[1:])) if f"{a} {b}" in of_windows)
    return Template(license, bigrams, least, most, tuple(rare[:n - shared + 1]), len(words), anchors)


def normalised(text: Column) -> Column:
    """Lines of lower-case words, each line with a space at both ends."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), KEEP, " ")
    return F.concat(F.lit(" "), F.replace(spaced, F.lit("\n"), F.lit(" \n ")), F.lit(" "))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \n]+"), lambda w: w != "")


def _pairs(words: Column) -> Column:
    """The bigrams of a list of words, in order."""
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), lambda a, b: F.concat(a, F.lit(" "), b))


def _bigrams(text: Column) -> Column:
    return F.array_distinct(let(_words(text), _pairs))


def let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _has_any(text: Column, bigrams: list[str]) -> Column:
    """Whether a text, a space at either end, has one of some bigrams."""
    found = F.lit(False)
    for g in bigrams:
        found = found | text.contains(f" {g} ")
    return found


def _windows(words: Column, bigrams: Column, templates: list[Template]) -> Column:
    """(license, score, start, end) of the windows that reach the threshold."""
    places: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(templates):
        for g, at in t.anchors:
            places.setdefault(g, []).append((k, at))
    pair = lambda k, at: F.struct(F.lit(k).alias("k"), F.lit(at).alias("at"))
    of = F.create_map(*[x for g, where in sorted(places.items()) for x in (F.lit(g), F.array(*[pair(*w) for w in where]))])
    found = F.filter(F.transform(bigrams, lambda g, i: F.struct(i.alias("i"), g.alias("g"))), lambda x: x["g"].isin(sorted(places)))
    placed = F.flatten(F.transform(found, lambda x: F.transform(of[x["g"]], lambda w: F.struct(w["k"].alias("k"), (x["i"] - w["at"]).alias("start")))))
    table = F.array(*[F.struct(F.lit(t.license).alias("license"), F.lit(t.words).alias("words"), F.array(*map(F.lit, t.bigrams)).alias("bigrams")) for t in templates])

    def scored(x: Column) -> Column:
        t = F.get(table, x["k"])
        start, end = F.greatest(x["start"], F.lit(0)), F.least(x["start"] + t["words"], F.size(words))
        own = F.array_distinct(F.slice(bigrams, start + 1, F.greatest(end - start - 1, F.lit(0))))
        dice = 2 * F.size(F.array_intersect(own, t["bigrams"])) / (F.size(own) + F.size(t["bigrams"]))
        return F.struct(t["license"].alias("license"), dice.alias("score"), start.alias("start"), end.alias("end"))

    return F.transform(F.array_distinct(placed), scored)


def _undominated(hits: Column) -> Column:
    """Hits that no overlapping one exceeds."""
    better = lambda x, y: (y["score"] > x["score"]) & (y["start"] < x["end"]) & (x["start"] < y["end"])
    return F.filter(hits, lambda x: ~F.exists(hits, lambda y: better(x, y)))


def _scores(bigrams: Column, templates: list[Template], threshold: float) -> Column:
    """(license, score) of the templates that a passage reaches; of several
    the nearest, all of them at a tie."""
    size = F.size(bigrams)
    each = []
    for t in templates:
        dice = 2 * F.size(F.array_intersect(bigrams, F.array(*map(F.lit, t.bigrams)))) / (size + len(t.bigrams))
        each.append(F.when(size.between(t.least, t.most), F.struct(F.lit(t.license).alias("license"), dice.alias("score"))))
    reached = F.filter(F.array(*each), lambda x: x.isNotNull() & (x["score"] >= threshold))
    nearest = F.aggregate(reached, F.lit(0.0), lambda m, x: F.greatest(m, x["score"]))
    return F.filter(reached, lambda x: x["score"] == nearest)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES,
                  threshold: float = THRESHOLD, full_texts: tuple[tuple[str, str], ...] = FULL_TEXTS) -> DataFrame:
    """(doc_id, licenses, best_license, best_score, n_passages), a row for
    each document: the licences found, sorted and comma-joined (empty: none);
    the best one (highest score, then smallest name; null: none) and its
    score; how many places matched: windows with a start of their own or
    lines, whichever are more, or 1 where only the text as a whole does.

    Null and empty texts match nothing.  Repeated rows each keep a row.
    Empty input: no rows.  Other columns are not read."""
    made = [compiled(name, text, threshold) for name, text in templates]
    windowed = made + [compiled(name, text, threshold) for name, text in full_texts]
    prefixes = sorted({g for t in made for g in t.prefix})
    anchors = sorted({g for t in made for g in t.prefix} | {g for t in windowed for g, _ in t.anchors})
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("t"))
    asked = texts.select("doc_id", let(_words(F.col("t")), lambda words: let(_pairs(words), lambda pairs: F.when(
        F.exists(pairs, lambda g: g.isin(anchors)), F.struct(F.col("t").alias("t"), words.alias("words"), pairs.alias("pairs"))))).alias("x"))
    none = F.array().cast("array<struct<license:string,score:double>>")

    def judged(x: Column) -> Column:
        lines = F.filter(F.split(x["t"], "\n"), lambda line: _has_any(line, prefixes))
        by_line = F.filter(F.transform(lines, lambda line: let(_bigrams(line), lambda b: _scores(b, made, threshold))), lambda hits: F.size(hits) > 0)
        of_whole = let(F.array_distinct(x["pairs"]), lambda b: _scores(b, made, threshold))
        windows = let(F.filter(_windows(x["words"], x["pairs"], windowed), lambda w: w["score"] >= threshold), _undominated)
        return F.struct(by_line.alias("by_line"), of_whole.alias("of_whole"), windows.alias("windows"))

    hits = asked.select("doc_id", let(F.col("x"), lambda x: F.when(x.isNotNull(), judged(x))).alias("h")).select(
        "doc_id", F.coalesce(F.concat(F.flatten("h.by_line"), F.col("h.of_whole"), F.transform(
            "h.windows", lambda w: F.struct(w["license"].alias("license"), w["score"].alias("score")))), none).alias("all"),
        F.when(F.col("h").isNull(), 0).otherwise(F.greatest(
            F.size("h.by_line"), F.size(F.array_distinct(F.col("h.windows.start"))), F.least(F.size("h.of_whole"), F.lit(1)))).cast("long").alias("n_passages"))
    best = F.array_sort("all", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
                        .when(a["license"] < b["license"], -1).when(a["license"] > b["license"], 1).otherwise(0))
    return hits.select(
        "doc_id", F.array_join(F.array_sort(F.array_distinct(F.col("all.license"))), ",").alias("licenses"),
        F.get(best, F.lit(0))["license"].alias("best_license"),
        F.coalesce(F.get(best, F.lit(0))["score"], F.lit(0.0)).alias("best_score"), "n_passages")
