"""Licence notices in documents: Dice coefficient over word bigrams against templates.

Each line of a text, and the whole text if it has several, is normalised to lower-case words of
letters and digits, and its set of word bigrams compared with that of each template:
2 * shared / (own + template's). A result of at least 0.8 needs a unit whose number of bigrams
lies within bounds that follow from the template's, so most units are compared with none. All
of it is one projection of Spark functions; nothing is exploded or shuffled.

Notices that are wrapped over lines or part of a longer one are found in windows over the words of
the whole text, as are full licence texts. A window begins where a stretch of bigrams shared with
the template begins, since a longer one to the left would share as much, and has up to half as many
bigrams again as the template. One with fewer than the template counts as if it had as many, or
the first words of one notice would match another.
"""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import let

#: Percent of the Dice coefficient that counts as a match.
PERCENT = 80

# Short notices of public licences, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


@cache
def full_texts() -> list[tuple[str, str]]:
    """Whole licences, by SPDX identifier; they are looked for in windows only."""
    return [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]


def _bigram_list(text: str) -> list[str]:
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def template_bigrams(text: str) -> list[str]:
    return sorted(set(_bigram_list(text)))


def bounds(n: int) -> tuple[int, int]:
    """Sizes of a set that can reach the threshold against one of n: shared is at most the smaller size."""
    least = -(-n * PERCENT // (200 - PERCENT))
    return least, n * (200 - PERCENT) // PERCENT


def markers(own: list[str]) -> set[str]:
    """Words of which a unit that matches the template has at least one.

    A match shares some least number of the template's bigrams. The longest words are taken until
    fewer bigrams than that are without one of them.
    """
    least = bounds(len(own))[0]
    need = -(-PERCENT * (least + len(own)) // 200)
    chosen: set[str] = set()
    for word in sorted({w for g in own for w in g.split()}, key=lambda w: (-len(w), w)):
        if sum(not chosen & set(g.split()) for g in own) < need:
            break
        chosen.add(word)
    return chosen


def window_markers(text: str) -> set[str]:
    """Words of which a window that matches has at least one: it shares PERCENT of the bigrams."""
    own = template_bigrams(text)
    chosen: set[str] = set()
    for word in sorted({w for g in own for w in g.split()}, key=lambda w: (-len(w), w)):
        if sum(not chosen & set(g.split()) for g in own) < -(-PERCENT * len(own) // 100):
            break
        chosen.add(word)
    return chosen


def _words(text: Column) -> Column:
    """Words of letters and digits; ASCII characters other than those separate them."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, rest), F.slice(words, 2, rest), lambda a, b: F.concat_ws(" ", a, b)))


def window_hits(lines: Column, templates: list[tuple[str, str]]) -> Column:
    """An array of (licence, unit, dice, begin_line, end_line) for windows over the words of all lines
    (an array of arrays of words): unit is the line on which the window begins, negated. Of windows
    that overlap the best stays."""
    rows = []
    for name, body in templates:
        every = _bigram_list(body)
        n, size = len(set(every)), len(every)
        if n:
            rows.append(F.struct(
                F.lit(name).alias("licence"), F.split(F.lit("|".join(sorted(set(every)))), "\\|").alias("own"), F.lit(n).alias("n"),
                F.lit(-(-PERCENT * n // 100)).alias("need"), F.lit(size * (200 - PERCENT) // PERCENT).alias("most")))
    if not rows:
        return F.array().cast("array<struct<licence:string,unit:int,dice:double,begin_line:int,end_line:int>>")

    def measured(grams: Column, t: Column, begin: Column) -> Column:
        """The best window from begin: (minus, licence, begin, end)."""
        def scanned(run: Column) -> Column:
            marked = F.transform(run, lambda g, k: F.struct(
                (F.array_position(run, g) == k + 1).cast("int").alias("fresh"), F.array_contains(t["own"], g).cast("int").alias("shared")))
            zero = F.struct(F.lit(0).alias("k"), F.lit(0).alias("all"), F.lit(0).alias("shared"), F.lit(0.0).alias("dice"), F.lit(0).alias("end"))

            def step(x: Column, m: Column) -> Column:
                count, shared = x["all"] + m["fresh"], x["shared"] + m["fresh"] * m["shared"]
                dice = 2.0 * shared / (F.greatest(count, t["n"]) + t["n"])
                better = dice > x["dice"]
                return F.struct(
                    (x["k"] + 1).alias("k"), count.alias("all"), shared.alias("shared"),
                    F.when(better, dice).otherwise(x["dice"]).alias("dice"), F.when(better, x["k"] + 1).otherwise(x["end"]).alias("end"))

            return F.aggregate(marked, zero, step, lambda x: F.struct(
                (-x["dice"]).alias("minus"), t["licence"].alias("licence"), begin.alias("begin"), (begin + x["end"]).alias("end")))

        return let(F.slice(grams, begin, t["most"]), scanned)

    def found(grams: Column, t: Column) -> Column:
        def begins(at: Column) -> Column:
            numbered = F.transform(at, lambda p, k: F.struct(p.alias("p"), k.alias("k")))
            # Enough shared bigrams within the longest window, and none just before.
            return F.transform(F.filter(numbered, lambda x: (
                ((x["k"] == 0) | (F.get(at, x["k"] - 1) != x["p"] - 1))
                & F.coalesce(F.get(at, x["k"] + t["need"] - 1) - x["p"] < t["most"], F.lit(False)))), lambda x: x["p"])

        at = F.filter(F.sequence(F.lit(1), F.size(grams)), lambda p: F.array_contains(t["own"], F.element_at(grams, p)))
        hits = F.transform(let(at, begins), lambda p: measured(grams, t, p))
        return F.filter(hits, lambda x: x["minus"] * 100 <= -PERCENT)

    def searched(words: Column, line_of: Column) -> Column:
        def among(grams: Column) -> Column:
            def likely(distinct: Column) -> Column:
                return F.filter(F.array(*rows), lambda t: F.size(F.array_intersect(distinct, t["own"])) >= t["need"])

            return F.flatten(F.transform(let(F.array_distinct(grams), likely), lambda t: found(grams, t)))

        def apart(kept: Column, x: Column) -> Column:
            clash = F.exists(kept, lambda y: (y["begin"] <= x["end"]) & (x["begin"] <= y["end"]))
            return F.when(clash, kept).otherwise(F.array_append(kept, x))

        rest = F.greatest(F.size(words) - 1, F.lit(0))
        grams = F.zip_with(F.slice(words, 1, rest), F.slice(words, 2, rest), lambda a, b: F.concat_ws(" ", a, b))
        empty = F.array().cast("array<struct<minus:double,licence:string,begin:int,end:int>>")
        best = F.aggregate(F.array_sort(F.when(rest > 0, let(grams, among)).otherwise(empty)), empty, apart)
        return F.transform(best, lambda x: F.struct(
            x["licence"].alias("licence"), (-F.element_at(line_of, x["begin"])).alias("unit"), (-x["minus"]).alias("dice"),
            F.element_at(line_of, x["begin"]).alias("begin_line"), F.element_at(line_of, x["end"]).alias("end_line")))

    numbers = F.flatten(F.transform(lines, lambda x, k: F.array_repeat(k + 1, F.size(x))))
    return let(F.flatten(lines), lambda w: let(numbers, lambda n: searched(w, n)))


def licence_hits(text: Column, templates: list[tuple[str, str]], in_windows: list[tuple[str, str]]) -> Column:
    """An array of (licence, unit, dice): one per unit that matches, with its best template.

    unit is the number of the line from 1, or 0 for the whole of a text with several lines. Windows
    follow, with their first line negated, unless the whole text, a line that holds the window, or
    one of its lines with the same licence matched. Ties
    go to the licence that is first in the alphabet. Bigrams are formed only for units that have
    a marker word of some template and no more distinct words than a match can have.
    """
    sized = [(name, template_bigrams(body)) for name, body in templates]
    sized = [(name, grams) for name, grams in sized if grams]
    ranges = sorted({bounds(len(g)) for _, g in sized})
    most = max((high for _, high in ranges), default=0)
    marks = F.array(*map(F.lit, sorted(set().union(*(markers(g) for _, g in sized)))))
    plain = F.regexp_replace(F.lower(text), "[\\x00-\\x7F&&[^a-z0-9\n]]+", " ")

    def units(plain: Column) -> Column:
        lines = F.transform(F.split(plain, "\n", -1), lambda x, i: F.struct((i + 1).alias("unit"), _words(x).alias("words")))
        # The whole text has every line's marker words; it is a unit only where some line has one.
        marked = F.filter(lines, lambda u: F.arrays_overlap(u["words"], marks))
        whole = F.array(F.struct(F.lit(0).alias("unit"), _words(F.translate(plain, "\n", " ")).alias("words")))
        return let(marked, lambda m: F.when((F.size(m) > 0) & (F.instr(plain, "\n") > 0), F.concat(m, whole)).otherwise(m))

    def dice(grams: Column, own: list[str]) -> Column:
        least, top = bounds(len(own))
        shared = F.size(F.array_intersect(grams, F.array(*map(F.lit, own))))
        return F.when(F.size(grams).between(least, top), 2.0 * shared / (F.size(grams) + len(own))).otherwise(0.0)

    def best(u: Column) -> Column:
        scores = F.array(*(F.struct((-dice(u["grams"], g)).alias("minus"), F.lit(name).alias("licence")) for name, g in sized))
        return F.struct(u["unit"].alias("unit"), F.array_min(scores).alias("best"))

    # A text has at least as many distinct bigrams as distinct words, less one.
    few = F.filter(let(plain, units), lambda u: F.size(F.array_distinct(u["words"])) - 1 <= most)
    cut = F.transform(few, lambda u: F.struct(u["unit"].alias("unit"), _bigrams(u["words"]).alias("grams")))
    bounds_ = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ranges))
    within = F.filter(cut, lambda u: F.exists(bounds_, lambda r: F.size(u["grams"]).between(r["a"], r["b"])))
    matched = F.filter(F.transform(within, best), lambda u: u["best"]["minus"] * 100 <= -PERCENT)
    plain_hits = F.transform(matched, lambda u: F.struct(
        u["best"]["licence"].alias("licence"), u["unit"].alias("unit"), (-u["best"]["minus"]).alias("dice")))
    window_marks = F.array(*map(F.lit, sorted(set().union(*(window_markers(body) for _, body in in_windows)))))

    def beside(hits: Column) -> Column:
        lines = F.transform(F.split(plain, "\n", -1), _words)
        none = F.array().cast("array<struct<licence:string,unit:int,dice:double,begin_line:int,end_line:int>>")
        windows = F.when(F.exists(hits, lambda h: h["unit"] == 0), none).otherwise(let(lines, lambda x: F.when(
            F.exists(x, lambda w: F.arrays_overlap(w, window_marks)), window_hits(x, in_windows)).otherwise(none)))
        left = F.filter(windows, lambda w: ~F.exists(hits, lambda h: h["unit"].between(w["begin_line"], w["end_line"]) & (
            (h["licence"] == w["licence"]) | (w["begin_line"] == w["end_line"]))))
        return F.concat(hits, F.transform(left, lambda w: F.struct(w["licence"].alias("licence"), w["unit"].alias("unit"), w["dice"].alias("dice"))))

    return let(plain_hits, beside)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """docs with a column licences, an array of (licence, unit, dice), see licence_hits().

    Null or empty texts give an empty array. An existing column licences is replaced.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = TEMPLATES if templates is None else templates
    return docs.withColumn("licences", licence_hits(text, given, TEMPLATES + full_texts() if templates is None else templates))
