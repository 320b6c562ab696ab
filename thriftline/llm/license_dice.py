"""Licence scan: texts and lines compared to licence notices by Dice coefficient over word bigrams."""
from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from .frames import named, packed, unpacked

# Short licence notices and the terms of the brief licences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
            "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
            "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
            "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
            "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
            "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
            "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
            "DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                "option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
            "IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
            "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
            "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
            "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
            "PERFORMANCE OF THIS SOFTWARE."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
)

#: What separates words: everything but letters, digits and the point inside a version number.
GAPS = r"[^\p{L}\p{N}.]+|\.(?!\p{N})|(?<!\p{N})\."
GAPS_ASCII = r"[^a-z0-9.]+|\.(?![0-9])|(?<![0-9])\."
THRESHOLD = 0.9


def bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a template."""
    words = re.sub(GAPS_ASCII, " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """How many distinct bigrams a text may have to reach ``threshold`` with a template of ``size``.

    The intersection is at most the smaller set: 2 min(a, b) >= t (a + b).
    """
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def _candidates(text: Column) -> Column:
    """The whole text and each of its lines."""
    return F.array_distinct(F.concat(F.array(text), F.split(text, "\n")))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _constant(values: list[str]) -> Column:
    """An array that the optimizer makes once; a literal per value would make large plans."""
    return F.split(F.lit("\n".join(values)), "\n")


def longest(text: str, threshold: float) -> int:
    """How many bigrams, repeated ones included, a window that is compared to the template has at most."""
    words = re.sub(GAPS_ASCII, " ", text.lower()).split()
    own = bigrams(text)
    return bounds(len(own), threshold)[1] + max(0, len(words) - 1 - len(own))


def telling(templates, threshold: float) -> list[str]:
    """Words of which a text holds at least one, as a part of its own, if any window of it reaches a template.

    Without them fewer bigrams of each template are left than its smallest fitting set has.
    """
    open_sets = {i: (set(own), len(own) - max(1, bounds(len(own), threshold)[0]) + 1)
                 for i, own in enumerate(bigrams(t) for _, t in templates) if own}
    chosen: list[str] = []
    while open_sets:
        gain: dict[str, int] = {}
        words = {w for own, _ in open_sets.values() for x in own for w in x.split()}
        for word in {w for w in words if len(w) >= 6} or words:
            gain[word] = sum(min(need, sum(word in x for x in own)) for own, need in open_sets.values())
        chosen.append(min(gain, key=lambda w: (-gain[w], w)))
        for i, (own, need) in list(open_sets.items()):
            left = {x for x in own if chosen[-1] not in x}
            need -= len(own) - len(left)
            open_sets[i] = (left, need)
            if need <= 0:
                del open_sets[i]
    return chosen


def _windows(grams: Column, templates, threshold: float) -> Column:
    """The (score, rank, license) of word windows of a text, given as its bigrams in order.

    A bigram that isn't the template's lowers the score at a window's ends, so
    the best windows begin and end with one of the template's.  Only a text that
    holds as many of them as the smallest fitting set has windows at all.  Per
    template and first bigram the best window counts, unless it overlaps a
    better one.
    """
    sets = [(i, name, bigrams(t), longest(t, threshold)) for i, (name, t) in enumerate(templates)]
    every = _constant(sorted({x for _, _, own, _ in sets for x in own}))
    kind = "array<struct<score:double,rank:int,license:string,first:int,last:int>>"

    def searched(i: int, name: str, own: list[str], most: int) -> Column:
        least = max(1, bounds(len(own), threshold)[0])
        lits = _constant(own)

        def from_start(at: Column, a: Column) -> Column:
            ends = F.sequence(a + (least - 1), F.least(F.size(at), a + (most - 1)))
            first = F.element_at(at, a)
            near = F.filter(F.transform(ends, lambda b: F.element_at(at, b)), lambda last: last - first < most)

            def scored(last: Column) -> Column:
                return _let(F.array_distinct(F.slice(grams, first, last - first + 1)), lambda d: F.struct(
                    (2.0 * F.size(F.array_intersect(d, lits)) / (F.size(d) + len(own))).alias("score"), (-last).alias("nearest")))

            return _let(F.array_max(F.transform(near, scored)), lambda m: F.struct(
                m["score"].alias("score"), F.lit(-i).alias("rank"), F.lit(name).alias("license"),
                first.alias("first"), (-m["nearest"]).alias("last")))

        held = F.filter(F.sequence(F.lit(1), F.size(grams)), lambda p: F.array_contains(lits, F.element_at(grams, p)))
        return _let(held, lambda at: F.filter(
            F.transform(F.sequence(F.lit(1), F.size(at) - (least - 1)), lambda a: from_start(at, a)),
            lambda m: m["score"] >= threshold))

    def found(hits: Column) -> Column:
        parts = []
        for i, name, own, most in sets:
            enough = F.size(F.array_intersect(hits, _constant(own))) >= max(1, bounds(len(own), threshold)[0])
            parts.append(F.when(enough, searched(i, name, own, most).cast(kind)).otherwise(F.array().cast(kind)))
        return F.concat(*parts)

    def unbeaten(all_found: Column) -> Column:
        def beats(o: Column, m: Column) -> Column:
            better = (o["score"] > m["score"]) | ((o["score"] == m["score"]) & (o["rank"] > m["rank"]))
            return better & (o["first"] <= m["last"]) & (o["last"] >= m["first"])

        return F.filter(all_found, lambda m: ~F.exists(all_found, lambda o: beats(o, m)))

    least = min(max(1, bounds(len(own), threshold)[0]) for _, _, own, _ in sets)
    kept = _let(F.array_intersect(grams, every), lambda hits: F.when(
        F.size(hits) >= least, _let(found(hits), unbeaten)).otherwise(F.array().cast(kind)))
    return F.transform(kept, lambda m: F.struct(m["score"].alias("score"), m["rank"].alias("rank"), m["license"].alias("license")))


def matches(text: Column, templates=TEMPLATES, threshold: float = THRESHOLD, windows: bool = False) -> Column:
    """All (score, name, template) of the text's candidates that reach ``threshold``.

    Every step takes the array that the step before has made, so nothing is
    computed twice; a template is compared only within its size bounds.
    """
    sets = [(i, name, bigrams(t)) for i, (name, t) in enumerate(templates)]
    limits = [bounds(len(g), threshold) for _, _, g in sets]
    least = min(lo for lo, _ in limits)
    words = F.transform(
        _candidates(text),
        lambda u: F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(u), GAPS, " "), " +", " ")), " "))
    # n words have at most n - 1 distinct bigrams.
    long_enough = F.filter(words, lambda w: F.size(w) > least)
    grams = F.transform(long_enough, lambda w: (
        F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))))
    most = max(hi for _, hi in limits)

    def compared(g: Column) -> Column:
        found = []
        for (i, name, own), (lo, hi) in zip(sets, limits):
            common = F.size(F.array_intersect(g, F.array(*[F.lit(x) for x in own])))
            score = 2.0 * common / (F.size(g) + len(own))
            found.append(F.when(F.size(g).between(lo, hi), F.struct(
                score.alias("score"), F.lit(-i).alias("rank"), F.lit(name).alias("license"))))
        return F.array_max(F.array(*found))

    def units(all_grams: Column) -> Column:
        sized = F.filter(F.transform(all_grams, F.array_distinct), lambda g: F.size(g).between(least, most))
        return F.filter(F.transform(sized, compared), lambda m: m["score"] >= threshold)

    if not windows:
        return units(grams)
    # The first candidate is the whole text; if that is too short, so are its lines.
    likely = _let(F.lower(text), lambda t: reduce(or_, [F.contains(t, F.lit(w)) for w in telling(templates, threshold)]))
    return _let(grams, lambda g: F.when(
        likely & (F.size(g) > 0), F.concat(units(g), _windows(F.element_at(g, 1), templates, threshold))).otherwise(units(g)))


def license_scan(
    docs: DataFrame, text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, windows: bool = False,
) -> DataFrame:
    """``docs`` with license and license_score of the best notice, and licenses, all that were found.

    The whole text and each of its lines are normalised (lower case, words of
    letters and digits) and compared to the templates by Dice coefficient over
    the sets of word bigrams.  Size bounds decide which templates a candidate is
    compared to.  Per candidate the best template counts, ties going to the one
    that comes first; per document the best candidate.

    With ``windows``, runs of words of the whole text are candidates too, wherever
    they begin and end, so a notice is also found when it is wrapped or shares
    its line with other words.  A window is at most as long as the template's
    size bound and the template's own repeated bigrams allow.

    A null or empty text has no licence (nulls and an empty array).  A text of any
    length is scanned whole.  There is no shuffle, so neither repeated rows nor
    hot groups matter.  Input columns named like a result column are replaced.
    """
    text = F.coalesce(named(text_col), F.lit(""))
    rows = packed(docs, found=matches(text, templates, threshold, windows))
    best = F.array_max("found")
    names = F.array_sort(F.array_distinct(F.transform("found", lambda m: m["license"])))
    return unpacked(rows, docs.columns, license=best["license"], license_score=best["score"], licenses=names)
