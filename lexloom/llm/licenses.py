"""Licences found by the Dice coefficient over word bigrams.

Texts are normalised to lower-case words; a unit is a line or a whole text. A
unit is like a template if twice the bigrams they share, over the bigrams of
both (each counted once), is THRESHOLD or more. Such a unit has no fewer than
t / (2 - t) and no more than (2 - t) / t times the template's bigrams, so the
others never get to a comparison: most lines are ruled out by their word count.
Templates are notices and whole licence texts.

Where the whole text is no hit, it is also searched for licences that are
wrapped over lines or stand among other words, by windows of its words with no
more bigrams than the bound above. For a notice they start and end with a bigram
of it, all such windows. For a template of over LONG bigrams the text is cut
into blocks of a sixteenth of it, and a window is a run of blocks that are half
of the template's bigrams (a single other block may be inside); it is looked at
only if the whole text has as many of the template's bigrams as a hit needs. A
window of fewer bigrams than its template is valued as if it were filled up with
others. Of windows and lines that overlap the one with most bigrams shared over
those not shared counts; a line always counts over the windows inside it.

DataFrame functions alone are used, without any exchange. Templates are a
parameter of a few entries. A null or empty text has no units. Of templates
with equal values the first by name counts. Repeated rows get the same result.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cols, fresh

THRESHOLD = 0.8
#: Templates of more bigrams are looked for by blocks.
LONG = 90
#: Notices by SPDX name, in the words that their licences ask for or that are usual.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Whole texts of licences, as published.
TEXTS = Path(__file__).parent / "license_texts"
_TOKEN = r"[a-z0-9]+"


@lru_cache(maxsize=1)
def templates_of() -> dict[str, str]:
    """The notices and the whole texts, by name."""
    return NOTICES | {f"{p.stem}-text": p.read_text(encoding="utf-8") for p in sorted(TEXTS.glob("*.txt"))}


def words_of(text: str) -> list[str]:
    return re.findall(_TOKEN, text.lower())


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def _bounds(n: int, t: float) -> tuple[int, int]:
    """How many bigrams a unit like a template of n bigrams can have."""
    return math.ceil(n * t / (2 - t) - 1e-9), math.floor(n * (2 - t) / t + 1e-9)


def _needed(bigrams: list[str], t: float) -> list[str]:
    """Bigrams of which a unit like the template has one at least.

    A hit shares no fewer than t / (2 - t) of the template's n bigrams, so any
    n + 1 less that number will do; those with the longest words are the rarest.
    """
    n = len(bigrams)
    k = n - math.ceil(n * t / (2 - t) - 1e-9) + 1
    return sorted(bigrams, key=lambda b: (-max(map(len, b.split(" "))), b))[:k]


#: Characters of a telling piece of a word.
PIECE = 6


def _telling(templates: list[list[str]], t: float) -> list[str]:
    """Pieces of words of which a unit like one of the (long) templates has one at least: without them it has too few of its bigrams."""
    pieces = lambda x: {w[i : i + PIECE] for w in x.split(" ") for i in range(len(w) - PIECE + 1)}
    left = {i: ({x: pieces(x) for x in b}, math.ceil(len(b) * t / (2 - t) - 1e-9)) for i, b in enumerate(templates)}
    out: list[str] = []
    while left := {i: (b, n) for i, (b, n) in left.items() if len(b) >= n}:
        weight: dict[str, float] = {}
        for b, n in left.values():
            for p in (p for ps in b.values() for p in ps):
                weight[p] = weight.get(p, 0) + 1 / n
        out.append(max(sorted(weight), key=weight.get))
        left = {i: ({x: ps for x, ps in b.items() if out[-1] not in ps}, n) for i, (b, n) in left.items()}
    return out


def _let(value: Column, use) -> Column:
    """use(value), with the value made once: it is bound to a lambda's variable."""
    return F.transform(F.array(value), use)[0]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds license (the best template or null), dice (its value or null) and n_hits (units and windows like some template)."""
    known = {k: b for k, v in sorted((templates or templates_of()).items()) if (b := bigrams_of(v))}
    long = {i: b for i, b in enumerate(known.values()) if len(b) > LONG}
    notices = {i: b for i, b in enumerate(known.values()) if i not in long}
    needed = sorted({b for bs in notices.values() for b in _needed(bs, threshold)})
    joined = lambda b: F.split(F.lit("|".join(b)), "[|]")
    rows = {i: F.struct(F.lit(i).alias("i"), F.lit(len(b)).alias("n"), *(F.lit(x).alias(c) for c, x in zip(("low", "high"), _bounds(len(b), threshold), strict=True)), joined(b).alias("b"), joined(_needed(b, threshold)).alias("need")) for i, b in enumerate(known.values())}
    # Templates are data, folded once: one expression goes over all of them.
    table = lambda some: F.array(*[rows[i] for i in some]) if some else F.filter(F.array(rows[0]), lambda _: F.lit(False))
    every_row, notice_rows, long_rows = table(rows), table(notices), table(long)
    least = min(_bounds(len(b), threshold)[0] for b in known.values())

    def pairs(w: Column) -> Column:
        return F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))

    def bigrams(w: Column) -> Column:
        return F.array_distinct(pairs(w))

    def best(own: Column) -> Column:
        """The largest value with its template's place (negative), or null."""
        size = F.size(own)
        value = lambda t: F.when(size.between(t["low"], t["high"]), 2.0 * F.size(F.array_intersect(own, t["b"])) / (size + t["n"]))
        each = F.transform(every_row, lambda t: F.struct(value(t).alias("d"), (-t["i"]).alias("i"), t["n"].alias("n"), size.alias("k")))
        return F.array_max(F.filter(each, lambda x: x["d"] >= threshold))

    def rated(w: Column, t: Column, start: Column, end: Column) -> Column:
        """A window's value: r is bigrams shared less those not shared; too large a window has none."""
        both, size = F.size(F.array_intersect(w, t["b"])), F.greatest(F.size(w), t["n"])
        value = F.when(F.size(w) <= t["high"], 2.0 * both / (size + t["n"]))
        return F.struct((2 * both - size).alias("r"), value.alias("d"), (-t["i"]).alias("i"), start.cast("int").alias("s"), end.cast("int").alias("e"))

    def windows_of(own: Column, known_at: Column, t: Column) -> Column:
        """The best window for each of its starts, if it is a hit of a notice; known_at has the places of known bigrams."""

        def window(near: Column, k: Column) -> Column:
            start, end = near[0]["p"], F.element_at(near, k)["p"]
            return _let(F.array_distinct(F.slice(own, start + 1, end - start + 1)), lambda w: rated(w, t, start, end))

        def from_start(near: Column) -> Column:
            each = F.filter(F.transform(F.sequence(t["low"], F.size(near)), lambda k: window(near, k)), lambda x: x["d"] >= threshold)
            enough = F.size(F.array_distinct(F.transform(near, lambda x: x["b"]))) >= t["low"]
            return F.when(enough, F.array_max(each))

        def all_starts(at: Column) -> Column:
            # Only places from which enough bigrams of the template are in reach.
            starts = F.filter(F.sequence(F.lit(1), F.size(at) - t["low"] + 1), lambda a: F.element_at(at, a + t["low"] - 1)["p"] - F.element_at(at, a)["p"] < t["high"])
            reach = lambda a: _let(F.element_at(at, a)["p"] + t["high"], lambda stop: F.filter(F.slice(at, a, t["high"]), lambda x: x["p"] < stop))
            found = F.filter(F.transform(starts, lambda a: _let(reach(a), from_start)), lambda x: x.isNotNull())
            return F.when((F.size(at) >= t["low"]) & F.exists(at, lambda x: F.array_contains(t["need"], x["b"])), found)

        return _let(F.filter(known_at, lambda x: F.array_contains(t["b"], x["b"])), all_starts)

    def blocks_of(own: Column, t: Column) -> Column:
        """The runs of blocks that are hits of a long template."""

        def of(size: Column) -> Column:
            half = lambda x: F.size(F.array_intersect(x, t["b"])) * 2 >= F.size(x)
            block = lambda k: _let(F.array_distinct(F.slice(own, k * size + 1, size)), half)
            at = F.filter(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / size).cast("int")), block)
            none = F.array().cast("array<struct<a:int,z:int>>")
            pair = lambda a, z: F.array(F.struct(a.alias("a"), z.alias("z")))

            def join(runs: Column, k: Column) -> Column:
                last = F.element_at(runs, -1)
                follows = (F.size(runs) > 0) & (k - last["z"] <= 2)
                return F.when(follows, F.concat(F.slice(runs, 1, F.size(runs) - 1), pair(last["a"], k))).otherwise(F.concat(runs, pair(k, k)))

            value = lambda run: _let(F.array_distinct(F.slice(own, run["a"] * size + 1, (run["z"] - run["a"] + 1) * size)), lambda w: rated(w, t, run["a"] * size, F.least((run["z"] + 1) * size, F.size(own)) - 1))
            return F.filter(F.transform(F.aggregate(at, none, join), value), lambda x: x["d"] >= threshold)

        enough = _let(F.array_distinct(own), lambda d: F.size(F.array_intersect(d, t["b"])) >= t["low"])
        return F.when(F.size(own) >= t["low"], F.when(enough, _let(F.floor(t["n"] / 16).cast("int"), of)))

    kind = "array<struct<s:int,t:int,e:int,r:int,d:double,i:int>>"
    span = lambda s, t, e, r, d, i: F.struct(s.alias("s"), F.lit(t).alias("t"), e.alias("e"), r.cast("int").alias("r"), d.alias("d"), i.alias("i"))

    def windows(own: Column) -> Column:
        every = sorted({x for bs in notices.values() for x in bs})
        places = F.filter(F.transform(own, lambda x, p: F.when(x.isin(every), F.struct(p.alias("p"), x.alias("b")))), lambda x: x.isNotNull())
        found = lambda at: F.concat(F.transform(notice_rows, lambda t: windows_of(own, at, t)), F.transform(long_rows, lambda t: blocks_of(own, t)))
        search = lambda at: F.flatten(F.filter(found(at), lambda x: x.isNotNull()))
        return F.transform(_let(places, search), lambda x: span(x["s"], 1, x["e"], x["r"], x["d"], x["i"]))

    def line_spans(lines: Column, each: Column) -> Column:
        """Where the hits among the lines are, in bigrams of all words."""

        def add(acc: Column, z: Column) -> Column:
            n = F.when(z["u"] == "", 0).otherwise(F.size(F.split(z["u"], " ")))
            x = z["x"]
            here = span(acc["at"], 0, acc["at"] + n - 2, F.round(x["d"] * (x["n"] + x["k"])) - F.greatest(x["n"], x["k"]), x["d"], x["i"])
            return F.struct((acc["at"] + n).alias("at"), F.when(x.isNull(), acc["got"]).otherwise(F.concat(acc["got"], F.array(here).cast(kind))).alias("got"))

        both = F.zip_with(lines, each, lambda u, x: F.struct(u.alias("u"), x.alias("x")))
        return F.aggregate(both, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("got")), add, lambda acc: acc["got"])

    def apart(spans: Column) -> Column:
        def add(got: Column, x: Column) -> Column:
            last = F.element_at(got, -1)
            better = (x["r"] > last["r"]) | ((x["r"] == last["r"]) & (x["t"] == 0))
            return (
                F.when(F.size(got) == 0, F.array(x)).when(last["e"] < x["s"], F.concat(got, F.array(x))).when((last["t"] == 0) & (x["e"] <= last["e"]), got)
                .when(better, F.concat(F.slice(got, 1, F.size(got) - 1), F.array(x))).otherwise(got)
            )

        return F.aggregate(F.sort_array(spans), F.array().cast(kind), add)

    def hits(clean: Column) -> Column:
        value = lambda xs: F.transform(xs, lambda x: F.struct(x["d"].alias("d"), x["i"].alias("i")))

        def unit(u: Column) -> Column:
            long = F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit(""))) >= least
            return F.when(long, _let(F.split(u, " "), lambda w: _let(bigrams(w), best)))

        def wide(lines: Column, each: Column) -> Column:
            own = pairs(F.split(F.array_join(F.filter(lines, lambda u: u != ""), " "), " "))
            return apart(F.concat(line_spans(lines, each), _let(own, windows).cast(kind)))

        def of(lines: Column, each: Column) -> Column:
            whole = F.when(F.size(lines) > 1, unit(F.array_join(F.filter(lines, lambda u: u != ""), " "))).otherwise(each[0])
            own = F.filter(each, lambda x: x.isNotNull())
            return _let(whole, lambda x: F.when(x.isNull(), value(wide(lines, each))).when(F.size(lines) > 1, value(F.concat(own, F.array(x)))).otherwise(value(own)))

        lines = F.transform(F.split(clean, "\n"), lambda u: F.trim(u))
        return _let(lines, lambda ls: _let(F.transform(ls, unit), lambda each: of(ls, each)))

    def some(value: Column, parts: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(value, F.lit(x)) for x in parts])

    # Texts without the longer word of any needed pair, or a pair of short words, can't hit; nothing more is done to them.
    rare = {w for b in needed if len(w := max(b.split(" "), key=len)) >= 5}
    rare = sorted(w for w in rare if not any(v in w for v in rare - {w}))  # what has a longer one has the shorter one in it
    short = [b.replace(" ", "[^a-z0-9]+") for b in needed if max(map(len, b.split(" "))) < 5]
    telling = _telling(list(long.values()), threshold)
    fewest = min((_bounds(len(b), threshold)[0] for b in long.values()), default=0)
    wordy = lambda low: (F.length(low) > 2 * fewest) & some(low, telling) if telling else F.lit(False)
    maybe = lambda low: some(low, rare) | low.rlike("|".join(short)) | wordy(low) if short else some(low, rare) | wordy(low)
    clean = lambda low: F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9\n]+", " "), r" ?\n[ \n]*", "\n")
    flat = lambda c: F.replace(c, F.lit("\n"), F.lit(" "))
    full = lambda low: _let(clean(low), lambda c: _let(flat(c), lambda f: F.when(some(f, needed) | wordy(low), hits(c))))
    found = _let(F.lower(F.col(text)), lambda low: F.when(maybe(low), full(low)))
    names = F.array(*map(F.lit, known))
    keep = docs.columns if keep is None else keep
    h, t = fresh(docs, "hits"), fresh(docs, "top")
    kept = docs.select(*cols(keep))
    names_out = [fresh(kept, x) for x in ("license", "dice", "n_hits")]
    out = docs.select(*cols(keep), found.alias(h)).withColumn(t, F.array_max(h))
    return out.select(
        *cols(keep),
        F.when(F.col(t).isNotNull(), F.element_at(names, 1 - F.col(t)["i"])).alias(names_out[0]),
        F.col(t)["d"].alias(names_out[1]),
        F.when(F.col(h).isNull(), 0).otherwise(F.size(h)).cast("long").alias(names_out[2]),
    )


def oracle(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for scan() of documents."""
    t = threshold
    rows = ", ".join(f"({i}, '{k}', {bigrams_of(v)!r}, {_bounds(len(bigrams_of(v)), t)[0]}, {_bounds(len(bigrams_of(v)), t)[1]})" for i, (k, v) in enumerate(sorted((templates or templates_of()).items())))
    return f"""
WITH t(i, name, bs, low, high) AS (VALUES {rows}),
d AS (SELECT doc_id, row_number() OVER () AS r, string_split(regexp_replace(lower(text), '[^a-z0-9\n]+', ' ', 'g'), chr(10)) AS ls FROM documents),
u AS (SELECT r, unnest(CASE WHEN len(ls) > 1 THEN list_append(ls, array_to_string(ls, ' ')) ELSE ls END) AS s FROM d),
w AS (SELECT r, regexp_extract_all(s, '[a-z0-9]+') AS w FROM u),
b AS (SELECT r, list_distinct([w[k] || ' ' || w[k + 1] for k in range(1, len(w))]) AS own FROM w WHERE len(w) > 1),
s AS (SELECT b.r, t.i, t.name, 2.0::DOUBLE * len(list_intersect(own, bs)) / (len(own) + len(bs)) AS dice, row_number() OVER () AS unit_t, own FROM b JOIN t ON len(own) BETWEEN low AND high),
h AS (SELECT r, own, max_by(name, (dice, -i)) AS name, min(i) AS i, max(dice) AS dice, count(*) AS k FROM s WHERE dice >= {threshold} GROUP BY r, own),
x AS (SELECT r, max_by(name, (dice, -i)) AS license, max(dice) AS dice FROM h GROUP BY r),
n AS (SELECT b.r, count(*) AS n_hits FROM b WHERE EXISTS (SELECT 1 FROM h WHERE h.r = b.r AND h.own = b.own) GROUP BY b.r)
SELECT d.doc_id, x.license, x.dice, coalesce(n.n_hits, 0)::BIGINT AS n_hits FROM d LEFT JOIN x USING (r) LEFT JOIN n USING (r)"""
