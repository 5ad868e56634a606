"""Licence notices in texts, by the Dice coefficient over word bigrams with templates.

Units are the lines of a text and its paragraphs of several lines. A unit is normalised to lower-case words of a-z and 0-9 and compared
by its set of word bigrams. A template of b bigrams can reach the threshold with a unit of a bigrams only if
2 min(a, b) / (a + b) reaches it: units outside these bounds for all templates are dropped before their bigrams are made, and each remaining
unit is compared only with the templates within its bounds. Of the templates that reach the threshold the best one names the unit.

All of it is column expressions within the row: one pass, no shuffle.

Defined cases: null and empty texts have no notice; a unit of one word has no bigram and matches nothing; of templates that fit equally
well the first in alphabetical order counts; repeated lines and rows count each. Other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleevenotes.llm.text import positions

PERCENT = 80
NOT_WORD = "[^a-z0-9]+"
# Notices as licences recommend or commonly carry them.
TEMPLATES = {
    "All-Rights-Reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def template_bigrams(text: str) -> list[str]:
    words = [w for w in re.split(NOT_WORD, text.lower()) if w]
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def notices(text: Column, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> Column:
    """Array of (licence, dice) for each unit that fits a template, in the order of the units."""
    known = {name: template_bigrams(t) for name, t in sorted(templates.items())}
    table = F.array(
        *(F.struct(F.lit(name).alias("name"), F.lit(len(b)).alias("n"), F.array(*map(F.lit, b)).alias("bigrams")) for name, b in known.items())
    )
    sizes = [len(b) for b in known.values()]
    least, most = min(sizes) * percent / (200 - percent), max(sizes) * (200 - percent) / percent
    any_bigram = F.array(*map(F.lit, sorted({x for b in known.values() for x in b})))

    lower = F.lower(F.coalesce(text, F.lit("")))
    paragraphs = F.filter(F.split(lower, "\n[ \\t\\r]*\n"), lambda p: p.contains("\n"))
    units = F.concat(F.split(lower, "\n"), paragraphs)
    words = F.filter(
        F.transform(units, lambda u: F.array_remove(F.split(u, NOT_WORD), "")),
        lambda w: F.size(w) - 1 >= least,
    )
    bigrams = F.transform(
        words,
        lambda w: F.array_distinct(F.transform(positions(F.size(w) - 1), lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1)))),
    )
    near = F.filter(bigrams, lambda b: (F.size(b) >= least) & (F.size(b) <= most) & F.arrays_overlap(b, any_bigram))

    def best(b: Column) -> Column:
        bounded = F.filter(table, lambda t: 200 * F.least(F.size(b), t.n) >= percent * (F.size(b) + t.n))
        compared = F.transform(
            bounded,
            lambda t: F.struct((200 * F.size(F.array_intersect(b, t.bigrams))).alias("shared"), (F.size(b) + t.n).alias("sizes"), t["name"].alias("name")),
        )
        fitting = F.filter(compared, lambda c: c.shared >= percent * c.sizes)
        ranked = F.transform(fitting, lambda c: F.struct((-(c.shared / 100.0 / c.sizes)).alias("minus"), c["name"].alias("licence")))
        return F.array_min(ranked)

    found = F.filter(F.transform(near, best), lambda x: x.isNotNull())
    return F.transform(found, lambda x: F.struct(x.licence.alias("licence"), (-x.minus).alias("dice")))


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_notices, licences (distinct, sorted) and best_dice (0 without a notice) of each document."""
    found = docs.select("doc_id", notices(F.col("text"), templates, percent).alias("found"))
    names = F.sort_array(F.array_distinct(F.transform("found", lambda x: x.licence)))
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_notices"),
        names.alias("licences"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x.dice)), F.lit(0.0)).alias("best_dice"),
    )
