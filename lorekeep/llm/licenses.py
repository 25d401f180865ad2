"""License scans by MinHash bands over overlapping text windows, in DataFrame functions only.

A window is a few neighbouring 5-word shingles; windows begin at every word. A band is the smallest of the
window's shingle hashes under one permutation. Templates are cut the same way. A window that lies within a
template is equal to one of the template's windows, and so meets it in every band; one that shares the part
J of its shingles meets it in some band with probability 1 - (1 - J)**BANDS. Each meeting is then verified:
the share of the template's shingles that stand in the text around it, 0.8 at least.
"""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.decontaminate import _grams, once, words

SHINGLE, WINDOW, BANDS = 5, 4, 3
CONTAINED = 0.8
#: Templates are constants of the plan: more characters than this are refused.
MOST = 300_000

#: Full license texts from Debian's common-licenses; MIT, BSD-2-Clause and ISC from Python packages, without
#: their copyright lines; the Unlicense was written down without a copy at hand.
TEXTS = json.loads((Path(__file__).parent / "license_texts.json").read_text(encoding="utf-8"))

# Public license notices, as their authors ask to put them.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
}


def _numbers(keys: list[int]) -> str:
    """The keys as SQL; parsed at once, where a literal each would be as many calls."""
    return ", ".join(f"{k}L" for k in keys)


def _mixed(band: int) -> Column:
    return F.transform("grams", lambda g: F.xxhash64(g, F.lit(band)))


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` (with words) with grams, their shingle hashes, and b0, b1, ..., the bands of their windows."""
    cut = _grams(rows, SHINGLE)
    starts = F.when(F.size("grams") >= WINDOW, F.sequence(F.lit(0), F.size("grams") - WINDOW)).otherwise(F.array().cast("array<int>"))

    def lowest(i: Column) -> Column:
        return F.least(*[F.get("_m", i + j) for j in range(WINDOW)])

    for band in range(BANDS):
        cut = cut.withColumn("_m", once(_mixed(band))).withColumn(f"b{band}", once(F.transform(starts, lowest))).drop("_m")
    return cut


def scan(docs: DataFrame, templates: dict[str, str], id_col: str = "doc_id", text_col: str = "text", contained: float = CONTAINED) -> DataFrame:
    """(doc_id, template, containment, first_word, n_words) for each template that a row of ``docs`` holds: the
    largest share of the template's distinct shingles in one place, the first word (from 0) of the first such
    place, and the words of the text.

    Case, punctuation and spaces do not count. Templates of fewer shingles than a window are looked up shingle
    by shingle. Null, wordless and other texts of fewer words than a shingle hold nothing; such templates are
    refused; repeated rows repeat their results; other columns are ignored. Nothing is shuffled: the
    templates, whose size is bounded, are constants of the plan.
    """
    if sum(len(t) for t in templates.values()) > MOST:
        raise ValueError(f"templates of more than {MOST} characters")
    given = docs.sparkSession.createDataFrame(sorted(templates.items()), "template string, text string")
    known = []
    bands = [f"b{b}" for b in range(BANDS)]
    for r in _keyed(given.select("template", words(F.col("text")).alias("words"))).collect():
        if not r["grams"]:
            raise ValueError(f"template {r['template']} has fewer than {SHINGLE} words")
        wide = len(r["grams"]) >= WINDOW
        known.append((r["template"], sorted(set(r["grams"])), [] if wide else r["grams"], [r[b] if wide else [] for b in bands]))
    rows = _keyed(docs.select(F.col(id_col).alias("_id"), words(F.col(text_col)).alias("words")).withColumn("_n", F.size("words")))

    def among(column: str, keys: list[int]) -> Column:
        return F.expr(f"filter({column}, k -> k IN ({_numbers(keys)}))") if keys else F.array().cast("array<bigint>")

    met = [among("grams", sorted({k for x in known for k in x[2]}))]
    met += [among(bands[b], sorted({k for x in known for k in x[3][b]})) for b in range(BANDS)]
    rows = rows.withColumn("_met", once(F.array_distinct(F.concat(*met)))).where(F.size("_met") > 0)
    found = []
    for name, grams, short, wide in known:
        keys = sorted({*short, *(k for x in wide for k in x)})
        found.append(F.when(F.expr(f"arrays_overlap(_met, array({_numbers(keys)}))"), F.struct(F.lit(name).alias("template"), _best(grams, contained).alias("best"))))
    opened = rows.select("_id", "_n", once(F.array(*found)).alias("_found")).select("_id", "_n", F.explode("_found").alias("hit")).where(F.col("hit.best.share") >= contained)
    return opened.select(
        F.col("_id").alias(id_col), F.col("hit.template").alias("template"), F.col("hit.best.share").alias("containment"), (-F.col("hit.best.back")).alias("first_word"), F.col("_n").alias("n_words")
    )


def _best(template: list[int], contained: float) -> Column:
    """struct(share, back): the largest share of the template's shingles among as many from one of them on; null
    if it is below ``contained``. Only places with so many occurrences of shingles are looked at closely."""
    size = len(template)
    need = max(math.ceil(contained * size - 1e-9), 1)
    own = F.expr(f"array({_numbers(template)})")
    at = F.expr(f"filter(sequence(0, size(grams) - 1), i -> grams[i] IN ({_numbers(template)}))")

    def closely(at: Column) -> Column:
        dense = F.filter(F.sequence(F.lit(0), F.size(at) - need), lambda k: F.get(at, k + (need - 1)) < F.get(at, k) + size)
        share = F.transform(dense, lambda k: F.struct((F.size(F.array_intersect(F.slice("grams", F.get(at, k) + 1, size), own)) / size).alias("share"), (-F.get(at, k)).alias("back")))
        return F.when(F.size(at) >= need, F.array_max(share))

    return F.get(F.transform(F.array(at), closely), F.lit(0))  # so that ``at`` is found once


def best_in_place(found: DataFrame, templates: dict[str, str], id_col: str = "doc_id") -> DataFrame:
    """The rows of ``scan`` that no other explains better: of templates whose places in a text overlap, those with
    the most shingles there (ties all stay). So a notice gives its own license, not the related ones too.
    Repeated rows of one id and length are looked at as one text."""
    given = found.sparkSession.createDataFrame(sorted(templates.items()), "template string, text string")
    sizes = {r["template"]: r["n"] for r in _grams(given.select("template", words(F.col("text")).alias("words")), SHINGLE).select("template", F.size(F.array_distinct("grams")).alias("n")).collect()}
    size = F.create_map(*[F.lit(x) for pair in sorted(sizes.items()) for x in pair])[F.col("template")]
    hit = F.struct("template", "containment", "first_word", size.alias("size"), F.round(size * F.col("containment")).alias("met"))
    # A text has at most a row for each template.
    texts = found.groupBy(id_col, "n_words").agg(F.collect_list(hit).alias("hits"))

    def outdone(x: Column, hits: Column) -> Column:
        return F.exists(hits, lambda y: (y["met"] > x["met"]) & (y["first_word"] < x["first_word"] + x["size"]) & (x["first_word"] < y["first_word"] + y["size"]))

    stay = F.filter(F.array_distinct("hits"), lambda x: ~outdone(x, F.col("hits")))
    kept = texts.select(id_col, "n_words", F.explode(stay).alias("hit"))
    return kept.select(id_col, "hit.template", "hit.containment", "hit.first_word", "n_words")
