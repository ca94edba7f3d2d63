"""Licences of files: own headers first, else the nearest directory above with a licence file.

Lines, blocks of adjoining lines and whole texts are compared with templates by the cosine of their TF-IDF vectors.
A text can only reach the threshold if it has one of a template's telling terms: the
other terms together are too short a vector.  So what has none of them is left out before
anything is weighed.  Inheritance joins the directories above a file with
the directories that have a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidematch.session import materialize

HEADER = 0.6
# Share of a text that has to be licence for the file to speak for its directory.
FILE = 0.6
# Adjoining lines are also compared as blocks of these many.
BLOCKS = (1, 2, 3, 4, 6, 8, 12)

# licence, text of one of its notices, headers or short forms
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the BSD License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((name, f"SPDX-License-Identifier: {name}") for name in (
        "Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0", "CC-BY-4.0", "BSD-3-Clause", "MPL-2.0")),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
)

# words without weight
STOP = frozenset("a an and any are as at be been by can for from if in is it its may not of on one or that the this to was were will with you your".split())

TERM = r"[a-z0-9]+(?:[.-][0-9a-z]+)*"


def weights(templates: Sequence[tuple[str, str]], threshold: float):
    """Rows ``(template, term, weight)``, templates by number, of unit vectors; inverse document frequencies; the
    weight of unknown terms; and terms of which a text at the threshold has at least one."""
    terms = {i: Counter(t for t in re.findall(TERM, text.lower()) if t not in STOP) for i, (_, text) in enumerate(templates)}
    holders = Counter(t for c in terms.values() for t in c)
    idf = {t: math.log((1 + len(terms)) / (1 + n)) + 1 for t, n in holders.items()}
    rows, anchors = [], set()
    for i, counts in terms.items():
        raw = {t: n * idf[t] for t, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        rest = 1.0
        # heaviest first, single characters last
        for term, x in sorted(raw.items(), key=lambda e: (len(e[0]) == 1, -e[1], e[0])):
            rows.append((i, term, x / norm))
            if len(term) > 1 or rest >= threshold * threshold:
                anchors.add(term)
            rest -= (x / norm) ** 2
    return rows, idf, math.log(1 + len(terms)) + 1, sorted(anchors)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def best_template(body: Column, templates: Sequence[tuple[str, str]], threshold: float) -> Column:
    """``struct(score, place)`` of the best template of ``body`` at ``threshold``, else null;
    ``place`` falls along the licences by name, so that of equals the first is largest.

    Equal terms are neighbours once sorted, and the length of such a run is the term's
    count.  So a text is weighed within its row and never shuffled.
    """
    rows, idf, unknown, _ = weights(templates, threshold)
    known = sorted(idf)
    names = sorted({name for name, _ in templates})

    def counted(terms):
        starts = F.filter(
            F.sequence(F.lit(0), F.size(terms) - 1), lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda p, k: F.struct(
            F.get(terms, p).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(terms)) - p).cast("double").alias("n"))))

    def weighed(counts):
        others = F.aggregate(
            F.filter(counts, lambda c: ~c["term"].isin(known)), F.lit(0.0), lambda total, c: total + c["n"] * c["n"])
        found = F.map_from_entries(F.filter(counts, lambda c: c["term"].isin(known)))
        raw = let(found, lambda n: F.array(*(F.coalesce(F.try_element_at(n, F.lit(t)), F.lit(0.0)) * idf[t] for t in known)))
        return let(raw, lambda x: F.struct(x.alias("raw"), F.sqrt(
            others * (unknown * unknown) + F.aggregate(x, F.lit(0.0), lambda total, y: total + y * y)).alias("norm")))

    def best(x):
        scores = [
            F.struct(
                F.round(sum(F.get(x["raw"], F.lit(known.index(t))) * w for of, t, w in rows if of == i) / x["norm"], 6)
                .alias("score"), F.lit(-names.index(license)).alias("place"))
            for i, (license, _) in enumerate(templates)]
        return F.array_max(F.filter(F.array(*scores), lambda s: s["score"] >= threshold))

    terms = F.sort_array(F.filter(F.regexp_extract_all(F.lower(body), F.lit(f"({TERM})"), 1), lambda t: ~t.isin(sorted(STOP))))
    return let(terms, lambda t: F.when(F.size(t) > 0, let(let(counted(t), weighed), best)))


def scan(files: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES,
         header: float = HEADER, file: float = FILE) -> DataFrame:
    """``file_id, path, license, found, score, licensed_by`` for every row of ``files``
    (``file_id, path, text``).

    ``found`` is ``file`` if the whole text is like a template, ``header`` if a line or a block of
    adjoining lines is,
    ``inherited`` if a directory above has a licence file (of several in the nearest one
    the best, then the first by path), else ``none``.  Equal scores go to the first
    licence by name.  Null and empty texts have no licence of their own; a null path
    lies in no directory; repeated rows each get a row; an empty table gives none.
    """
    anchors = weights(templates, min(header, file))[3]
    has = rf"(?i)(?<![a-z0-9])(?:{'|'.join(map(re.escape, anchors))})(?![a-z0-9])"
    files = files.select("file_id", "path", "text").withColumn("path", F.col("path").cast("string"))
    whole = best_template(F.col("text"), templates, file)
    # blocks begin at lines with a telling term; any other first line adds next to nothing
    blocks = let(F.split("text", "\n"), lambda lines: F.flatten(F.transform(
        F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(has)),
        lambda i: F.array_distinct(F.array(*(F.array_join(F.slice(lines, i + 1, F.lit(n)), "\n") for n in BLOCKS))))))
    found = files.withColumn("_file", F.when(F.col("text").rlike(has), whole)).withColumn("_best", F.coalesce(
        "_file", F.when(F.col("text").rlike(has), F.array_max(F.transform(blocks, lambda block: best_template(block, templates, header))))))
    names = F.array(*map(F.lit, sorted({name for name, _ in templates})))
    own = materialize(found.select(
        "file_id", "path", F.get(names, -F.col("_best.place")).alias("license"),
        F.when(F.col("_best").isNotNull(), F.col("_file").isNotNull()).alias("_whole"), F.col("_best.score").alias("score"),
        F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("_dir")))
    dirs = own.where("_whole AND path IS NOT NULL").groupBy("_dir").agg(
        F.max("score").alias("_s"), F.min_by(F.struct("file_id", "license"), F.struct(-F.col("score"), "path", "file_id")).alias("_f"))
    bare = own.where("license IS NULL AND path IS NOT NULL").select("path", "_dir").distinct()
    above = bare.select("path", F.explode(F.expr(
        "transform(sequence(1, size(split(_dir, '/'))), k -> array_join(slice(split(_dir, '/'), 1, k), '/'))")).alias("_up"))
    inherited = above.join(dirs.withColumnRenamed("_dir", "_up"), "_up").groupBy("path").agg(
        F.max_by(F.struct("_f", "_s"), F.length("_up")).alias("_from"))
    return own.join(inherited, "path", "left").select(
        "file_id", "path", F.coalesce("license", "_from._f.license").alias("license"),
        F.when(F.col("_whole"), "file").when(F.col("license").isNotNull(), "header")
        .when(F.col("_from").isNotNull(), "inherited").otherwise("none").alias("found"),
        F.coalesce("score", "_from._s").alias("score"),
        F.when(F.col("license").isNotNull(), F.col("file_id")).otherwise(F.col("_from._f.file_id")).alias("licensed_by"))
