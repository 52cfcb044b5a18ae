"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies. DataFrame functions only.

Texts are lower-cased and split into runs of letters and digits; shingles are SHINGLE words (a shorter template is one shingle).
Templates are put in classes of c shingles, c the least power of 2 not below their number (4 at least). For each class a text is cut into windows of
2 c shingles every c / 2, so a run of c shingles lies whole in some window. A window that holds `threshold` of a
template's shingles has a Jaccard similarity of 0.8 * (c / 2) / (2 c + 0.1 c) = 0.19 or more with it (of a class's least template), and with BANDS bands of one row
they meet with a probability of 1 - 0.81 ** 64 > 0.999998. Windows retrieved are then verified on the shingles themselves.

Before any of this a text, and then a window, must hold one of the anchor words: words chosen from the templates so that more than 1 -
threshold of each one's shingles hold one. A window without any cannot reach the threshold, so nothing is lost.

Defined cases: null, empty or blank texts match nothing; repeated rows are each returned; an empty table gives no rows;
very long texts are scanned whole in windows; other columns are not read. The templates are a parameter of bounded size (MAX_TEMPLATES), checked.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch, spread

SHINGLE, THRESHOLD, BANDS = 5, 0.8, 64
MAX_TEMPLATES = 2000
#: Rows a task takes, of documents with an anchor and of windows: few bytes, much work.
DOCS, WINDOWS = 512, 4096

#: Notices by which licenses are commonly named.
TEMPLATES: Mapping[str, str] = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "mit-line": "Released under the MIT License",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
}


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def shingles_of(text: str) -> list[str]:
    w = words_of(text)
    return list(dict.fromkeys(" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))))


def anchors(templates: Mapping[str, str], threshold: float = THRESHOLD) -> list[str]:
    """Long words first, until more than 1 - threshold of each template's shingles hold one."""
    out: set[str] = set()
    for t in templates.values():
        sh = [set(s.split()) for s in shingles_of(t)]
        todo = sorted(set(words_of(t)), key=lambda w: (-len(w), w))
        while sum(bool(s & out) for s in sh) <= (1 - threshold) * len(sh) + 1e-9:
            out.add(todo.pop(0))
    return sorted(out)


def class_of(n: int) -> int:
    c = 4
    while c < n:
        c *= 2
    return c


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """_r (a row's number within this query), license, containment: a row for each template that a row of docs holds. docs has _r and text."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates: split them")
    spark = docs.sparkSession
    rows = [(k, class_of(len(s)), s) for k, t in sorted(templates.items()) if (s := shingles_of(t))]
    classes = sorted({(r[1], len(r[2][0].split())) for r in rows})
    words = sorted(anchors(templates, threshold))
    # transform(array(x), v -> ...)[0] binds v to x once; a column read in a lambda may be worked out for every element.
    hashed = f"transform(array(transform(own, s -> xxhash64(s))), sh -> transform(sequence(1, {bands}), b -> xxhash64(b, array_min(transform(sh, s -> xxhash64(s, b))))))[0]"
    known = spark.createDataFrame(rows, "license string, class int, template array<string>").withColumn("size", F.expr("size(split(template[0], ' '))"))
    keys = known.withColumn("own", F.col("template")).select("license", "class", "size", "template", F.explode(F.expr(hashed)).alias("key"))

    plain = F.btrim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
    anchored = F.lit(False)
    for w in words:
        anchored = anchored | F.contains(F.col("_low"), F.lit(w))
    scratch = Scratch(spark, "license-scan")
    d = docs.withColumn("_low", F.lower("text")).where(anchored).select("_r", F.split(plain, " ").alias("w"))
    d = spread(scratch.keep(d, "words"), DOCS)  # few documents hold an anchor
    held = "array(" + ", ".join(f"'{w}'" for w in words) + ")"
    # (class, shingle size, first shingle) of windows that hold an anchor: found from the anchors' places, not by trying all.
    places = F.expr(f"filter(transform(w, (x, i) -> if(array_contains({held}, x), i, null)), i -> i is not null)")
    d = d.withColumn("at", places).where("size(at) > 0")
    parts = [
        f"transform(array_distinct(flatten(transform(at, i -> sequence(greatest(0, (i - {k - 1} - {2 * c - 1} + {c // 2 - 1}) div {c // 2}), i div {c // 2})))), x -> struct({c} as class, {k} as size, x * {c // 2} as first))"
        for c, k in classes
    ]
    d = d.select("_r", "w", F.explode(F.expr("concat(" + ", ".join(parts) + ")")).alias("win")).select("_r", "w", "win.*")
    d = d.select("_r", "class", "size", "first", F.expr("slice(w, first + 1, 2 * class + size - 1)").alias("w"))
    d = d.where("size(w) >= size").withColumn("own", F.expr("transform(array(w), v -> array_distinct(transform(sequence(1, size(v) - size + 1), i -> array_join(slice(v, i, size), ' '))))[0]"))
    d = spread(scratch.keep(d.select("_r", "class", "size", "first", "own"), "windows"), WINDOWS)
    d = d.select("_r", "class", "size", "first", "own", F.explode(F.expr(hashed)).alias("key"))
    met = d.join(F.broadcast(keys), ["class", "size", "key"]).dropDuplicates(["_r", "class", "size", "first", "license"])
    share = F.size(F.array_intersect("template", "own")) / F.size("template")
    found = met.select("_r", "license", share.alias("containment")).where(F.col("containment") >= threshold)
    return found.groupBy("_r", "license").agg(F.max("containment").alias("containment"))


def report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_licenses, licenses (names in order, comma-joined) of each row of docs."""
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    # Rows alike in doc_id and text are scanned once and get the same.
    found = scan(d.select(F.struct("doc_id", "_h").alias("_r"), "text"), **how).groupBy("_r").agg(F.sort_array(F.collect_set("license")).alias("l"))
    found = found.select(F.col("_r.doc_id").alias("_d"), F.col("_r._h").alias("_g"), "l")
    all_rows = d.select("doc_id", "_h").join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_g")), "left")
    return all_rows.select("doc_id", F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("n_licenses"), F.coalesce(F.array_join("l", ","), F.lit("")).alias("licenses"))
