"""License scans: TF-IDF cosine of headers and licence files to templates, with directory inheritance.

Native: DataFrame functions only.

Every line of a file that holds a marker is a header candidate, and so is every run of up to ``WINDOW``
adjacent lines that holds one, as headers are wrapped (lines without letters or digits don't count).  The whole
of a licence file (named LICENSE, COPYING, NOTICE and the like) is one more.  All are compared
with templates (declarations, the headers as they are commonly written, titles of the long licences and
the text of short ones) as sparse TF-IDF vectors: document frequencies of all terms are counted over the templates and
all candidates of the corpus but runs of several lines, which would count a line more than once.  A term that no
template has weighs by its own frequency too, but at most as a
term that none of the templates has among the templates alone (``UNKNOWN``): names and years are
rarer the larger the corpus is, and must not lose a header for that.  A file takes the template
with the highest cosine, if that is at least ``THRESHOLD`` and what tells licences apart agrees, which a cosine hardly sees:
the template's versions and clause counts are in the candidate, and both have the same of the words that make another
licence of one (``APART``).  A line ``SPDX-License-Identifier`` is read as an expression of known ids with AND, OR and WITH, and goes before
all else.  A template that others may stand beside (``WEAK``: a reservation of
rights, the opening that two licences share) only where none but such is found.  A file without one inherits from the nearest
directory above it that holds a licence file: directories and their ancestors are joined by path.

The tables that may be broadcast are the templates and their terms, fixed here.  Directories are joined once
each, and files with their directory.

Defined results: null and empty texts have no header and can only inherit.  Null paths inherit
nothing.  Equal cosines go to the first template id in order.  Rows with the same id, or equal in all, are
files of their own.  Columns of the files keep their names and values, whatever they are called; ours get another name
where it is taken.  Empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, fresh

THRESHOLD = 0.6
#: What a line must hold to be a header candidate, and licence files' names.
MARKERS = "(?i)licen[sc]e|copyright|all rights reserved|spdx|public domain|redistribution|neither the name"
#: Markers that hold for a text of several lines too: the wording of grants, and markers that a line break may part.
GRANTS = r"permission\W+is\W+hereby\W+granted|free\W+of\W+charge\W+to\W+any\W+person|permission\W+to\W+use\W+copy\W+modify|permission to use, copy"
WRAPPED = rf"{MARKERS}|{GRANTS}|all\W+rights\W+reserved|public\W+domain"
#: Lines in a run at most: the longest header among the templates, as it is mostly wrapped.
WINDOW = 4
#: Where versions and clause counts stand, in lower case, and words that tell licences of a family apart, alike ones side by side.
VERSIONS = r"(?:version|\bv\.?|gpl|mpl|apache|licen[sc]e|\bby|\bnc|\bsa|\bnd|\bcc0|attribution|sharealike|noncommercial|noderivatives|noderivs)[^a-z0-9]{0,3}([0-9]+(?:\.[0-9]+)?)"
CLAUSES = r"([0-9])[^a-z0-9]?clause"
APART = [["nc", "noncommercial"], ["sa", "sharealike"], ["nd", "noderivatives", "noderivs"], ["affero", "agpl"], ["lesser", "lgpl"], ["library"]]
SPDX_LINE = r"(?i:SPDX-License-Identifier:)[ \t]*([A-Za-z0-9.+()-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9.+()-]+)*)"
FILE_NAMES = "(?i)(^|/)(licen[sc]e|copying|copyright|notice|unlicense)([.-][a-z0-9]+)*$"
#: License ids by which SPDX lines name them.
SPDX = ["AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"]
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
#: License ids and the texts by which files declare them.
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _FREE.format("Affero General Public License", 3)),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _FREE.format("General Public License", 2)),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _FREE.format("General Public License", 3)),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", _FREE.format("Lesser General Public License", 2.1)),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _FREE.format("Lesser General Public License", 3)),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("Proprietary", "All rights reserved."),
]
#: The last templates, which give way to others: two that licences share, and a reservation of rights.
WEAK = {"Redistribution": 1, "All rights": 2}
LEVELS = [next((n for opening, n in WEAK.items() if body.startswith(opening)), 0) for _, body in TEMPLATES]
#: The most that a term outside the templates weighs.
UNKNOWN = 1.0 + math.log(1.0 + len(TEMPLATES))


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits; dots between digits stay."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:\.[0-9]+)*"), F.lit(0))


def told_apart(text: Column) -> Column:
    """(numbers, words): versions without a last .0, clause counts, and which of the words of ``APART`` there are."""
    low = F.lower(text)
    versions = F.transform(F.regexp_extract_all(low, F.lit(VERSIONS), F.lit(1)), lambda x: F.regexp_replace(x, r"\.0$", ""))
    clauses = F.transform(F.regexp_extract_all(low, F.lit(CLAUSES), F.lit(1)), lambda x: F.concat(x, F.lit("c")))
    own = terms(text)
    words = F.filter(F.array(*(F.when(F.arrays_overlap(own, F.array(*map(F.lit, alike))), alike[0]) for alike in APART)), lambda x: x.isNotNull())
    return F.struct(F.array_distinct(F.concat(versions, clauses)).alias("numbers"), words.alias("words"))


def spdx_expression(text: Column) -> Column:
    """What the first SPDX line says, if all its ids are known: single blanks between its parts, ids without -only and -or-later; else null."""
    said = F.regexp_extract(text, SPDX_LINE, 1)
    for pattern, instead in ((r"[ \t]+", " "), (r"\.+$", ""), (r"-(only|or-later)\b", "")):
        said = F.regexp_replace(said, pattern, instead)
    ids = F.split(F.regexp_replace(said, r" WITH [^ ]+|[()+]", ""), " (AND|OR) ")
    return F.when(F.forall(ids, lambda i: i.isin(SPDX)), said)


def _parents(path: Column) -> Column:
    """All directories above a path, the nearest first; the top is the empty path."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array(F.lit("")))


def _runs(text: Column) -> Column:
    """Runs of two to ``WINDOW`` adjacent lines that hold a marker.

    Lines are a lambda's argument, so that they are cut once for a text; a column would be computed again for every line.
    """

    def of(lines: Column) -> Column:
        def long(k: int) -> Column:
            return F.transform(lines, lambda _, i: F.when(i + k <= F.size(lines), F.array_join(F.slice(lines, i + 1, k), "\n")))

        return F.filter(F.concat(*map(long, range(2, WINDOW + 1))), lambda x: x.isNotNull() & x.rlike(WRAPPED))

    solid = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    return F.get(F.transform(F.array(solid), of), F.lit(0))


def scan(files: DataFrame, path: Column, threshold: float = THRESHOLD) -> DataFrame:
    """The files with license_path, license, similarity, origin (file, header, inherited or null) and license_dir."""
    spark = files.sparkSession
    work = Workspace(spark, "licenses")
    kept = [c for c in files.columns if c != "text"]
    # Ids for rows, fixed once written; texts and the user's columns stay behind, under names of ours.
    numbered = files.select(F.monotonically_increasing_id().alias("nr"), path.alias("path"), F.col("text").alias("text"), F.struct(*(F.col(f"`{c}`") for c in kept)).alias("own") if kept else F.lit(None).alias("own"))
    marked = numbered.withColumn("is_file", F.coalesce(F.col("path").rlike(FILE_NAMES), F.lit(False)))
    has = F.coalesce(F.col("text").rlike(WRAPPED), F.lit(False))
    none = F.array().cast("array<struct<alone: boolean, passage: string>>")
    passage = lambda alone, x: F.struct(F.lit(alone).alias("alone"), x.alias("passage"))
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(WRAPPED)), lambda x: passage(True, x))
    found = work.stage(
        marked.select(
            "nr", "path", "is_file", "own",
            F.when(has, F.concat(lines, F.transform(_runs(F.col("text")), lambda x: passage(False, x)))).otherwise(none).alias("lines"),
            F.when(F.col("is_file") & F.col("text").isNotNull(), F.array(passage(True, F.col("text")))).otherwise(none).alias("whole"),
            F.when(has, spdx_expression(F.col("text"))).alias("spdx"),
        ),
        "files",
    )

    passages = found.select("nr", F.posexplode(F.concat("lines", "whole")).alias("nth", "p")).select("nr", "nth", "p.alone", "p.passage")
    counts = passages.select("nr", "nth", "alone", F.explode(terms(F.col("passage"))).alias("term")).groupBy("nr", "nth", "alone", "term").agg(F.count("*").alias("tf"))
    counts = work.stage(counts, "terms")
    templates = spark.createDataFrame([(i, a, level, b) for i, ((a, b), level) in enumerate(zip(TEMPLATES, LEVELS))], "template int, license string, level int, body string")
    own = templates.select("template", "license", "level", F.explode(terms(F.col("body"))).alias("term")).groupBy("template", "license", "level", "term").agg(F.count("*").alias("t_tf"))
    vocabulary = own.groupBy("term").agg(F.count("*").alias("t_df"))
    n = passages.where("alone").count() + len(TEMPLATES)
    weight = lambda df: F.log(F.lit(1.0 + n) / (1 + df)) + 1
    seen = work.stage(counts.where("alone").groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    held = seen.join(F.broadcast(vocabulary.select("term")), "term")
    idf = vocabulary.join(F.broadcast(held), "term", "left").select("term", weight(F.col("t_df") + F.coalesce("df", F.lit(0))).alias("idf"))
    weighted = own.join(idf, "term").withColumn("w", F.col("t_tf") * F.col("idf"))
    norms = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    weighted = weighted.join(norms, "template").select("term", "template", "license", "level", (F.col("w") / F.col("t_norm")).alias("t_w"))
    # Terms outside the templates grow with the corpus, so only those that weigh less than UNKNOWN are joined, by hash.
    common = seen.where(weight(F.col("df")) < UNKNOWN).join(F.broadcast(vocabulary.select("term")), "term", "left_anti").select("term", weight(F.col("df")).alias("idf"))
    weights = idf.unionByName(common)
    mine = counts.join(weights, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(UNKNOWN)))
    lengths = mine.groupBy("nr", "nth").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = mine.join(F.broadcast(weighted), "term").groupBy("nr", "nth", "template", "license", "level").agg(F.sum(F.col("w") * F.col("t_w")).alias("dot"))
    scored = dots.join(lengths, ["nr", "nth"]).select("nr", "nth", "license", "level", "template", F.round(F.col("dot") / F.col("norm"), 9).alias("similarity")).where(F.col("similarity") >= threshold)
    # The few that are near enough meet what tells their passages and templates apart.
    apart = templates.select("template", told_apart(F.col("body")).alias("theirs"))
    met = scored.join(passages.select("nr", "nth", told_apart(F.col("passage")).alias("ours")), ["nr", "nth"]).join(F.broadcast(apart), "template")
    agree = (F.size(F.array_except("theirs.numbers", "ours.numbers")) == 0) & (F.col("theirs.words") == F.col("ours.words"))
    best = met.where(agree).groupBy("nr").agg(F.max_by(F.struct("license", "similarity"), F.struct(-F.col("level"), "similarity", -F.col("template"))).alias("near"))
    said = F.when(F.col("spdx").isNotNull(), F.struct(F.col("spdx").alias("license"), F.lit(1.0).alias("similarity")))
    named = work.stage(found.drop("lines", "whole").join(best, "nr", "left").withColumn("best", F.coalesce(said, "near")).drop("spdx", "near"), "named")

    # Licence files give their directory a license; directories look upwards for the nearest that has one.
    folder = F.get(_parents(F.col("path")), F.lit(0))
    given = named.where(F.col("is_file") & F.col("best").isNotNull()).groupBy(folder.alias("up")).agg(F.max_by("best", F.struct("best.similarity", "path")).alias("from_up"))
    given = work.stage(given, "given")
    folders = named.where("path IS NOT NULL").select(_parents(F.col("path")).alias("ups")).distinct()
    nearest = (
        folders.select(F.get("ups", F.lit(0)).alias("dir"), F.posexplode("ups").alias("far", "up"))
        .join(given, "up")
        .groupBy("dir")
        .agg(F.min_by(F.struct("up", "from_up"), "far").alias("near"))
    )
    nearest = work.stage(nearest, "nearest")
    joined = named.withColumn("folder", folder).join(nearest, F.col("folder") == F.col("dir"), "left")
    ours = {
        "license_path": F.col("path"),
        "license": F.coalesce("best.license", "near.from_up.license"),
        "similarity": F.coalesce("best.similarity", "near.from_up.similarity"),
        "origin": F.when(F.col("best").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header")).when(F.col("near").isNotNull(), "inherited"),
        "license_dir": F.when(F.col("best").isNull(), F.col("near.up")),
    }
    names = fresh(files, *ours)
    return joined.select(*(F.col(f"own.`{c}`").alias(c) for c in kept), *(c.alias(a) for a, c in zip(names, ours.values())))
