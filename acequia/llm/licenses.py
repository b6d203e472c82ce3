r"""Licence detection: sparse TF-IDF cosine to templates, then inheritance along directories.

Words are weighted by their inverse frequency over all files and templates. A
word that fewer than ``RARE`` of them hold weighs as if that share held it, so
weights depend on shares alone and do not grow with the number of files; and
the words that weigh less are few, at most 1 / ``RARE`` times the mean number
of different words in a file. A header is a run of
lines that hold a cue, with at most one line between them. Cues follow from
the weights: a text whose cosine to a template reaches ``least`` must hold
words with at least that share of the template's length, so a template's
commonest words, as many as leave that guarantee, are no cues and all others
are. No header above the threshold is missed, and words of running prose pick
out no lines.

Every cue line and every run is compared by itself, so prose beside a notice
does not hide it. A header shares ``SHARED`` words with a template, or all of a
shorter one, and takes the template of the largest cosine, a file
that of its best header. Where another licence comes within ``MARGIN`` of the
best, the file is ambiguous: it gets no licence, and ``candidates`` names those
that fit. A line ``SPDX-License-Identifier:`` is exact: the identifier, or the
expression of identifiers, on a file's first such line is its licence, score 1.
A file is a licence file if it is named like one, or if a header makes
up ``file_share`` of its words; its licence holds for its directory. A file
without a header of its own inherits from the nearest directory above it.

Everything is a DataFrame expression or a join; templates and the weights of
their and of common words are the only things broadcast.

Defined cases: a null or empty text has no header and can inherit; a null path
belongs to no directory; rows repeated get equal rows, and rows of one path
with different texts are told apart by a hash of the text; ties go to the
first licence name, then the first line; empty tables give empty results;
further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acequia.llm.common import col
from acequia.session import materialize

LEAST = 0.6
FILE_SHARE = 0.5
#: Share of files below which a word weighs no more.
RARE = 0.05
#: Keys over which the files of a directory are dealt.
SALTS = 32
FILE_NAME = r"(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"

# Short notices by which works refer to a licence, headings and
# opening sentences of licence texts, and the whole of short ones.
_GNU = (
    "This {work} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {kind} "
    "as published by the Free Software Foundation{stop} either version {version} of the License, or (at your option) "
    "any later version."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. {third}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
    'CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
    "CONSEQUENTIAL DAMAGES"
)
_ENDORSE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted{kept}. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
    "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
)
_ISC_KEPT = ", provided that the above copyright notice and this permission notice appear in all copies"
_GPL, _LESSER, _LIBRARY, _AFFERO = (f"{kind}General Public License" for kind in ("", "Lesser ", "Library ", "Affero "))


def _gnu(kind: str, version: str, heading: str, work: str = "program", stop: str = ":") -> tuple[str, ...]:
    return (
        f"This work is licensed under the GNU {kind}, version {version}.",
        f"Licensed under the GNU {kind} v{version}",
        f"GNU {kind.upper()} Version {version}, {heading}",
        f"GNU {kind.upper()} Version {version}, {heading} Copyright (C) Free Software Foundation, Inc. Everyone is "
        "permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        _GNU.format(work=work, kind=kind, version=version, stop=stop),
    )


def _commons(code: str, name: str) -> tuple[str, ...]:
    return (f"Licensed under CC {code} 4.0.", f"Creative Commons {name} 4.0 International License",
            f"This work is licensed under a Creative Commons {name} 4.0 International License.")


def _named(*names: str) -> tuple[str, ...]:
    """Notices that give a licence's name."""
    return tuple(
        form.format(name) for name in names for form in ("Released under the {}.", "Licensed under the {}.", "{}")
    )


TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
        "REPRODUCTION, AND DISTRIBUTION",
    ),
    "MIT": (
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction',
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies "
        'or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND',
    ),
    "GPL-2.0": _gnu(_GPL, "2", "June 1991", stop=";"),
    "GPL-3.0": _gnu(_GPL, "3", "29 June 2007"),
    "LGPL-2.0": _gnu(_LIBRARY, "2", "June 1991", "library", ";"),
    "LGPL-2.1": _gnu(_LESSER, "2.1", "February 1999", "library", ";"),
    "LGPL-3.0": _gnu(_LESSER, "3", "29 June 2007", "library"),
    "AGPL-3.0": _gnu(_AFFERO, "3", "19 November 2007"),
    "BSD-2-Clause": (*_named("BSD 2-Clause License", "Simplified BSD License"), _BSD.format(third="")),
    "BSD-3-Clause": (*_named("BSD 3-Clause License", "New BSD License"), _BSD.format(third=_ENDORSE)),
    "ISC": (*_named("ISC License"), _ISC.format(kept=_ISC_KEPT)),
    "0BSD": (*_named("BSD Zero Clause License"), _ISC.format(kept="")),
    "MPL-1.1": (
        *_named("Mozilla Public License Version 1.1"),
        'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may '
        "not use this file except in compliance with the License.",
    ),
    "MPL-2.0": (
        *_named("Mozilla Public License Version 2.0"),
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "EPL-1.0": (
        *_named("Eclipse Public License - v 1.0"),
        "All rights reserved. This program and the accompanying materials are made available under the terms of the "
        "Eclipse Public License v1.0 which accompanies this distribution, and is available at "
        "http://www.eclipse.org/legal/epl-v10.html",
    ),
    "EPL-2.0": (
        *_named("Eclipse Public License - v 2.0"),
        "This program and the accompanying materials are made available under the terms of the Eclipse Public "
        "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "EUPL-1.2": (
        *_named("European Union Public Licence v. 1.2"),
        "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - "
        'subsequent versions of the EUPL (the "Licence"); You may not use this work except in compliance with the '
        "Licence.",
    ),
    "EUPL-1.1": (
        *_named("European Union Public Licence v. 1.1"),
        'Licensed under the EUPL, Version 1.1 only (the "Licence"); You may not use this work except in compliance '
        "with the Licence.",
    ),
    "CDDL-1.0": (
        *_named("Common Development and Distribution License (CDDL) Version 1.0"),
        "The contents of this file are subject to the terms of the Common Development and Distribution License "
        '(the "License"). You may not use this file except in compliance with the License.',
    ),
    "BSL-1.0": (
        *_named("Boost Software License, Version 1.0"),
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy "
        "at http://www.boost.org/LICENSE_1_0.txt)",
        "Boost Software License - Version 1.0 - August 17th, 2003",
    ),
    "Zlib": (
        *_named("zlib License"),
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
        "be held liable for any damages arising from the use of this software. Permission is granted to anyone to "
        "use this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions",
    ),
    "Artistic-2.0": (*_named("Artistic License 2.0"), "The Artistic License 2.0 Copyright (c) 2000-2006, The Perl Foundation."),
    "PSF-2.0": (*_named("Python Software Foundation License Version 2"),),
    "PostgreSQL": (
        *_named("PostgreSQL License"),
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, "
        "without fee, and without a written agreement is hereby granted, provided that the above copyright notice "
        "and this paragraph and the following two paragraphs appear in all copies.",
    ),
    "MS-PL": _named("Microsoft Public License (Ms-PL)"),
    "OFL-1.1": (
        *_named("SIL Open Font License 1.1"),
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    ),
    "AFL-3.0": (*_named("Academic Free License v. 3.0"), "Licensed under the Academic Free License version 3.0"),
    "OSL-3.0": (*_named("Open Software License v. 3.0"), "Licensed under the Open Software License version 3.0"),
    "NCSA": _named("University of Illinois/NCSA Open Source License"),
    "WTFPL": (
        *_named("Do What The Fuck You Want To Public License"),
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004",
    ),
    "CC-BY-4.0": _commons("BY", "Attribution"),
    "CC-BY-SA-4.0": _commons("BY-SA", "Attribution-ShareAlike"),
    "CC-BY-ND-4.0": _commons("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-NC-4.0": _commons("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-NC-SA-4.0": _commons("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0": _commons("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "CC0-1.0": ("CC0 1.0 Universal Public Domain Dedication", "Creative Commons CC0 1.0 Universal"),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software",
    ),
}
#: A line that names its licence outright; what follows is an identifier or an expression of some.
SPDX = r"SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+(?:\s+(?:OR|AND|WITH)\s+[A-Za-z0-9.+-]+)*)"
#: Two licences whose cosines differ by less are not told apart.
MARGIN = 0.005
#: Different words that a header shares with a template at least, or all of a shorter one: a lone
#: common word (as ``mit`` in German) is no licence, however much of a short name it makes up.
SHARED = 3
WORD_BREAK = r"[^\p{L}\p{N}]+"


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


class Vocabulary:
    """Weights of the templates' words, the templates as unit vectors, and the cues.

    ``files`` is the number of files, ``held`` in how many of them a word is.
    """

    def __init__(self, templates: dict[str, tuple[str, ...]], least: float, files: int, held: dict[str, int]):
        counts = [(name, Counter(template_words(t))) for name, texts in templates.items() for t in texts]
        own = Counter(w for _, words in counts for w in words)
        total = files + len(counts)

        def weight(n: int) -> float:
            return math.log(1 + min(total / (1 + n), 1 / RARE))

        self.unseen = weight(0)
        self.idf = {w: weight(own[w] + held.get(w, 0)) for w in {*own, *held}}
        self.vectors, self.sizes, self.cues = [], [], set()
        for number, (name, words) in enumerate(counts):
            raw = {w: n * self.idf[w] for w, n in words.items()}
            length = math.sqrt(sum(x * x for x in raw.values()))
            self.vectors += [(number, name, w, x / length) for w, x in raw.items()]
            self.sizes.append((number, min(len(raw), SHARED)))
            spared = 0.0
            for word in sorted(raw, key=lambda w: (-held.get(w, 0), raw[w], w)):
                spared += (raw[word] / length) ** 2
                if spared >= least * least:
                    self.cues.add(word)


def vocabulary(
    files: DataFrame, text: str, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST
) -> Vocabulary:
    """Weights by the frequency of words over all files; the templates' and the common words come back."""
    words = sorted({w for texts in templates.values() for t in texts for w in template_words(t)})
    found = F.array_distinct(_words(F.coalesce(col(text), F.lit(""))))
    # The empty word stands in every file.
    every = files.select(F.explode(F.concat(F.array(F.lit("")), found)).alias("word"))
    counts = materialize(every.groupBy("word").count(), "licences")
    whole = counts.where(F.col("word") == "").first()
    n_files = whole["count"] if whole else 0
    known = F.col("word").isin(words) | (F.col("count") + 1 > RARE * n_files)
    held = {r["word"]: r["count"] for r in counts.where(known & (F.col("word") != "")).collect()}
    return Vocabulary(templates, least, n_files, held)


def _words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), WORD_BREAK), lambda w: w != "")


def candidates(files: DataFrame, path: str, text: str, cues: set[str]) -> DataFrame:
    """Path, text hash, number of words, and the lines that hold a cue with their words."""
    cue = F.array(*[F.lit(c) for c in sorted(cues)])
    lines = F.transform(
        F.split(F.coalesce(col(text), F.lit("")), "\n"),
        lambda line, i: F.struct(i.alias("line"), _words(line).alias("words")),
    )
    held = F.filter(lines, lambda x: F.arrays_overlap(x["words"], cue))
    rows = files.select(
        col(path).alias("path"), F.xxhash64(col(text)).alias("hash"), held.alias("lines"), col(text).alias("text")
    )
    total = F.when(F.size("lines") > 0, F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+"))).otherwise(0)
    named = F.when(F.contains("text", F.lit("SPDX-License-Identifier:")), F.regexp_extract("text", SPDX, 1))
    spdx = F.when(named != "", F.regexp_replace(named, r"\s+", " "))
    return rows.select("path", "hash", total.cast("long").alias("n_words"), "lines", spdx.alias("spdx"))


def _headers(found: DataFrame) -> DataFrame:
    """Cue lines and their runs: file, kind, first line, words."""
    lines = found.where(F.size("lines") > 0).select("path", "hash", "n_words", F.explode("lines").alias("x"))
    # Repeated rows are one file here.
    lines = lines.select("path", "hash", "n_words", "x.line", "x.words").dropDuplicates(["path", "hash", "line"])
    order = Window.partitionBy("path", "hash").orderBy("line")
    gap = F.coalesce(F.col("line") - F.lag("line").over(order) > 2, F.lit(True))
    starts = lines.withColumn("first", F.when(gap, F.col("line")))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.last("first", ignorenulls=True).over(upto)
    both = F.array(
        F.struct(F.lit("line").alias("kind"), F.col("line").alias("first")),
        F.struct(F.lit("run").alias("kind"), run.alias("first")),
    )
    return starts.withColumn("both", both).select("path", "hash", "n_words", "words", F.inline("both"))


def score_headers(found: DataFrame, known: Vocabulary, least: float = LEAST) -> DataFrame:
    """The best header of each file that has one: licence, cosine, share of the file's words, licences that fit."""
    spark = found.sparkSession
    weights = spark.createDataFrame(list(known.idf.items()), "word string, idf double")
    vectors = spark.createDataFrame(known.vectors, "template int, license string, word string, weight double")
    vectors = vectors.join(spark.createDataFrame(known.sizes, "template int, shared int"), "template")
    file = ["path", "hash", "n_words", "kind", "first"]
    words = (
        _headers(found)
        .select(*file, F.explode("words").alias("word"))
        .groupBy(*file, "word")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(F.broadcast(weights), "word", "left")
        .withColumn("x", F.col("n") * F.coalesce("idf", F.lit(known.unseen)))
    )
    sizes = words.groupBy(*file).agg(
        F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"), F.sum("n").alias("n_header")
    )
    dots = (
        words.join(F.broadcast(vectors), "word")
        .groupBy(*file, "template", "license", "shared")
        .agg(F.sum(F.col("x") * F.col("weight")).alias("dot"), F.count(F.lit(1)).alias("common"))
        .where("common >= shared")
    )
    null_safe = [sizes[c].eqNullSafe(dots[c]) for c in file]
    cosines = sizes.join(dots, null_safe).select(
        sizes["path"], sizes["hash"], sizes["first"], "license",
        (F.col("dot") / F.col("length")).alias("score"),
        (F.col("n_header") / sizes["n_words"]).alias("share"),
    )
    rank = F.struct(
        (-F.round("score", 9)).alias("down"), F.col("license"), F.col("first"), F.col("score"), F.col("share")
    )
    # The best header of each licence, then of the file: a file has few licences.
    single = cosines.where(F.col("score") >= least).groupBy("path", "hash", "license").agg(F.min(rank).alias("b"))
    best = single.groupBy("path", "hash").agg(
        F.min("b").alias("b"), F.collect_list(F.struct("license", "b.score")).alias("all")
    )
    near = F.filter("all", lambda x: x["score"] >= F.col("b.score") - MARGIN)
    fit = F.array_sort(F.transform(near, lambda x: x["license"]))
    return best.select(
        "path", "hash", F.when(F.size(fit) == 1, F.col("b.license")).alias("license"), "b.score", "b.share",
        fit.alias("candidates"),
    )


def _directory(path: Column) -> Column:
    """The path up to its last slash; empty for the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _above(directory: Column) -> Column:
    """A directory and all above it, with their depths; the root is the empty path, depth 0."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("at")),
    )


def scan(
    files: DataFrame,
    *,
    path: str = "path",
    text: str = "text",
    least: float = LEAST,
    file_share: float = FILE_SHARE,
    templates: dict[str, tuple[str, ...]] = TEMPLATES,
) -> DataFrame:
    """One row per row of ``files``: path, text hash, licence, cosine, evidence, candidates.

    Evidence is ``file`` for a licence file, ``spdx``, ``header``, ``ambiguous``
    (no licence, but ``candidates``), ``inherited`` or null.
    """
    known = vocabulary(files, text, templates, least)
    found = materialize(candidates(files, path, text, known.cues), "licences")
    own = score_headers(found, known, least)
    named = F.regexp_extract("path", r"([^/]*)$", 1).rlike(FILE_NAME)
    is_file = named | (F.col("share") >= file_share)
    own = own.withColumn("is_file", F.coalesce(is_file, F.lit(False)))
    # What a file says outright goes before what its headers resemble.
    said = found.where("spdx is not null").select(
        "path", "hash", F.col("spdx").alias("license"), F.lit(1.0).alias("score"), F.array("spdx").alias("candidates"),
        F.lit(False).alias("is_file"), F.lit(True).alias("by_spdx"),
    )
    told = own.drop("share").withColumn("by_spdx", F.lit(False)).unionByName(said)
    own = told.groupBy("path", "hash").agg(
        F.max_by(F.struct("license", "score", "candidates"), "by_spdx").alias("best"),
        F.max("is_file").alias("is_file"),
        F.max("by_spdx").alias("by_spdx"),
    )
    own = own.select("path", "hash", "best.*", "is_file", "by_spdx")
    own = materialize(own, "licences")

    first = F.min(F.struct((-F.round("score", 9)).alias("down"), "license", "path", "score"))
    held = (
        own.where("is_file and path is not null and license is not null")
        .groupBy(_clean(_directory(F.col("path"))).alias("at"))
        .agg(first.alias("f"))
        .select("at", F.col("f.license").alias("license"))
    )
    # Each directory is looked up once, however many files it holds.
    directories = found.where("path is not null").select(_directory(F.col("path")).alias("directory")).distinct()
    steps = directories.select("directory", F.explode(_above(F.col("directory"))).alias("s"))
    inherited = (
        steps.join(held, F.col("s.at") == held["at"])
        .groupBy("directory")
        .agg(F.max(F.struct("s.depth", "license")).alias("near"))
        .select("directory", F.col("near.license").alias("from_above"))
    )
    rows = found.select("path", "hash").withColumn("directory", _directory(F.col("path")))
    # One directory may hold a third of all files: its files are dealt over SALTS keys.
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("path", "hash"), F.lit(SALTS)).cast("int"))
    salted = inherited.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.join(salted, ["directory", "salt"], "left")
    mine = own.select(
        F.col("path").alias("own_path"), F.col("hash").alias("own_hash"), "license", "score", "is_file", "candidates", "by_spdx"
    )
    joined = rows.join(
        mine, F.col("path").eqNullSafe(F.col("own_path")) & (F.col("hash") == F.col("own_hash")), "left"
    )
    evidence = (
        F.when(F.col("license").isNull() & (F.size("candidates") > 1), F.lit("ambiguous"))
        .when(F.col("is_file"), F.lit("file"))
        .when(F.col("by_spdx"), F.lit("spdx"))
        .when(F.col("license").isNotNull(), F.lit("header"))
        .when(F.col("from_above").isNotNull(), F.lit("inherited"))
    )
    inherited_one = F.when(F.size("candidates") > 1, F.col("license")).otherwise(F.coalesce("license", "from_above"))
    return joined.select(
        "path", "hash", inherited_one.alias("license"), "score", evidence.alias("evidence"), "candidates"
    )


def _clean(directory: Column) -> Column:
    """A directory as ``_above`` writes it: parts between single slashes."""
    return F.array_join(F.filter(F.split(directory, "/"), lambda p: p != ""), "/")
