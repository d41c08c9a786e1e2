"""Licences of files: sparse TF-IDF cosine to templates, then inheritance from the nearest directory."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, body, stored
from .licence_headers import long_templates

# One-line notices of common licences; headers and licence files are in licence_headers.py.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "ISC": ["Licensed under the ISC License."],
    "LGPL-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.-].*)?$"
#: Parts that the files of one directory are dealt to where they meet its licence.
SALTS = 64
#: Versions and families weigh like terms of no other file: they tell apart what is else the same.
DECIDING = frozenset("1 2 3 4 1.0 2.0 2.1 3.0 4.0 2-clause 3-clause lesser library affero sharealike noncommercial by by-sa by-nc".split())
TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def terms(text: str) -> set[str]:
    return set(TERM.findall(text.lower()))


class Templates:
    """Templates as sparse vectors of inverse document frequencies; other terms weigh as unseen ones.

    ``long`` ones (headers, licence files) are told by the number of terms a unit must share with them.
    """

    def __init__(self, templates: dict[str, list[str]], documents: int, frequency: dict[str, int], long: dict[str, list[str]] | None = None, least: float = 0.6) -> None:
        self.rows = [(name, terms(t)) for name, versions in templates.items() for t in versions]
        long_rows = [(name, terms(t)) for name, versions in (long or {}).items() for t in versions]
        vocabulary = {t for _, own in self.rows + long_rows for t in own}
        self.unseen = float(np.log(1 + documents)) + 1
        self.idf = {t: self.unseen if t in DECIDING else float(np.log((1 + documents) / (1 + frequency.get(t, 0)))) + 1 for t in vocabulary}
        self.norms = [sum(self.idf[t] ** 2 for t in own) ** 0.5 for _, own in self.rows]
        self.long = []
        for name, own in long_rows:
            weights = np.sort([self.idf[t] ** 2 for t in own])[::-1]
            # a cosine of least needs shared squares of least^2 of the whole, so this many terms
            shared = int(np.searchsorted(np.cumsum(weights), least**2 * weights.sum() * (1 - 1e-9))) + 1
            self.long.append((name, own, float(weights.sum()) ** 0.5, shared))
        self.fewest = min((shared for *_, shared in self.long), default=None)

    def rare(self, least: float) -> set[str]:
        """Terms of which a unit must hold one to reach a cosine of ``least`` with any template.

        The others together weigh too little in every template.
        """
        common: set[str] = set()
        for term in sorted(self.idf, key=lambda t: (self.idf[t], t)):
            wider = common | {term}
            if any(sum(self.idf[t] ** 2 for t in own & wider) >= (least * norm) ** 2 for (_, own), norm in zip(self.rows, self.norms)):
                break
            common = wider
        return set(self.idf) - common

    def best(self, unit: str) -> tuple[float, str | None]:
        own = terms(unit)
        known = own & self.idf.keys()
        if not known:
            return 0.0, None
        norm = (sum(self.idf[t] ** 2 for t in known) + (len(own) - len(known)) * self.unseen**2) ** 0.5
        rows = [(name, known & row, n) for (name, row), n in zip(self.rows, self.norms)]
        if self.fewest is not None and len(known) >= self.fewest:
            rows += [(name, both, n) for name, row, n, shared in self.long if len(known) >= shared and len(both := known & row) >= shared]
        found = [(round(sum(self.idf[t] ** 2 for t in sorted(both)) / (norm * n), 12), name) for name, both, n in rows]
        # ties go to the name that comes first
        return min(found, key=lambda x: (-x[0], x[1]), default=(0.0, None))

    def may_be_long(self, unit: str) -> bool:
        """Whether a unit could hold the terms that some long template asks for."""
        return self.fewest is not None and len(unit) >= 2 * self.fewest - 1 and len(terms(unit) & self.idf.keys()) >= self.fewest


def term_frequencies(files: DataFrame, vocabulary: set[str]) -> tuple[int, dict[str, int]]:
    """Number of files, and of files with each template term; all files count."""

    def run(batches):
        total, counts = 0, dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for text in batch.column(0):
                total += 1
                for term in terms(text.as_py()) & vocabulary:
                    counts[term] += 1
        yield [["", *counts], [total, *counts.values()]]

    rows = files.select(body("text")).mapInArrow(arrow_rows(run, pa.schema([("term", pa.string()), ("n", pa.int64())])), "term string, n long")
    found = {r.term: r.n for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # one row per template term
    return found.pop("", 0), found


def own_licences(files: DataFrame, templates: Templates, least: float) -> DataFrame:
    """(path, licence, cosine, whole): the best template of any line, paragraph, or the whole text."""
    schema = pa.schema([("path", pa.string()), ("licence", pa.string()), ("cosine", pa.float64()), ("whole", pa.bool_())])
    needed = templates.rare(least)
    hint = re.compile("|".join(sorted(map(re.escape, needed), key=len, reverse=True)) or r"(?!)")

    def units(text: str):
        hinted, long = hint.search(text.lower()) is not None, templates.may_be_long(text)
        if not hinted and not long:
            return
        yield text
        for paragraph in re.split(r"\n[ \t\r]*\n", text):
            lines = paragraph.split("\n")
            if len(lines) > 1 and paragraph != text:
                yield paragraph
            yield from (line for line in lines if line != text and ((hinted and hint.search(line.lower())) or (long and templates.may_be_long(line))))

    def run(batches):
        for batch in batches:
            out = []
            for path, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text, top, name, whole = value.as_py(), 0.0, None, False
                for unit in units(text):
                    cosine, licence = templates.best(unit)
                    if cosine >= least and cosine > top:
                        top, name = cosine, licence
                    whole = whole or (unit is text and cosine >= least)
                out.append((path, name, top if name else None, whole))
            yield [list(c) for c in zip(*out)] or [[], [], [], []]

    return files.select("path", body("text").alias("text")).mapInArrow(arrow_rows(run, schema), "path string, licence string, cosine double, whole boolean")


def parent(path: Column) -> Column:
    """Directory of a path; '' is the top."""
    return F.regexp_replace(F.regexp_replace(path, r"^/+", ""), r"/*[^/]*$", "")


def scan(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = 0.6, long: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per file: path, licence, cosine, origin ('own', 'inherited' or null), licence_path.

    Every line, paragraph and whole text counts, wherever it stands; ``long`` templates are the usual
    headers and licence files unless others are given. A file whose name is that of a
    licence file, or whose whole text is like a template, speaks for its directory; of several the one
    of the highest cosine, then of the smallest path. Files without a licence of their own inherit from
    the nearest directory above. Null texts are empty; a null path has no directory and inherits
    nothing. Repeated rows are treated alike; only path and text are read. An empty table gives no rows.

    Inheritance is found once per directory: directories meet those above them by equal paths. Files
    meet their directory's answer in ``SALTS`` parts by a hash of their path, so a directory with a
    third of all files, or all the files that need no answer, is no single task's.
    """
    files = files.select("path", "text")
    long = long_templates() if long is None else long
    vocabulary = {t for group in (templates, long) for versions in group.values() for text in versions for t in terms(text)}
    total, frequency = term_frequencies(files, vocabulary)
    own = stored(own_licences(files, Templates(templates, total, frequency, long, least), least), "licences")
    speaks = own.filter("licence IS NOT NULL AND path IS NOT NULL").filter(F.col("whole") | F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE))
    rank = F.struct((-F.col("cosine")).alias("c"), F.col("path").alias("p"), "licence")
    holders = speaks.groupBy(parent(F.col("path")).alias("_holder")).agg(F.min(rank).alias("_law"))
    bare = own.filter("licence IS NULL AND path IS NOT NULL").select(parent(F.col("path")).alias("_dir")).distinct()
    parts = F.filter(F.split("_dir", "/"), lambda x: x != "")
    depths = F.sequence(F.lit(0), F.size(parts))
    above = bare.withColumn("_depth", F.explode(depths)).withColumn("_holder", F.array_join(F.slice(parts, 1, F.col("_depth")), "/"))
    # paths with doubled slashes meet as well
    holders = holders.withColumn("_holder", F.array_join(F.filter(F.split("_holder", "/"), lambda x: x != ""), "/")).groupBy("_holder").agg(F.min("_law").alias("_law"))
    nearest = above.join(holders, "_holder").groupBy("_dir").agg(F.max_by("_law", "_depth").alias("_law"))
    dealt = own.withColumn("_of", F.when(F.col("licence").isNull(), parent(F.col("path")))).withColumn("_part", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    nearest = nearest.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    result = dealt.join(nearest, (F.col("_of") == F.col("_dir")) & (F.col("_part") == F.col("_salt")), "left")
    return result.select(
        "path",
        F.coalesce("licence", "_law.licence").alias("licence"),
        F.coalesce("cosine", -F.col("_law.c")).alias("cosine"),
        F.when(F.col("licence").isNotNull(), "own").when(F.col("_law").isNotNull(), "inherited").alias("origin"),
        F.coalesce(F.when(F.col("licence").isNotNull(), F.col("path")), F.col("_law.p")).alias("licence_path"),
    )
