"""License scans: sparse TF-IDF cosine of passages to templates, then inheritance from the nearest ancestor directory.

The vocabulary is that of the templates; its document frequencies are counted over all texts. A text's own
licence is that of its most similar passage (line or sentence; for licence files the whole text too), if the
cosine reaches THRESHOLD. A file without one inherits from the nearest directory above it with a licence
file; directories are resolved first, by an equi-join of all their prefixes with the licensed ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keeping, splitting_join, staged, text_chunks

THRESHOLD = 0.7
#: A licence file is compared as a whole too.
LICENSE_FILE = r"(?i)(^|/)(LICEN[CS]E|COPYING)(\.(txt|md))?$"
#: What headers and licence files say, by SPDX name.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "The MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
RESULTS = ("own_license", "own_score", "license", "licensed_by", "levels_up", "dir", "near")
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
_BREAK = re.compile(r"\n+|(?<=[.!?])\s+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Matcher:
    """TF-IDF vectors of the templates. Words outside their vocabulary weigh as much as a word in no document."""

    def __init__(self, templates: dict[str, list[str]], n: int, df: dict[str, int]):
        self.other = math.log(1 + n) + 1
        self.idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for texts in templates.values() for t in texts for w in words(t)}
        self.vectors = [(name, self.unit(Counter(words(t)))) for name, texts in templates.items() for t in texts]
        # A passage without any strong word stays below the threshold: what it can share with a template is too short.
        strong: set[str] = set()
        for w in sorted(self.idf, key=lambda w: (-self.idf[w], w)):
            if all(sum(x * x for v, x in vector.items() if v not in strong) < (THRESHOLD - 1e-9) ** 2 for _, vector in self.vectors):
                break
            strong.add(w)
        self.strong = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(map(re.escape, strong), key=len, reverse=True)) + r")(?![^\W_])", re.IGNORECASE)

    def unit(self, counts: Counter) -> dict[str, float]:
        vector = {w: n * self.idf.get(w, self.other) for w, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in vector.values())) or 1.0
        return {w: x / norm for w, x in vector.items()}

    def best(self, text: str, is_file: bool) -> tuple[str | None, float]:
        """Name and cosine of the best template, ties to the first; (None, 0) below the threshold."""
        top, at = (None, 0.0), 0
        if not self.strong.search(text):
            return top
        passages = [text] if is_file else []
        for passage in _BREAK.split(text):
            if self.strong.search(passage):
                passages.append(passage)
        for passage in passages:
            vector = self.unit(Counter(words(passage)))
            for name, template in self.vectors:
                at = sum(x * vector.get(w, 0.0) for w, x in template.items())
                if at >= THRESHOLD and at > top[1] + 1e-12:
                    top = (name, at)
        return top


def frequencies(files: DataFrame, templates: dict[str, list[str]]) -> tuple[int, dict[str, int]]:
    """The number of texts, and in how many of them each word of the templates stands."""
    vocabulary = {w for texts in templates.values() for t in texts for w in words(t)}

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for part in text_chunks(batches):
            for text in part.column("text").to_pylist():
                found[""] += 1
                found.update(vocabulary.intersection(words(text or "")))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    got = {r.word: r.n for r in files.select(F.col("text").cast("string").alias("text")).mapInArrow(rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return got.pop("", 0), got


def own_licenses(files: DataFrame, *keep: Column, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """The columns `keep`, path, own_license and own_score of every file (columns path, text). Null texts have no licence; a null path is no licence file.

    A kept column with the name of a result gets an underscore after it.
    """
    templates = templates or TEMPLATES
    matcher = Matcher(templates, *frequencies(files, templates))
    chosen, kept = keeping(files, keep, {"path": F.col("path").cast("string"), "__text": F.col("text").cast("string")}, RESULTS)
    kept, is_file = [*kept, "path"], re.compile(LICENSE_FILE)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "__text"):
            got = [matcher.best(t or "", bool(is_file.search(p or ""))) for p, t in zip(part.column("path").to_pylist(), part.column("__text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), pa.array([n for n, _ in got], pa.string()), pa.array([round(s, 6) for _, s in got])], [*kept, "own_license", "own_score"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(rows, f"{shape}, own_license string, own_score double")


def inherit(found: DataFrame) -> DataFrame:
    """Adds license, licensed_by (own, or the directory that it comes from) and levels_up (0: own) to own_licenses' rows.

    The directory of a path is what stands before its last slash ('' without one). Of several licence files in a
    directory the best score counts, ties to the lesser name. Null paths inherit nothing.
    """
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    found = found.withColumn("dir", folder)
    licensed = found.where(F.col("own_license").isNotNull() & F.col("path").rlike(LICENSE_FILE)).groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "own_license")).alias("l")).select(F.col("dir").alias("above"), F.col("l.own_license").alias("given"))
    parts = F.split("dir", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")))
    dirs = found.where(F.col("path").isNotNull()).select("dir").distinct().select("dir", F.size(parts).alias("n"), F.explode(prefixes).alias("p")).select("dir", "n", "p.depth", "p.above")
    near = splitting_join(dirs, licensed, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "given", "n")).alias("near"))
    own = F.col("own_license").isNotNull()
    return (
        splitting_join(found, near, "dir", how="left")
        .withColumn("license", F.coalesce("own_license", "near.given"))
        .withColumn("licensed_by", F.when(own, F.lit("own")).otherwise(F.col("near.above")))
        .withColumn("levels_up", F.when(own, 0).otherwise(F.col("near.n") - F.col("near.depth") + 1))
        .drop("dir", "near")
    )


def scan_files(files: DataFrame, *keep: Column, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """own_licenses and inherit in one: every file with the licence that holds for it."""
    return inherit(staged(own_licenses(files, *keep, templates=templates)))


def scan_documents(docs: DataFrame) -> DataFrame:
    """The documents as files: source/(doc_id div 512)/(doc_id div 16)/..., where each 16th and, one level up, each 512th is the directory's licence file."""
    i = F.col("doc_id").cast("long")
    number = lambda x: F.coalesce(x.cast("string"), F.lit("none"))
    top = F.concat_ws("/", number(F.col("source")), number(F.floor(i / 512)))
    path = F.when(i % 512 == 0, F.concat(top, F.lit("/LICENSE"))).otherwise(F.concat(top, F.lit("/"), number(F.floor(i / 16)), F.lit("/"), F.when(i % 16 == 0, F.lit("LICENSE")).otherwise(F.concat(number(i), F.lit(".txt")))))
    return scan_files(docs.select(i.alias("doc_id"), path.alias("path"), "text"), F.col("doc_id"))
