"""Licence scan: TF-IDF cosine of notices and licence files to templates, then directory inheritance.

A file's lines, runs of neighbouring lines that look like a notice, and every stretch of words as long as a template are
compared with the templates as sparse TF-IDF vectors; document frequencies are counted over all files. Of
overlapping notices the one with the highest cosine counts. Files without
a notice of their own inherit from the licence file in the nearest ancestor directory, found by
joining every ancestor path with the directories that have one.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunesmith.llm.features import WordHasher, segments, text_groups
from tunesmith.session import materialize

# Short notices that licences prescribe or that are in common use.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version",
    ],
    "GPL-2.0": [
        "Licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License version 2 as published by the Free Software Foundation",
    ],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "All-rights-reserved": ["All rights reserved"],
}

#: Least cosine of a line or run of lines; of a stretch of words anywhere; and of one of under five words, which common phrases
#: ("all the rights") come near to.
COSINE, STRETCH, SHORT_STRETCH = 0.6, 0.75, 0.9
#: A file is a licence file by its base name, or if notices hold at least this share of its words.
FILE_SHARE = 0.5
FILE_NAME = r"(?i)^(licen[cs]e|copying|copyright|notice|unlicense)([-_.].*)?$"

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")


def tokens(text: str) -> list[bytes]:
    return _TOKEN.findall(re.sub(rb"[A-Z]", lambda m: m.group().lower(), text.encode("utf-8")))


class Templates:
    """TF-IDF vectors of the templates, and the words of whole texts matched against their vocabulary."""

    def __init__(self, templates: dict[str, list[str]]) -> None:
        self.names = [name for name, notices in templates.items() for _ in notices]
        self.counts = [Counter(tokens(t)) for notices in templates.values() for t in notices]
        self.terms = sorted(set().union(*self.counts))
        self.hasher = WordHasher()
        data = np.frombuffer(b" ".join(self.terms), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in self.terms]) - 1
        h = self.hasher.ranges(data, np.concatenate(([0], ends[:-1] + 1)), ends)
        self.order = np.argsort(h)
        self.hashes = h[self.order]

    def weigh(self, files: int, df: dict[int, int]) -> None:
        """Set idf = ln((files + 1) / (files with the term + 1)) + 1; a term of no template counts as in no file."""
        self.idf = np.array([np.log((files + 1) / (df.get(i, 0) + 1)) + 1 for i in range(len(self.terms))])
        self.rest = np.log(files + 1) + 1
        position = {t: i for i, t in enumerate(self.terms)}
        self.vectors = np.zeros((len(self.names), len(self.terms)))
        for k, c in enumerate(self.counts):
            for t, n in c.items():
                self.vectors[k, position[t]] = n * self.idf[position[t]]
        self.vectors /= np.linalg.norm(self.vectors, axis=1, keepdims=True)
        # what each word adds to a stretch's dot product with a template
        self.gains = self.vectors * self.idf
        self.sizes = [sum(c.values()) for c in self.counts]

    def words(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(term or -1, hash, line number, part number) of every word; lines count through all parts."""
        encoded = [p.encode("utf-8") for p in parts]
        data = _LOWER[np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)]
        word = _WORD[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word)).astype(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        h = self.hasher.ranges(data, starts, ends)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        term = np.where(self.hashes[at] == h, self.order[at], -1)
        line = np.concatenate(([0], np.cumsum(data == 10)))[starts]
        part = np.searchsorted(np.cumsum([len(e) + 1 for e in encoded]), starts, side="right")
        return term, h, line, part

    def _lines(self, term, line, part, least: float) -> list[tuple[int, int]]:
        """(first, last) words of the lines, and runs of neighbouring lines, that may reach ``least``."""
        n = int(line[-1]) + 1
        known = term >= 0
        # a line's terms outside the templates add to its norm alone: at best (each word once) it reaches this cosine
        inside = np.bincount(line[known], self.idf[term[known]] ** 2, minlength=n)
        outside = np.bincount(line[~known], minlength=n) * self.rest ** 2
        repeated = np.bincount(line, minlength=n).clip(1)  # a term counted r times weighs at most r-fold
        bound = inside * repeated / np.maximum(inside * repeated + outside, 1e-12)
        likely = np.flatnonzero((bound >= least ** 2 / 4) & (inside > 0))
        first, last = np.searchsorted(line, likely, side="left"), np.searchsorted(line, likely, side="right")
        owner = part[first]
        found = list(zip(first.tolist(), last.tolist()))
        breaks = np.flatnonzero((np.diff(likely) != 1) | (np.diff(owner) != 0)) + 1
        for run in np.split(np.arange(len(likely)), breaks):
            if len(run) > 1:
                found.append((int(first[run[0]]), int(last[run[-1]])))
        return found

    def _stretches(self, term, part, least: float) -> list[tuple[int, int, float]]:
        """(first, last, least cosine) of all stretches as long as a template whose cosine with it may reach their bar, by words.

        The dot product is a sum over words; the norm is at least that of as many different words.
        """
        known = term >= 0
        at = np.where(known, term, 0)
        norms = np.concatenate(([0.0], np.cumsum(np.where(known, self.idf[at], self.rest) ** 2)))
        found = []
        for k, size in enumerate(self.sizes):
            if size > len(term):
                continue
            gains = np.concatenate(([0.0], np.cumsum(np.where(known, self.gains[k][at], 0.0))))
            dot, norm = gains[size:] - gains[:-size], norms[size:] - norms[:-size]
            bar = max(least, STRETCH if size >= 5 else SHORT_STRETCH)
            starts = np.flatnonzero((dot * dot >= bar ** 2 * norm * (1 - 1e-9)) & (part[size - 1:] == part[:len(part) - size + 1]))
            found += [(i, i + size, bar) for i in starts.tolist()]
        return found

    def notices(self, parts: list[str], least: float) -> list[tuple[int, int, float, int, int]]:
        """(part, template, cosine, line, words) of each notice of at least ``least``, by place. Of notices that overlap the
        one with the highest cosine stays; between equal ones the earlier template, then the earlier place."""
        term, h, line, part = self.words(parts)
        if not (term >= 0).any():
            return []
        bars: dict[tuple[int, int], float] = {(a, b): bar for a, b, bar in sorted(self._stretches(term, part, least), key=lambda x: -x[2])}
        bars.update(dict.fromkeys(self._lines(term, line, part, least), least))
        out = []
        for (a, b), bar in bars.items():
            t, hh = term[a:b], h[a:b]
            vector = np.bincount(t[t >= 0], minlength=len(self.terms)) * self.idf
            others = np.unique(hh[t < 0], return_counts=True)[1] * self.rest
            cosine = self.vectors @ vector / np.sqrt(vector @ vector + others @ others)
            k = int(np.argmax(cosine))
            if cosine[k] >= bar:
                out.append((-round(float(cosine[k]), 12), k, a, b, float(cosine[k])))
        taken, kept = np.zeros(len(term), bool), []
        for _, k, a, b, cosine in sorted(out):
            if not taken[a:b].any():
                taken[a:b] = True
                kept.append((a, int(part[a]), k, cosine, int(line[a]), b - a))
        return [x[1:] for x in sorted(kept)]


def own_notices(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = COSINE) -> DataFrame:
    """(id, path, license, cosine, line, share, notices) of every file: its best notice (null license: none), and all of them.

    ``files`` has id, path and text. ``share`` is the share of the file's words that stand in notices; ``notices`` has
    (license, cosine, line) of each, by place.
    """
    spark = files.sparkSession
    shared = spark.sparkContext.broadcast(templates)

    def frequencies(batches):
        t = Templates(shared.value)
        seen, n = Counter(), 0
        for batch in batches:
            for _, texts in text_groups(batch.column(0)):
                n += len(texts)
                found = set()
                for owner, parts in segments(texts):
                    term, _, _, part = t.words(parts)
                    row = np.array(owner)[part[term >= 0]]
                    found.update(np.unique(row * len(t.terms) + term[term >= 0]).tolist())
                seen.update(x % len(t.terms) for x in found)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *seen], pa.int32()), pa.array([n, *seen.values()], pa.int64())], names=["term", "n"])

    df = {r.term: r.n for r in files.select(F.col("text").cast("string")).mapInArrow(frequencies, "term int, n long")
          .groupBy("term").agg(F.sum("n").alias("n")).collect()}  # one row per term of the templates
    total = df.pop(-1, 0)

    def scan(batches):
        t = Templates(shared.value)
        t.weigh(total, df)
        for batch in batches:
            for at, texts in text_groups(batch.column(2)):
                found: list[list[tuple]] = [[] for _ in texts]
                held, words, lines = Counter(), Counter(), Counter()
                for owner, parts in segments(texts):
                    of = t.words(parts)[3]
                    for p, n in zip(*np.unique(of, return_counts=True)):
                        words[owner[p]] += int(n)
                    before = np.concatenate(([0], np.cumsum([p.count("\n") + 1 for p in parts])))
                    for p, k, cosine, line, n in t.notices(parts, least):
                        i = owner[p]
                        found[i].append((k, cosine, lines[i] + line - int(before[p])))
                        held[i] += n
                    for p, i in enumerate(owner):
                        lines[i] += parts[p].count("\n")
                best = [min(x, key=lambda r: (-round(r[1], 12), r[0], r[2]), default=None) for x in found]
                flat = [x for xs in found for x in xs]
                parts_of = [pa.array([t.names[k] for k, _, _ in flat], pa.string()), pa.array([c for _, c, _ in flat], pa.float64()),
                            pa.array([n for _, _, n in flat], pa.int32())]
                listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in found]).astype(np.int32)),
                                                  pa.StructArray.from_arrays(parts_of, ["license", "cosine", "line"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)),
                     pa.array([r and t.names[r[0]] for r in best], pa.string()), pa.array([r and r[1] for r in best], pa.float64()),
                     pa.array([r and r[2] for r in best], pa.int32()),
                     pa.array([min(1.0, held[i] / max(words[i], 1)) for i in range(len(texts))], pa.float64()), listed],
                    names=["id", "path", "license", "cosine", "line", "share", "notices"])

    notice = T.StructType([T.StructField("license", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("line", T.IntegerType())])
    schema = T.StructType([
        T.StructField("id", files.schema["id"].dataType), T.StructField("path", T.StringType()), T.StructField("license", T.StringType()),
        T.StructField("cosine", T.DoubleType()), T.StructField("line", T.IntegerType()), T.StructField("share", T.DoubleType()),
        T.StructField("notices", T.ArrayType(notice))])
    return files.select("id", "path", F.col("text").cast("string").alias("text")).mapInArrow(scan, schema)


def directory(path: Column) -> Column:
    """The directory of a path; '' for a path without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """Array of (depth, dir) of all ancestor directories, the root '' at depth 0."""
    parts = F.split(directory(path), "/")
    n = F.when(directory(path) == "", 0).otherwise(F.size(parts))
    return F.transform(F.sequence(F.lit(0), n), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("dir")))


def scan(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = COSINE, file_share: float = FILE_SHARE) -> DataFrame:
    """One row per file: id, path, license, cosine, line, origin, licence_path, levels_up, notices.

    ``files`` has id, path and text. origin is 'own' (a notice in the file), 'inherited' (the licence
    file of the nearest ancestor directory, ``levels_up`` directories above the file's own) or 'none'.
    A directory with several licence files has the one with the highest cosine, then smallest path; a licence
    file needs a recognised notice. Null and empty texts have no notice; a null path neither gives
    nor inherits a licence; files that repeat stay rows; an empty table gives no rows; other columns are
    not read. Between equal cosines the earlier template, then the earlier line counts. Very long texts are read
    whole, in pieces of about a million characters; a notice that is cut between two pieces may be missed.
    ``notices`` lists every notice of the file's own (license, cosine, line), by place.
    """
    found = materialize(own_notices(files, templates, least), "notices")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    is_file = F.col("license").isNotNull() & F.col("path").isNotNull() & (name.rlike(FILE_NAME) | (F.col("share") >= file_share))
    dirs = found.where(is_file).groupBy(directory(F.col("path")).alias("dir")) \
        .agg(F.min(F.struct((-F.col("cosine")).alias("low"), "path", "license")).alias("best"))
    dirs = materialize(dirs.select("dir", F.col("best.license").alias("dir_license"), F.col("best.path").alias("licence_path"),
                                   (-F.col("best.low")).alias("dir_cosine")), "licence-dirs")
    # the directories that hold files without a notice, each once, against those with a licence file
    bare = found.where("license is null and path is not null").select(directory(F.col("path")).alias("of")).distinct()
    steps = bare.select("of", F.explode(ancestors(F.concat("of", F.lit("/x")))).alias("up")).select("of", "up.depth", "up.dir") \
        .distinct()
    nearest = steps.join(dirs, "dir").groupBy("of").agg(
        F.max(F.struct("depth", "dir_license", "licence_path", "dir_cosine")).alias("near"))
    nearest = materialize(nearest, "nearest")
    out = found.withColumn("of", F.when(F.col("license").isNull(), directory(F.col("path")))).join(nearest, "of", "left")
    own, near = F.col("license").isNotNull(), F.col("near.dir_license").isNotNull()
    depth = F.when(F.col("of") == "", 0).otherwise(F.size(F.split("of", "/")))
    return out.select(
        "id", "path", F.coalesce("license", "near.dir_license").alias("license"), F.coalesce("cosine", "near.dir_cosine").alias("cosine"),
        "line", F.when(own, "own").when(near, "inherited").otherwise("none").alias("origin"),
        F.when(own, F.col("path")).otherwise(F.col("near.licence_path")).alias("licence_path"),
        F.when(own, 0).when(near, depth - F.col("near.depth")).alias("levels_up"), "notices")
