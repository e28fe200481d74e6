"""Licence detection by sparse TF-IDF cosine to templates, with inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_values, chunks, shared_dir, written

#: Notices by which works name their licence, by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.",),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}
#: Short titles and SPDX forms; they count where they stand word for word, as one word less would name another licence or none.
TITLES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 license", "licensed under Apache 2.0", "SPDX-License-Identifier: Apache-2.0"),
    "BSD-2-Clause": ("BSD 2-Clause", "2-Clause BSD", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause", "3-Clause BSD", "BSD-3-Clause"),
    "BSL-1.0": ("Boost Software License", "BSL-1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    "CC0-1.0": ("CC0 1.0",),
    "GPL-2.0": ("GPL-2.0", "GPLv2", "GPL version 2", "GNU General Public License v2", "GNU General Public License v2.0", "GNU General Public License version 2"),
    "GPL-3.0": ("GPL-3.0", "GPLv3", "GPL version 3", "GNU General Public License v3", "GNU General Public License v3.0", "GNU General Public License version 3"),
    "ISC": ("ISC License", "SPDX-License-Identifier: ISC"),
    "LGPL-2.1": ("LGPL-2.1", "LGPLv2.1", "GNU Lesser General Public License v2.1", "GNU Lesser General Public License version 2.1"),
    "LGPL-3.0": ("LGPL-3.0", "LGPLv3", "LGPL version 3", "GNU Lesser General Public License v3", "GNU Lesser General Public License v3.0", "GNU Lesser General Public License version 3"),
    "MIT": ("MIT License", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("MPL 2.0", "MPL-2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"),
    "Unlicense": ("The Unlicense", "SPDX-License-Identifier: Unlicense"),
}
#: Whole licence texts, one a file, named by SPDX identifier.
TEXTS = Path(__file__).parent / "licenses"
#: Words that a smaller share of the documents has weigh as a word that none has. So at most 1 / RARE times the words of a mean document are sent to tasks.
RARE = 1 / 1000
#: Distinct words that a counting task holds before it hands them on.
FLUSH_TERMS = 500_000
#: Least cosine of a notice.
THRESHOLD = 0.7
#: A file is its directory's licence file if its name says so or notices make up this share of its words.
FILE_SHARE = 0.2
_TERM = re.compile(r"[a-z0-9]+")
_FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)(\.[a-z]+)?$"


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def full_texts() -> dict[str, tuple[str, ...]]:
    return {f.stem: (f.read_text(),) for f in sorted(TEXTS.glob("*.txt"))}


def both(notices: dict[str, tuple[str, ...]], texts: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    return {name: notices.get(name, ()) + texts.get(name, ()) for name in sorted({*notices, *texts})}


class Scanner:
    """Template vectors, and the weight of each term: ln((1 + documents) / (1 + documents that have it)) + 1."""

    def __init__(self, templates: dict[str, tuple[str, ...]], documents: int, often: dict[str, int], titles: dict[str, tuple[str, ...]] | None = None) -> None:
        self.other = math.log(1 + documents) + 1
        self.vocabulary = frozenset(t for texts in templates.values() for x in texts for t in terms(x))
        self.weight = {t: math.log((1 + documents) / (1 + often.get(t, 0))) + 1 for t in self.vocabulary.union(often)}
        self.vectors: list[tuple[str, float]] = []
        self.postings: dict[str, list[tuple[int, float]]] = {}
        self.sizes: list[int] = []
        self.titles = sorted({(name, tuple(terms(x))) for name, texts in (titles or {}).items() for x in texts})
        self.title_terms = frozenset(t for _, title in self.titles for t in title)
        for name, texts in sorted(templates.items()):
            for text in texts:
                own = {t: n * self.weight[t] for t, n in Counter(terms(text)).items()}
                length = math.sqrt(sum(w * w for w in own.values()))
                for t, w in own.items():
                    self.postings.setdefault(t, []).append((len(self.vectors), w / length))
                self.vectors.append((name, length))
                self.sizes.append(len(terms(text)))

    def best(self, words: list[str], floor: float = 0.0) -> tuple[float, int]:
        """Highest cosine and its template; of equals the first by name. Nothing (-1) is given for a cosine that cannot reach ``floor``, by the share of its length that template terms have."""
        square, own = 0.0, []
        for t, n in Counter(words).items():
            w = n * self.weight.get(t, self.other)
            square += w * w
            if t in self.postings:
                own.append((t, w))
        if not own or sum(w * w for _, w in own) < floor * floor * square * (1 - 1e-9):
            return 0.0, -1
        dots = [0.0] * len(self.vectors)
        for t, w in own:
            for i, part in self.postings[t]:
                dots[i] += w * part
        top = max(dots)
        return top / math.sqrt(square), dots.index(top)

    def windows(self, words: list[str], i: int, threshold: float) -> list[tuple[float, int]]:
        """Cosine and start of each run of as many words as template ``i`` has that comes up to ``threshold``."""
        n, name = self.sizes[i], self.vectors[i][0]
        own = {t: w for t, list_ in self.postings.items() for k, w in list_ if k == i}
        counts: Counter[str] = Counter()
        dot = square = 0.0
        found = []
        for j, t in enumerate(words):
            w = self.weight.get(t, self.other)
            square += w * w * (2 * counts[t] + 1)
            dot += w * own.get(t, 0.0)
            counts[t] += 1
            if j >= n:
                t = words[j - n]
                w = self.weight.get(t, self.other)
                counts[t] -= 1
                square -= w * w * (2 * counts[t] + 1)
                dot -= w * own.get(t, 0.0)
                if not counts[t]:
                    del counts[t]
            if j >= n - 1 and dot * dot >= (threshold * threshold - 1e-9) * square and dot > 0:
                cosine, best = self.best(words[j - n + 1 : j + 1])  # without the sums' rounding
                if self.vectors[best][0] == name and cosine >= threshold:
                    found.append((cosine, j - n + 1))
        return found

    def within(self, words: list[str], hope: set[str], threshold: float) -> list[tuple[float, str, int, int]]:
        """Notices that other words of a paragraph surround: cosine, licence, start, end.

        No window's cosine is above the share of a template's length that the
        paragraph's words have, so templates below that are passed over.
        """
        shares = [0.0] * len(self.vectors)
        for t in hope:
            for i, w in self.postings.get(t, ()):
                shares[i] += w * w
        found = []
        for i, share in enumerate(shares):
            if share >= threshold * threshold - 1e-9 and len(words) > self.sizes[i]:
                found += [(c, self.vectors[i][0], a, a + self.sizes[i]) for c, a in self.windows(words, i, threshold)]
        own = self.title_terms.intersection(words)
        for name, title in self.titles:
            if own.issuperset(title):
                n = len(title)
                found += [(1.0, name, a, a + n) for a, t in enumerate(words) if t == title[0] and tuple(words[a : a + n]) == title]
        return found

    def scan(self, text: str, threshold: float) -> tuple[float, str, float]:
        """Best notice of the whole text (every line, every paragraph, windows in them, all of it), and the share of words in notices.

        Where the whole is a licence, that is, near a template of half its words
        or more, it is this licence, whatever others it names. What cannot reach
        both the threshold and the best so far is not multiplied out.
        """
        lines = [terms(x) for x in text.split("\n")]
        every = [t for x in lines for t in x]
        found: list[tuple[float, str]] = [(0.0, "")]
        most, inside, nearest = 0.0, 0, -1

        def judged(words: list[str]) -> float:
            nonlocal most, nearest
            cosine, nearest = self.best(words, min(most, threshold))
            found.append((cosine, self.vectors[nearest][0] if nearest >= 0 else ""))
            most = max(most, cosine)
            return cosine

        blocks, block, taken = [], [], []
        for line in [*lines, []]:
            if line:
                block.append(line)
                taken += [judged(line) >= threshold] * len(line)
            elif block:
                own = [t for x in block for t in x]
                blocks.append((own, len(block)))
                for cosine, name, first, last in sorted(self.within(own, self.vocabulary.intersection(own), threshold), key=lambda x: (-x[0], x[2] - x[3], x[1])):
                    found.append((cosine, name))
                    most = max(most, cosine)
                    if not any(taken[first:last]):
                        taken[first:last] = [True] * (last - first)
                inside += sum(taken)
                block, taken = [], []
        if len(blocks) == 1:  # one paragraph is the whole
            blocks = [(every, blocks[0][1])]
        else:
            blocks.append((every, len(blocks)))
        for own, n in blocks:  # a single line has been judged
            if n > 1 and judged(own) >= threshold:
                inside = max(inside, len(own))
                if own is every and 2 * self.sizes[nearest] >= len(every):
                    found = found[-1:]
        cosine, name = max(found, key=lambda x: (x[0], [-ord(c) for c in x[1]]))
        return cosine, name, inside / max(1, len(every))


def _term_counts(texts: DataFrame, vocabulary: frozenset[str], rare: float = RARE) -> tuple[int, dict[str, int]]:
    """Documents, and in how many of them each template term, and each other that a share ``rare`` of them has, stands: over all texts, summed in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(list(often), pa.string()), pa.array([t in vocabulary for t in often], pa.bool_()), pa.array(list(often.values()), pa.int64())], names=["term", "of_template", "n"])
            often.clear()
            return made

        for batch in batches:
            for text in batch.column(0).to_pylist():
                often.update(set(terms(text or "")))
            if len(often) > FLUSH_TERMS:
                yield out()
        yield out()

    documents = texts.count()
    rows = texts.mapInArrow(run, "term string, of_template boolean, n long").groupBy("term", "of_template").agg(F.sum("n").alias("n"))
    kept = rows.where((F.col("n") >= rare * documents) | F.col("of_template"))
    return documents, {r.term: r.n for r in kept.collect()}


def ancestors(directory: Column) -> Column:
    """A directory and all above it, nearest first; the root is the empty path."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))


def license_scan(
    files: DataFrame, *, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD, file_share: float = FILE_SHARE, titles: dict[str, tuple[str, ...]] = TITLES
) -> DataFrame:
    """From doc_id, path, text: doc_id, path, own_license, cosine, license, inherited_from, distance.

    Each line, each paragraph, each run of a template's number of words in a
    paragraph and the whole of a text is compared with the templates (notices
    and whole licence texts, if none are given); titles count word for word
    (cosine 1); idf is counted over all texts. A file without a notice of its
    own gets that of the licence file in the nearest directory at or above its
    own: distinct directories are joined with their ancestors that have one,
    and files with their directory's answer.

    Defined cases: null and empty texts have no notice; a null path has no
    directory and inherits nothing; of several licence files in a directory
    the highest cosine counts, then licence name, then path; equal rows are
    answered each.
    """
    spark = files.sparkSession
    where = shared_dir(spark)
    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), "path", "text")
    templates = both(TEMPLATES, full_texts()) if templates is None else templates
    vocabulary = frozenset(t for texts in templates.values() for x in texts for t in terms(x))
    shared = spark.sparkContext.broadcast(Scanner(templates, *_term_counts(rows.select("text"), vocabulary), titles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            _, offsets = byte_values(batch.column(2))
            for first, last in chunks(offsets):
                cosine, name, share = zip(*[scanner.scan(t or "", threshold) for t in batch.column(2).slice(first, last - first).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array(name, pa.string()), pa.array(cosine, pa.float64()), pa.array(share, pa.float64())],
                    names=["doc_id", "path", "name", "cosine", "share"],
                )

    scanned = written(rows.mapInArrow(run, "doc_id long, path string, name string, cosine double, share double"), where)
    clean = F.concat_ws("/", F.filter(F.split("path", "/"), lambda x: x != ""))
    placed = scanned.withColumn("own_license", F.when(F.col("cosine") >= threshold, F.col("name"))).withColumn(
        "directory", F.when(F.col("path").isNotNull(), F.regexp_replace(clean, "(^|/)[^/]*$", "")))
    is_file = F.col("own_license").isNotNull() & (F.col("path").rlike(_FILE_NAME) | (F.col("share") >= file_share))
    best = F.min(F.struct((-F.col("cosine")).alias("c"), F.col("own_license").alias("license"), F.col("path").alias("path")))
    licensed = placed.where(is_file & F.col("directory").isNotNull()).groupBy(F.col("directory").alias("above")).agg(best.alias("b")).select("above", F.col("b.license").alias("given"))
    directories = placed.where(F.col("directory").isNotNull()).select("directory").distinct()
    steps = directories.select("directory", F.posexplode(ancestors(F.col("directory"))).alias("distance", "above"))
    nearest = written(steps.join(licensed, "above").groupBy("directory").agg(F.min(F.struct("distance", "above", "given")).alias("near")), f"{where}-nearest")
    joined = placed.join(nearest, "directory", "left")  # a table of its own: a hot directory's files may be split
    inherits = F.col("own_license").isNull()
    return joined.select(
        "doc_id", "path", "own_license", "cosine", F.coalesce("own_license", "near.given").alias("license"),
        F.when(inherits, F.col("near.above")).alias("inherited_from"), F.when(inherits, F.col("near.distance")).alias("distance"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source / language / doc_id."""
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
