"""License scans with DataFrame functions only.

Pieces of a text are compared to licence templates by the cosine of sparse TF-IDF vectors
(joins and sums over terms): the comment a text begins with, as one vector whatever follows
it, to headers and full licence texts; header blocks (adjoining lines with a licence word,
alone and with the lines next to them) to the headers by which licences are granted; whole
licence files to full licence texts; and besides sentences with a licence word to short
grants. A whole text is compared if it is a licence file's by its name, or if it speaks of
licence, copyright, warranty or liability (``LEGAL``), as every template of a header or text
does, and has no more words than twice the longest licence text. The texts are in ``licence_texts``, by licence. A file without a licence
of its own inherits that of the nearest ancestor directory with a licence file, by joining
the ancestor paths of its directory to the directories of such files. A file is a licence
file by its name, or if it is a text file of which LICENCE_PERCENT of the words or more are in
licence pieces: a short notice. Files learn what their directory inherits in SPREAD parts a directory, so one that
holds very many files is no hot key.

Document frequencies come from all pieces of a kind, for every term. Broadcast
are the templates' terms and weights only, whose number is fixed.

Rows are told apart by a digest of what is read of them, so ``files`` may be any DataFrame,
shuffled, sampled or joined anew each time it is read.

Defined cases: null and empty texts have no licence of their own but may inherit; ties go to
the first licence by name; repeated rows give repeated results, and count once in document
frequencies; a null path inherits nothing; a text of any length is cut into pieces in its row; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import let, materialise, n_words, read

#: Sentences by which well-known licences are granted.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Licensed under the ISC License."),
    ("EPL-2.0", "Licensed under the Eclipse Public License 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, public domain dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense."),
    ("Proprietary", "All rights reserved, proprietary and confidential license."),
)

_GNU = "{0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
_GNU_END = " {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details. You should have received a copy of the GNU {1}General Public License along with {2}. If not, see <https://www.gnu.org/licenses/>."
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
#: The notices that files carry at their head.
HEADERS = (
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE + ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    *[
        (license, _GNU.format(work, ":" if version == "3" else ";", kind, "," if version == "3" else ";", version) + end)
        for license, work, kind, version in (
            ("GPL-3.0", "This program", "", "3"), ("GPL-2.0", "This program", "", "2"), ("LGPL-3.0", "This library", "Lesser ", "3"),
            ("LGPL-2.1", "This library", "Lesser ", "2.1"), ("AGPL-3.0", "This program", "Affero ", "3"),
        )
        for end in ("", _GNU_END.format(work, kind, work.lower()))
    ],
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at https://opensource.org/licenses/MIT."),
    ("MIT", "This source code is licensed under the MIT license found in the LICENSE file in the root directory of this source tree."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
)

#: Kinds of pieces: sentences, header blocks without and with the lines next to them, whole files, leading comments.
SENTENCE, CUES, BLOCK, WHOLE, LEADING = range(5)
LEGAL = "(?i)licen[cs]|copyright|warrant|liabil"
#: A line of a comment, and the marks that open and close comments of several lines.
COMMENT_LINE = "^[ \\t]*(?:#|//|--|;|%|\\*|$)"
COMMENTS = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''"))

#: A sentence is looked at if it holds one of these.
CUE = "(?i)[lcsrp](?:icen[cs]|opyright|pdx|edistribut|ermission is hereby|ublic domain|roprietary|c0 1| by)|eative commons"
SENTENCE_END = "\\n|(?<=[.!?;])\\s+"
TERM = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"
MIN_COSINE = 0.6
#: Least cosine of whole files: long texts of one language share their common words.
MIN_WHOLE = 0.8
#: Names of licence files; names of text files, and the share of its words in licence pieces (percent) that makes one a licence file.
LICENCE_FILE = "(?i)(?:^|/)(?:licen[cs]e|copying|unlicense|notice)[^/]*$"
TEXT_FILE = "(?i)(?:(?:^|/)[^/.]*|\\.(?:txt|md|rst))$"
LICENCE_PERCENT = 33
#: Tasks that the files of one directory are dealt to.
SPREAD = 32


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def licence_texts() -> tuple[tuple[str, str], ...]:
    """(license, text) of the full licence texts; short ones are headers, too."""
    return tuple((p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")))


def templates(spark: SparkSession) -> DataFrame:
    """(kind, template, license, term, tf) of the templates."""
    texts = licence_texts()
    headers = (*HEADERS, *[t for t in texts if len(t[1]) < 2000])
    of_kind = ((SENTENCE, TEMPLATES), (CUES, headers), (BLOCK, headers), (WHOLE, texts), (LEADING, (*headers, *[t for t in texts if t not in headers])))
    listed = [(kind, i, name, text) for kind, some in of_kind for i, (name, text) in enumerate(some)]
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text")) for k, i, name, text in listed])
    rows = spark.range(1).select(F.inline(rows))
    return rows.select("kind", "template", "license", F.explode(terms(F.col("text"))).alias("term")).groupBy("kind", "template", "license", "term").agg(F.count(F.lit(1)).alias("tf"))


def _blocks(lines: Column, cues: Column, around: int) -> Column:
    """Runs of the lines that hold a licence word or are ``around`` from one that does."""
    near = lambda i: F.array_contains(F.slice(cues, F.greatest(i + 1 - around, F.lit(1)), F.least(i, F.lit(around)) + 1 + around), True)
    marked = F.array_join(F.transform(lines, lambda line, i: F.when(near(i), line).otherwise(F.lit("\0"))), "\n")
    return F.filter(F.split(marked, "\\x00"), lambda b: b.rlike(LEGAL))


def leading_comment(text: Column, lines: Column) -> Column:
    """The comment that a text begins with, after a first line with ``#!``; empty if there is none."""
    start = F.ltrim(F.regexp_replace(text, "\\A#![^\n]*\n", ""))
    other = F.array_position(F.transform(lines, lambda line: line.rlike(COMMENT_LINE)), False)
    out = F.when(other > 0, F.array_join(F.slice(lines, F.lit(1), (other - 1).cast("int")), "\n")).otherwise(text)
    for opens, closes in COMMENTS:
        inner = F.substring(start, F.lit(len(opens) + 1), F.length(start))
        out = F.when(start.startswith(opens), F.substring_index(inner, closes, 1)).otherwise(out)
    return out


def pieces(files: DataFrame) -> DataFrame:
    """(_row, kind, pos, piece) of what is compared of ``files`` (_row, path, text) with a licence word."""
    hit = files.filter(F.col("text").rlike(CUE))
    sentences = F.filter(F.split("text", SENTENCE_END), lambda s: s.rlike(CUE))
    named = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    longest = max(len(text.split()) for _, text in licence_texts())
    whole = named | F.col("text").rlike(LEGAL) & (n_words(F.col("text")) <= 2 * longest)
    none = F.array().cast("array<string>")

    def larger(lines: Column, cues: Column) -> Column:
        leading = F.filter(F.array(leading_comment(F.col("text"), lines)), lambda c: c.rlike(LEGAL))
        return F.array(_blocks(lines, cues, 0), _blocks(lines, cues, 1), F.when(whole, F.array("text")).otherwise(none), leading)

    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike("[A-Za-z0-9]"))
    found = let(lines, lambda ls: let(F.transform(ls, lambda line: line.rlike(CUE)), lambda cs: larger(ls, cs)))
    by_kind = hit.select("_row", F.posexplode(F.concat(F.array(sentences), found)).alias("kind", "_pieces"))
    return by_kind.select("_row", "kind", F.posexplode("_pieces").alias("pos", "piece"))


def own_licenses(files: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(_row, license, score, n_matches, license_words) of the files (_row, path, text) with a licence."""
    spark, key = files.sparkSession, ["_row", "kind", "pos"]
    found = materialise(pieces(files), "pieces")
    # The lines next to a block may be anything: their words are not words of a licence.
    of_licence = F.when(F.col("kind") == BLOCK, F.lit(0)).otherwise(n_words(F.col("piece")))
    words = materialise(found.select(*key, of_licence.alias("_words")).distinct(), "words")
    sizes = {r["kind"]: r["count"] for r in words.groupBy("kind").count().collect()}
    n = F.element_at(F.array(*[F.lit(sizes.get(k, 0) + 1.0) for k in (SENTENCE, CUES, BLOCK, WHOLE, LEADING)]), F.col("kind") + 1)
    tf = found.select(*key, F.explode(terms(F.col("piece"))).alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))
    weight = F.log(n / (F.coalesce("df", F.lit(0)) + 1)) + 1
    frequencies = materialise(tf.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    of_templates = templates(spark)
    vocabulary = of_templates.select("kind", "term").distinct()
    seen = F.broadcast(frequencies.join(F.broadcast(vocabulary), ["kind", "term"], "left_semi"))
    weighed = of_templates.join(seen, ["kind", "term"], "left").withColumn("_wt", F.col("tf") * weight)
    weighed = materialise(weighed, "weights")  # a row for each term of a template
    lengths = weighed.groupBy("kind", "template").agg(F.sqrt(F.sum(F.col("_wt") * F.col("_wt"))).alias("_nt"))
    posting = weighed.join(F.broadcast(lengths), ["kind", "template"]).select("kind", "term", "license", "template", (F.col("_wt") / F.col("_nt")).alias("_wt"))
    posting = materialise(posting, "postings")
    vectors = tf.join(frequencies.hint("merge"), ["kind", "term"]).select(*key, "term", (F.col("tf") * weight).alias("_w"))
    norms = vectors.groupBy(*key).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_n"))
    dots = vectors.join(F.broadcast(posting), ["kind", "term"]).groupBy(*key, "template", "license").agg(F.sum(F.col("_w") * F.col("_wt")).alias("_d"))
    least = F.when(F.col("kind") == WHOLE, F.lit(max(min_cosine, MIN_WHOLE))).otherwise(F.lit(min_cosine))
    scored = dots.join(norms, key).withColumn("score", F.round(F.col("_d") / F.col("_n"), 6)).filter(F.col("score") >= least)
    best = scored.groupBy(*key).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    best = best.join(words, key).groupBy("_row", "kind").agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("n"), F.sum("_words").alias("_words"))
    return best.groupBy("_row").agg(
        F.min("b").alias("b"), F.max("n").alias("n_matches"), F.max("_words").alias("license_words")
    ).select("_row", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), "n_matches", "license_words")


def ancestors(path: Column) -> Column:
    """Directories above a path, the root ('') first: array of (depth, dir)."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("dir")),
    )


def scan(files: DataFrame) -> DataFrame:
    """(doc_id, path, license, score, origin, n_matches) of each row of ``files`` (doc_id, path, text).

    ``origin`` is ``own``, ``inherited`` or ``none``; an inherited licence has the score that its licence file has.
    """
    read_of = [x for c in ("doc_id", "path", "text") for x in (F.col(c), F.col(c).isNull())]
    row = F.struct(F.xxhash64(*read_of).alias("a"), F.xxhash64(F.lit(1), *read_of).alias("b"))
    files = files.select("doc_id", "path", "text").withColumn("_row", row)
    own = own_licenses(files.select("_row", "path", "text"))
    listed = files.select("_row", "doc_id", "path", n_words(F.col("text")).alias("_size"))
    listed = materialise(listed.join(own, "_row", "left"), "licensed")
    is_file = F.col("path").rlike(LICENCE_FILE) | F.col("path").rlike(TEXT_FILE) & (F.col("license_words") * 100 >= F.col("_size") * LICENCE_PERCENT)
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    granted = listed.filter(F.col("license").isNotNull() & is_file & F.col("path").isNotNull())
    granted = granted.groupBy(directory.alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("_g"))
    # Directories, not files, meet their ancestors.
    directories = listed.filter("path IS NOT NULL").select(directory.alias("dir")).distinct()
    up = directories.select("dir", F.inline(ancestors(F.concat("dir", F.lit("/")))).alias("depth", "_up"))
    near = up.join(granted.withColumnRenamed("dir", "_up"), "_up").groupBy("dir").agg(F.max_by("_g", "depth").alias("_g"))
    near = near.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    part = F.pmod(F.xxhash64("_row"), F.lit(SPREAD)).cast("int")
    own_dir = F.when(F.col("license").isNull() & F.col("path").isNotNull(), directory)
    out = listed.withColumn("dir", own_dir).withColumn("_part", part).join(near, ["dir", "_part"], "left")
    return out.select(
        "doc_id",
        "path",
        F.coalesce("license", "_g.license").alias("license"),
        F.coalesce("score", -F.col("_g.s")).alias("score"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("_g").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document; a document's directory is its source."""
    docs = read(spark, sf_dir, "documents")
    path = F.concat(F.coalesce("source", F.lit("unknown")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt"))
    return scan(docs.select("doc_id", path.alias("path"), "text"))
