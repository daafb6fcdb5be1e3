"""Operator 8: licence scan by sparse TF-IDF cosine, with inheritance along paths.

The units of a file are its lines, paragraphs, runs of comment lines and whole
text. Each is compared with templates: short notices, identifier tags, header
blocks and the texts of licence files (``licences/``; those of AGPL-3.0 and
CC-BY-NC-4.0 are GPL-3.0's and CC-BY-4.0's with their own passages set in). The
measure is the cosine of TF-IDF vectors (``1 + ln tf``, so that the articles of
a long text don't outweigh its words), term weights from counts over all files:
first of the templates' terms, then of all terms of the units that could reach
the threshold if their other terms had the least weight. The terms of units
join the terms of templates. A unit can only reach the
threshold if it holds one of a template's rare terms (those without which the
rest of the template's weight stays below it), so other files and units are
left aside without loss. A file with a licence of its own is a licence file of
its directory if it has the name of one, states the licence in its header (after
blank, comment, title and copyright lines at most; with ``closing`` also in its
last lines) or is as a whole the text of a licence file. Files without a licence
of their own inherit from the nearest ancestor directory that has a licence
file, found by joining their ancestor paths. DataFrame functions only.

Defined cases: null and empty texts have no notice; all units of very long texts
are compared; a null path has no
directory and neither gives nor inherits; ties of notices go to the higher
cosine, then the name; of several licence files in a directory those with the
name of one count first, then the least path (then licence); repeated rows are answered each; extra columns are
ignored.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small

# Names of public licences and their usual short notices.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
}
HEADERS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
]
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
HEADERS += [(name, _GNU.format(kind, version)) for name, kind, version in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"))]
#: Texts of licence files by licence, copyright lines left out where they differ from file to file.
BODIES = {f.stem: f.read_text() for f in sorted((Path(__file__).parent / "licences").glob("*.txt"))}
TAG = "spdx-license-identifier"
TAGS = [(name, f"{TAG}: {name}{form}") for name in sorted({*NOTICES, *BODIES}) for form in (("", "-only", "-or-later") if "GPL" in name else ("",))]
THRESHOLD = 0.7
#: A run of lines that begin with a comment mark.
COMMENTS = r"(?m)(?:^[ \t]*(?:#|//|/\*|\*|--|;|%|<!--|\.\.)[^\n]*\n?)++"


#: Names of licence files.
NAMED = r"(?i)(?:^|/)(?:(?:un)?licen[cs]e|copying|copyright|notice)(?:[-_][^/.]*)?(?:\.(?:txt|md|rst|html|mit|apache|bsd|gpl|lesser))?$"
#: Lines that may stand before the notice of a header: blank lines, comments, copyright lines and titles.
FRONT = r"(?i)\A(?:[ \t\r]*(?:(?:#|//|/\*|\*|--|;|%|<!--|\.\.|=|copyright\b|\(c\)|\x{a9}|all rights reserved)[^\n]*|[^\n]{0,60}licen[cs]e[ \t\r]*(?:\([^\n)]*\))?[ \t\r]*)?\n)*+"
#: What may stand after the notice of a last line.
BLANK = " \t\r\n*/->#"


def default_templates() -> list[tuple[str, str]]:
    """Licence and text of every template."""
    return [*NOTICES.items(), *HEADERS, *BODIES.items(), *TAGS]


def _terms(text: Column) -> Column:
    """Lower-case words, numbers with their points and hyphens; a point at the end belongs to the sentence. An identifier tag is one term with its identifier."""
    tagged = F.regexp_replace(F.lower(text), TAG + r":[ \t]*", TAG + "-")
    return F.regexp_extract_all(tagged, F.lit(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"), F.lit(0))


def python_terms(text: str) -> list[str]:
    import re

    return re.findall(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*", re.sub(TAG + r":[ \t]*", TAG + "-", text.lower()))


def document_counts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``term, n``: in how many rows each term of ``wanted`` (one column, distinct) is; terms in no row are missing."""
    held = rows.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    return held.join(F.broadcast(wanted) if small(wanted) else wanted.hint("merge"), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def idf(total: int, n: int) -> float:
    return math.log((1 + total) / (1 + n)) + 1


def vector(text: str, weight: dict[str, float]) -> dict[str, float]:
    """Weights of a template's terms, of length 1."""
    terms = python_terms(text)
    out = {t: (1 + math.log(terms.count(t))) * weight[t] for t in sorted(set(terms))}
    norm = math.sqrt(sum(w * w for w in out.values()))
    return {t: w / norm for t, w in out.items()}


def needed_terms(vectors: list[dict[str, float]], weight: dict[str, float], threshold: float) -> list[str]:
    """Terms of which a unit must hold one to reach the threshold with some template; the rarest that serve."""
    out = set()
    for v in vectors:
        rest = 0.0
        for term in sorted(v, key=lambda t: (weight[t], t)):  # the commonest may be missing together
            rest += v[term] ** 2
            if rest >= (threshold**2) * 0.999999:
                out.add(term)
    return sorted(out)


def _units(text: Column, needed: Column, closing: bool) -> Column:
    """Lines, paragraphs, comment runs and the whole: whether it is the whole or at the edge (header, or the end if ``closing``), its terms.

    Those of several lines that are one line are left to the lines. At an edge a
    unit must begin or end with a line that holds a needed term.
    """
    bound = F.array(F.struct(text.alias("text"), F.char_length(F.regexp_extract(text, FRONT, 0)).alias("head"), F.rtrim(text, F.lit(BLANK)).alias("end")))
    several = lambda texts: F.filter(texts, lambda x: F.trim(x).contains("\n"))
    texts = F.concat(F.split(text, "\n"), several(F.concat(F.split(text, r"\n\s*\n"), F.regexp_extract_all(text, F.lit(COMMENTS), F.lit(0)))))

    def unit(b: Column, x: Column) -> Column:
        body, end = F.regexp_replace(F.concat(x, F.lit("\n")), FRONT, ""), F.rtrim(x, F.lit(BLANK))
        edge = F.substring(b["text"], F.lit(1), b["head"] + F.char_length(x)).contains(x) & ((body == "") | F.arrays_overlap(_terms(F.substring_index(body, "\n", 1)), needed))
        if closing:
            edge |= b["end"].endswith(end) & F.arrays_overlap(_terms(F.substring_index(end, "\n", -1)), needed)
        return F.struct(F.lit(False).alias("whole"), edge.alias("edge"), _terms(x).alias("terms"))

    parts = F.flatten(F.transform(bound, lambda b: F.transform(texts, lambda x: unit(b, x))))
    return F.concat(parts, F.array(F.struct(F.lit(True).alias("whole"), F.lit(False).alias("edge"), _terms(text).alias("terms"))))


def _scores(terms: DataFrame, known: DataFrame, other: Column, licences: list[str]) -> DataFrame:
    """``row, unit, whole, edge, score, licence, template`` of the best template of each unit. ``terms``: row, unit, whole, edge, term, tf; ``known``: term, idf, templates."""
    w = (1 + F.log(F.col("tf").cast("double"))) * F.coalesce("idf", other)
    part = lambda template, x: F.struct(template.alias("template"), x.alias("x"))
    parts = F.concat(F.array(part(F.lit(-1), F.col("w") * F.col("w"))), F.transform(F.coalesce("templates", F.array().cast("array<struct<template:int,x:double>>")), lambda t: part(t["template"], F.col("w") * t["x"])))
    rows = terms.join(F.broadcast(known) if small(known) else known.hint("merge"), "term", "left").withColumn("w", w).select("row", "unit", "whole", "edge", F.explode(parts).alias("p"))
    sums = rows.groupBy("row", "unit", "whole", "edge", "p.template").agg(F.sum("p.x").alias("x"))
    each = sums.groupBy("row", "unit", "whole", "edge").agg(F.max(F.when(F.col("template") < 0, F.col("x"))).alias("square"), F.collect_list(F.when(F.col("template") >= 0, F.struct("template", "x"))).alias("dots"))
    names = F.array(*map(F.lit, licences))
    best = F.array_max(F.transform("dots", lambda d: F.struct(F.round(d["x"] / F.sqrt("square"), 9).alias("score"), F.get(names, d["template"]).alias("licence"), d["template"].alias("template"))))
    return each.withColumn("best", best).select("row", "unit", "whole", "edge", "best.score", "best.licence", "best.template")


def licence_scan(files: DataFrame, notices: dict[str, str] | None = None, threshold: float = THRESHOLD, closing: bool = False) -> DataFrame:
    """``file_id, path, licence, score, origin, source_path`` for every row of ``file_id, path, text``.

    ``notices``: templates in the place of the default ones. ``origin``: own,
    inherited or none; ``source_path``: the file that states the licence.
    ``closing``: a notice at a file's end counts as one in its header.
    """
    templates = default_templates() if notices is None else list(notices.items())
    spark = files.sparkSession
    scratch = Scratch(spark)
    rows = files.select(F.col("file_id"), F.col("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    vocabulary = sorted({t for _, text in templates for t in python_terms(text)})
    counts = {r["term"]: r["n"] for r in document_counts(rows, spark.createDataFrame([(t,) for t in vocabulary], "term string")).collect()}  # as many rows as the templates have terms
    total = rows.count()
    weight = {t: idf(total, counts.get(t, 0)) for t in vocabulary}
    vectors = [vector(text, weight) for _, text in templates]
    uses: dict[str, list[tuple[int, float]]] = {t: [] for t in vocabulary}
    for n, v in enumerate(vectors):
        for t, x in v.items():
            uses[t].append((n, x))
    known = scratch.write(spark.createDataFrame([(t, weight[t], uses[t]) for t in vocabulary], "term string, idf double, templates array<struct<template:int,x:double>>"), "templates")
    needed = F.array(*map(F.lit, needed_terms(vectors, weight, threshold)))
    units = F.filter(_units(F.col("text"), needed, closing), lambda u: F.arrays_overlap(u["terms"], needed))
    kept = rows.select("file_id", "path", F.when(F.arrays_overlap(_terms(F.col("text")), needed), units).alias("units"))
    kept = scratch.write(kept.withColumn("row", F.monotonically_increasing_id()), "files")
    terms = kept.select("row", F.posexplode("units").alias("unit", "u")).select("row", "unit", "u.whole", "u.edge", F.explode("u.terms").alias("term"))
    terms = terms.groupBy("row", "unit", "whole", "edge", "term").agg(F.count(F.lit(1)).alias("tf"))
    # Terms outside the templates weigh 1 at least, which bounds the score from above; those of units still open are counted.
    licences = [name for name, _ in templates]
    open_units = _scores(terms, known, F.lit(1.0), licences).where(F.col("score") >= threshold)
    open_units = scratch.write(open_units.select("row", "unit"), "open")
    terms = terms.join(F.broadcast(open_units) if small(open_units) else open_units.hint("merge"), ["row", "unit"], "left_semi")
    terms = scratch.write(terms, "terms")
    wanted = scratch.write(terms.join(F.broadcast(known), "term", "left_anti").select("term").distinct(), "wanted")
    counted = document_counts(rows, wanted).select("term", (F.log((1 + F.lit(float(total))) / (1 + F.col("n"))) + 1).alias("idf"), F.lit(None).cast(known.schema["templates"].dataType).alias("templates"))
    weighed = scratch.write(known.unionByName(counted), "weights")
    hits = _scores(terms, weighed, F.lit(idf(total, 0)), licences).where(F.col("score") >= threshold)
    texts = set(BODIES.values()) if notices is None else set()
    stated = F.col("edge") | (F.col("whole") & F.get(F.array(*(F.lit(text in texts) for _, text in templates)), "template"))
    hits = hits.groupBy("row").agg(F.max(F.struct("score", "licence")).alias("top"), F.collect_set(F.when(stated, F.col("licence"))).alias("stated"))
    hits = scratch.write(hits.select("row", F.col("top.licence").alias("own"), F.round("top.score", 6).alias("score"), F.array_contains("stated", F.col("top.licence")).alias("stated")), "hits")
    found = kept.drop("units").join(F.broadcast(hits) if small(hits) else hits.hint("merge"), "row", "left")

    directory = F.regexp_replace("path", r"/?[^/]*$", "")
    named = F.col("path").rlike(NAMED)
    given = found.where(F.col("own").isNotNull() & F.col("path").isNotNull() & (F.col("stated") | named)).groupBy(directory.alias("dir"))
    given = scratch.write(given.agg(F.min(F.struct((~named).alias("other"), "path", "own")).alias("m")).select("dir", F.col("m.path").alias("source_path"), F.col("m.own").alias("inherited")), "directories")
    # All directories above a file, the nearest with the largest depth.
    steps = F.split(directory, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, 1, n), "/").alias("dir")))
    open_ = found.where("own IS NULL AND path IS NOT NULL").select("row", F.explode(F.array_distinct(above)).alias("a")).select("row", "a.depth", "a.dir")
    near = open_.join(F.broadcast(given) if small(given) else given.hint("merge"), "dir")
    near = near.groupBy("row").agg(F.max(F.struct("depth", "inherited", "source_path")).alias("n")).select("row", "n.inherited", "n.source_path")
    out = found.hint("merge").join(near, "row", "left")
    return out.select(
        "file_id", "path", F.coalesce("own", "inherited").alias("licence"), "score",
        F.when(F.col("own").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("own").isNotNull(), F.col("path")).otherwise(F.col("source_path")).alias("source_path"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: ``source/doc_id`` in the main language, English, ``source/lang/doc_id`` in others."""
    directory = F.when(docs["lang"] == "en", docs["source"]).otherwise(F.concat_ws("/", docs["source"], docs["lang"]))
    return docs.select(docs["doc_id"].cast("long").alias("file_id"), F.concat_ws("/", directory, docs["doc_id"].cast("string")).alias("path"), docs["text"])
