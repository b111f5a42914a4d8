"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor
directory (operator 9). DataFrame functions only.

Each licence has several templates: its identifier line, titles, notices, and the whole text where that is short. A unit of
a file is a window of up to ``WINDOW`` lines that have a word; a licence file (by its name) is compared as a whole, too. A
unit is a sparse vector of its terms, weighted by inverse document frequency among the templates (a term that no template
has weighs most). Only windows with a distinctive term can reach the threshold: by Cauchy-Schwarz, a template restricted to
its other terms is too short. So a pattern of the distinctive terms picks the windows that may be compared, without loss.
By the same inequality a window's cosine is at most the share of its own length that lies in terms of templates; a bound of
that share, by numbers of terms, leaves out windows of other prose, also without loss, before their terms are counted. The
products are a join of the units' terms with the templates' terms, a table of fixed size that is broadcast.

Each file comes with one ``licence``, the best, and with all ``licences`` that reach the threshold, with the best cosine of any
unit and template of each. A file without one of its own takes that of the nearest directory above it which holds a licence
file that names one; without any, all those of the nearest directory whose licence files have some. Directories are resolved first, over distinct directories, then joined to files by path: ancestors are as many as
the path is deep, and no directory's files are gathered.

Long licences (Apache, GPL, MPL and so on) are known by titles and notices, not by their whole texts. For ``licence``, the
texts of short ones count in licence files as a whole; ``licences`` has them from any file that holds one on up to ``WINDOW`` lines, too.

Defined results: a null path or text is an empty one; a file at the top has the directory ``''``. Ties between licences
go to the higher cosine, then the first name. Repeated rows stay; only the columns asked for are read. An empty table gives
an empty one.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import SMALL_SIDE, dropped, if_small, key_of, table, written

LEAST = 0.8
LICENCE_NAME = r"(?i)^(licen[sc]e|copying|unlicense)(\..*)?$"
#: Lines of a window at most.
WINDOW = 3
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must
retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice
appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License"
#: Published titles, notices and texts of licences by their public identifiers; fixed values. Each also has its identifier line.
TEMPLATES = {
    "AGPL-3.0": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", _GNU.replace("General", "Affero General").format(3), "Licensed under the GNU Affero General Public License version 3"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004", "Apache License 2.0"),
    "Artistic-1.0": ("The \"Artistic License\"", "The Artistic License 1.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", f"{_BSD_2} {_BSD_END}"),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "BSD 3-Clause License", f"{_BSD_2} {_BSD_NAMES} {_BSD_END}",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related rights"),
    "GFDL-1.2": ("GNU Free Documentation License Version 1.2, November 2002",),
    "GFDL-1.3": ("GNU Free Documentation License Version 1.3, 3 November 2008",),
    "GPL-1.0": ("GNU GENERAL PUBLIC LICENSE Version 1, February 1989", _GNU.format(1)),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", _GNU.format(2)),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _GNU.format(3)),
    "ISC": ("ISC License", _ISC),
    "LGPL-2.0": ("GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "LGPL-2.1": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", _GNU.replace("General", "Lesser General").format("2.1")),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _GNU.replace("General", "Lesser General").format(3)),
    "MIT": ("Released under the MIT License.", "MIT License", "The MIT License (MIT)", "This project is licensed under the MIT License.", _MIT),
    "MPL-1.1": ("MOZILLA PUBLIC LICENSE Version 1.1",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Zlib": ("zlib License", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
}
#: Terms from which on a template is a whole text; for ``licence``, whole licence files are compared with it, but no windows.
WHOLE = 60
#: Cosines are rounded to six places, so what is below a threshold by less than this still reaches it.
SLACK = 1e-6
#: Words of any prose; they are the first that aren't distinctive.
PROSE = frozenset("a an and any are as at be by for from in is it law may more of on or other so than that the their this to under use used was we will with work you".split())


def _terms(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def any_of(terms: list[str]) -> str:
    """A pattern that finds any of the terms in lower-case text, with terms as ``_terms`` cuts them. Shared beginnings are tried once."""
    tree: dict = {}
    for term in terms:
        at = tree
        for c in term + "\0":
            at = at.setdefault(c, {})

    def branches(at: dict) -> str:
        found = [c + branches(below) for c, below in sorted(at.items()) if c != "\0"]
        if not found:
            return ""
        inside = found[0] if len(found) == 1 and "\0" not in at else f"(?:{'|'.join(found)})"
        return inside + "?" * ("\0" in at)

    return f"(?<![a-z0-9]){branches(tree)}(?![a-z0-9])" if terms else "(?!)"


class Weights:
    """Inverse document frequencies among templates, the templates' vectors, and the distinctive terms."""

    def __init__(self, templates: dict[str, tuple[str, ...]], least: float) -> None:
        texts = [(name, text) for name, own in sorted(templates.items()) for text in (*own, f"SPDX-License-Identifier: {name}")]
        n = len(texts)
        df: dict[str, int] = {}
        for _, text in texts:
            for term in set(_terms(text)):
                df[term] = df.get(term, 0) + 1
        self.idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items()}
        self.unknown = math.log(1 + n) + 1
        self.vectors: list[tuple[str, dict[str, float]]] = []
        for name, text in texts:
            words = _terms(text)
            vector = {t: words.count(t) * self.idf[t] for t in sorted(set(words))}
            norm = math.sqrt(sum(v * v for v in vector.values()))
            self.vectors.append((name, {t: v / norm for t, v in vector.items()}))
        # Short terms are words of any prose: as many of them as leave every template's part in them below the threshold.
        self.whole = [len(_terms(text)) >= WHOLE for _, text in texts]
        plain: set[str] = set()
        for term in sorted(self.idf, key=lambda t: (t not in PROSE, len(t), t)):
            more = plain | {term}
            if all(math.sqrt(sum(v * v for t, v in x.items() if t in more)) < least - SLACK for _, x in self.vectors):
                plain = more
        self.distinctive = sorted(self.idf.keys() - plain)

    def may_reach(self, least: float, unknown, known, distinct):
        """Whether a unit with so many words that no template has, words of templates, and different ones of these may reach
        ``least`` (as rounded): the squares of its counts sum up to at most (known - distinct + 1)**2 + distinct - 1 over
        templates' terms, and to ``unknown`` at least over the others, which weigh ``self.unknown`` each."""
        square = (least - SLACK) ** 2
        cost = square / (1 - square) * (self.unknown / max(self.idf.values())) ** 2
        return unknown * cost <= (known - distinct + 1) * (known - distinct + 1) + distinct - 1


def _ordered() -> Column:
    """Rows (minus, name) of a group as one array: as many elements as there are licences at most."""
    return F.sort_array(F.collect_list(F.struct("minus", "name")))


def best(units: DataFrame, weights: Weights, least: float) -> DataFrame:
    """(key, top, found) for each key of the units (key, u, unit) with any cosine that reaches the threshold: structs (minus,
    name) of the best cosine, negated, and its licence. ``found`` has one for each licence, in their order; ``top`` is the best
    without windows' cosines to whole texts, or null. u is -1 for a whole file. Units of rows that are alike come several times,
    which changes no cosine."""
    spark = units.sparkSession
    idf = spark.createDataFrame(sorted(weights.idf.items()), "term string, idf double")
    # A row for each term of each template: a table of fixed size.
    vectors = spark.createDataFrame([(t, k, name, weights.whole[k], w * weights.idf[t]) for k, (name, v) in enumerate(weights.vectors) for t, w in v.items()], "term string, template int, name string, whole boolean, weight double")
    terms = units.select("key", "u", F.explode(F.regexp_extract_all(F.lower("unit"), F.lit("[a-z0-9]+"), F.lit(0))).alias("term")).groupBy("key", "u", "term").agg(F.count("*").cast("double").alias("n"))
    terms = written(terms)
    norms = terms.join(F.broadcast(idf), "term", "left").groupBy("key", "u").agg(F.sqrt(F.sum(F.pow(F.col("n") * F.coalesce("idf", F.lit(weights.unknown)), F.lit(2.0)))).alias("norm"))
    dots = terms.join(F.broadcast(vectors), "term").groupBy("key", "u", "template", "name", "whole").agg(F.sum(F.col("n") * F.col("weight")).alias("dot"))
    rated = dots.join(norms, ["key", "u"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("cosine") >= least)
    minus = -F.col("cosine")
    each = rated.groupBy("key", "name").agg(F.min(minus).alias("minus"), F.min(F.when(~F.col("whole") | (F.col("u") == -1), minus)).alias("strict"))
    top = F.min(F.when(F.col("strict").isNotNull(), F.struct(F.col("strict").alias("minus"), "name")))
    out = written(each.groupBy("key").agg(top.alias("top"), _ordered().alias("found")))
    dropped(terms)
    return out


def scan(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """file_id, path, licence, cosine, origin (header, inherited or null), licences (all that reach the threshold, as an array of
    (licence, cosine), the best first; empty if there is none) for each row of ``files`` (file_id, path, text)."""
    weights = Weights(templates, least)
    pattern = any_of(weights.distinctive)
    rows = files.select("file_id", F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(
        "file_id", "path", "text", key_of(F.col("file_id"), F.col("path"), F.col("text")).alias("key"),
        F.regexp_replace(F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1), "/+$", "").alias("directory"),
        F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENCE_NAME).alias("is_licence"),
    )
    found = rows.filter(F.col("is_licence") | F.lower("text").rlike(pattern)).select("key", "text", "is_licence", F.filter(F.split("text", "\n", -1), lambda line: line.rlike("[A-Za-z0-9]")).alias("lines"))
    # A column is referred to twice in the next select, so that it isn't worked out anew for each line.
    marked = found.select("*", F.transform("lines", lambda line: F.lower(line).rlike(pattern)).alias("marks"))
    hits = F.filter(F.transform("marks", lambda hit, i: F.when(hit, i)), lambda i: i.isNotNull())
    near = lambda i: F.exists(F.slice("marks", F.greatest(i - WINDOW + 2, F.lit(1)), 2 * WINDOW - 1), lambda hit: hit)
    line_terms = F.transform("lines", lambda line, i: F.when(near(i), F.regexp_extract_all(F.lower(line), F.lit("[a-z0-9]+"), F.lit(0))))
    facts = F.transform(line_terms, lambda x: F.struct(F.size(x).alias("n"), F.filter(x, lambda t: t.isin(sorted(weights.idf))).alias("known")))
    # Windows that hold the line: (lines before it, lines in all).
    shapes = F.array(*[F.struct(F.lit(before).alias("before"), F.lit(size).alias("size")) for size in range(1, WINDOW + 1) for before in range(size)])
    part = lambda column, i, shape: F.slice(column, i - shape["before"] + 1, shape["size"])
    known = lambda i, shape: F.flatten(F.transform(part("facts", i, shape), lambda x: x["known"]))
    total = lambda i, shape: F.aggregate(part("facts", i, shape), F.lit(0), lambda n, x: n + x["n"])
    # As doubles, since the square of a count may be more than an integer holds.
    count = lambda x: F.size(x).cast("double")
    likely = lambda i, shape: weights.may_reach(least, total(i, shape) - count(known(i, shape)), count(known(i, shape)), count(F.array_distinct(known(i, shape))))
    window = lambda i, shape: F.when(i >= shape["before"], F.when(likely(i, shape), F.array_join(part("lines", i, shape), " ")))
    held = marked.select("key", "text", "is_licence", "lines", hits.alias("hits"), facts.alias("facts"))
    units = F.flatten(F.transform("hits", lambda i: F.transform(shapes, lambda shape: window(i, shape))))
    windows = held.select("key", F.posexplode(F.filter(F.array_distinct(units), lambda x: x.isNotNull())).alias("u", "unit"))
    named = best(windows.unionAll(held.filter("is_licence").select("key", F.lit(-1), "text")), weights, least).toDF("own_key", "own_top", "own")
    # Arrays, mostly of one element, so fewer rows than of numbers are sent to all executors.
    own = rows.drop("text").join(if_small(named, SMALL_SIDE // 4), rows.key == named.own_key, "left")

    each = own.filter("is_licence").select(F.col("directory").alias("held_by"), "own_top", F.explode("own").alias("one"))
    each = each.groupBy("held_by", "one.name").agg(F.min("one.minus").alias("minus"), F.min("own_top").alias("top"))
    holders = each.groupBy("held_by").agg(F.min("top").alias("held_top"), _ordered().alias("held"))
    steps = F.split("directory", "/", -1)
    above = rows.select("directory").distinct().select(
        "directory", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, 1, k), "/").alias("ancestor")))).alias("step")
    )
    nearest = written(
        above.join(holders, above.step.ancestor == holders.held_by)
        .groupBy(F.col("directory").alias("of_directory"))
        .agg(F.max_by("held_top", F.when(F.col("held_top").isNotNull(), F.col("step.depth"))).alias("held_top"), F.max_by("held", "step.depth").alias("held"))
    )
    top, found = F.coalesce("own_top", "held_top"), F.coalesce("own", "held")
    return own.join(if_small(nearest, SMALL_SIDE // 4), own.directory == nearest.of_directory, "left").select(
        "file_id", "path",
        top["name"].alias("licence"),
        (-top["minus"]).alias("cosine"),
        F.when(F.col("own_top").isNotNull(), F.lit("header")).when(F.col("held_top").isNotNull(), F.lit("inherited")).alias("origin"),
        F.coalesce(F.transform(found, lambda x: F.struct(x["name"].alias("licence"), (-x["minus"]).alias("cosine"))), F.array()).alias("licences"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as a tree of files: a directory for each source, thousand and hundred of ids; the first document of a
    thousand is its directory's licence file, the first of a hundred that of the directory below."""
    source, i = F.coalesce(F.col("source").cast("string"), F.lit("unknown")), F.col("doc_id").cast("long")
    top, below = F.concat(source, F.lit("/"), F.floor(i / 1000).cast("string")), F.floor(i / 100).cast("string")
    path = (
        F.when(i.isNull(), F.concat(source, F.lit("/unknown.txt")))
        .when(F.pmod(i, F.lit(1000)) == 0, F.concat(top, F.lit("/LICENSE")))
        .when(F.pmod(i, F.lit(100)) == 0, F.concat(top, F.lit("/"), below, F.lit("/LICENSE")))
        .otherwise(F.concat(top, F.lit("/"), below, F.lit("/"), i.cast("string"), F.lit(".txt")))
    )
    return docs.select(i.alias("file_id"), path.alias("path"), "text")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(as_files(table(spark, sf_dir, "documents"))).withColumnRenamed("file_id", "doc_id")
    named = F.transform("licences", lambda x: F.concat_ws(":", x["licence"], x["cosine"].cast("string")))
    return found.withColumn("n_licences", F.size("licences").cast("long")).withColumn("licences", F.array_join(named, ","))
