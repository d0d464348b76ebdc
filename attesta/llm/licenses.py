"""Licence scan: sparse TF-IDF cosine to templates, and inheritance by path (DataFrame functions only).

Passages (lines, sentences and paragraphs) that speak of licences are compared
with public notices: by cosine, with document frequencies of all words, and by
whether they hold all of a notice in a row, however long the passage and the corpus. A file without a notice of its own takes the licence of the
nearest ancestor directory that has a licence file.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

_GNU = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."


def _gnu(kind: str, v: str, *what: str) -> tuple[str, ...]:
    return tuple(_GNU.format(what=w, kind=kind, v=v) for w in what)


_MIT = """The MIT License (MIT)
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT_GRANT = _MIT.split("\n")[1]
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1_2 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_CC = "This work is licensed under a Creative Commons Attribution{0} 4.0 International License.", "Creative Commons Attribution{0} 4.0 International Public License"

#: Public notices: one-line forms, standard file headers, titles of the long licence texts, and the short texts whole.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", _MIT_GRANT, _MIT),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", _APACHE, "Apache License Version 2.0, January 2004"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", *_gnu("", "3", "program"), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "GPL-2.0": ("Licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", *_gnu("", "2", "program"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", *_gnu("Lesser ", "3", "program", "library"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "LGPL-2.1": ("Licensed under the GNU Lesser General Public License, version 2.1.", *_gnu("Lesser ", "2.1", "program", "library"), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", *_gnu("Affero ", "3", "program"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "Mozilla Public License Version 2.0"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", _BSD_3, f"{_BSD} {_BSD_1_2} 3. {_BSD_3} {_BSD_END}"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", _BSD, f"{_BSD} {_BSD_1_2} {_BSD_END}"),
    "ISC": ("Licensed under the ISC License.", _ISC, f"{_ISC} {_ISC_END}"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", *(t.format("") for t in _CC)),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", *(t.format("-ShareAlike") for t in _CC)),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", *(t.format("-NonCommercial") for t in _CC)),
    "CC0-1.0": ("To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0.", "Creative Commons Legal Code CC0 1.0 Universal"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: A passage is a candidate if it has one of these; every template has.
ANCHOR = r"(?i)licen[cs]e|copyright|public domain|permission|redistribut|\bCC[ -](?:BY|0)|\bCC0"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
LEAST_SIMILARITY = 0.6
#: A notice of so many terms is found in any longer sentence that has them in a row.
LEAST_IN_A_ROW = 4
#: Words of one passage in so many are broadcast with their document frequency.
OFTEN = 1000
#: Ends of sentences, over the marks of comments at the start of a line.
SENTENCE_END = r"(?<=[.!?])[\s#*/;%-]+(?=[\"'(]?\p{Lu})"
#: The notices of the first are part of the second's: a file with a notice of the second has the second.
PART_OF = {"BSD-2-Clause": "BSD-3-Clause"}
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _notices(templates: dict[str, tuple[str, ...]]) -> list[tuple[str, list[str]]]:
    return [(name, re.findall(TERM, text.lower())) for name, texts in templates.items() for text in texts]


def _held(notices: list[tuple[str, list[str]]]) -> Column:
    """Places of the notices whose terms stand in the passage in a row, whatever stands before and after them."""
    line = F.concat(F.lit(" "), F.array_join(_terms(F.col("passage")), " "), F.lit(" "))
    hits = lambda x: F.array_compact(F.array(*[F.when(F.contains(x, F.lit(f" {' '.join(terms)} ")), F.lit(i)) for i, (_, terms) in enumerate(notices) if len(terms) >= LEAST_IN_A_ROW]).cast("array<int>"))
    return F.transform(F.array(line), hits)[0]  # the line is made once, not for every notice


def _weights(spark: SparkSession, frequencies: DataFrame, total: int, notices: list[tuple[str, list[str]]]) -> tuple[DataFrame, DataFrame]:
    """(term, idf, weights) to broadcast, with the weight in each notice; (term, idf) of all other terms.

    Document frequencies count the passages of all files and the notices; for a
    word that no notice has, the passages other than the one that is compared.
    Broadcast are the notices' terms, some hundred rows whatever the input, and
    the words of at least one passage in OFTEN, whose number is bounded by OFTEN
    times the mean length of a passage. The others are joined by term.
    """
    vocabulary = sorted({t for _, terms in notices for t in terms})
    of = F.broadcast(spark.createDataFrame([(t,) for t in vocabulary], "term string"))
    df = {r["term"]: r["count"] for r in frequencies.join(of, "term", "left_semi").collect()}
    idf = {t: math.log((1 + total) / (1 + df.get(t, 0) + sum(t in terms for _, terms in notices))) + 1 for t in vocabulary}
    columns = []
    for _, terms in notices:
        w = {t: terms.count(t) * idf[t] for t in terms}
        size = math.sqrt(sum(v * v for v in w.values()))
        columns.append({t: v / size for t, v in w.items()})
    known = spark.createDataFrame([(t, idf[t], [c.get(t, 0.0) for c in columns]) for t in vocabulary], "term string, idf double, weights array<double>")
    others = frequencies.join(of, "term", "left_anti").select("term", (F.log(F.lit(1.0 + total) / F.col("count")) + 1).alias("idf"), (F.col("count") * OFTEN >= total).alias("often"))
    common = others.where("often").select("term", "idf", F.lit(None).cast("array<double>").alias("weights"))
    return known.union(common), others.where("NOT often").select("term", "idf")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id", templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST_SIMILARITY) -> DataFrame:
    """One row per row of ``files``: doc_id, path, licence, similarity, origin, licence_dir.

    ``origin`` is 'notice' for a file's own best passage, one that holds a whole
    notice in a row before any other of similarity ``least`` or more, 'inherited' for the nearest ancestor directory with a
    licence file (a name like LICENSE or COPYING; a notice in any other file
    speaks of that file only), else null like the licence. Of equal similarities the licence last
    in order of name wins. Null texts have no notice; a null path has no
    directory; rows that repeat an id and path count as one file each time and get equal results. An
    empty table gives no rows; further columns are ignored.
    """
    spark = files.sparkSession
    base = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    speaking = base.where(F.col("text").rlike(ANCHOR))
    paragraphs = F.split("text", r"\n\s*\n")
    sentences = F.flatten(F.transform(paragraphs, lambda x: F.split(x, SENTENCE_END)))
    every = F.array_distinct(F.concat(F.split("text", r"\n"), paragraphs, sentences))
    notices = _notices(templates)
    names = F.array(*[F.lit(n) for n, _ in notices])
    parts = speaking.select("doc_id", "path", F.filter(every, lambda x: x.rlike(ANCHOR)).alias("parts"))
    passages = parts.select("doc_id", "path", F.explode("parts").alias("passage")).withColumn("held", _held(notices))
    passages = materialize(passages.withColumn("place", F.monotonically_increasing_id()), "passages")
    frequencies = materialize(passages.select(F.explode(F.array_distinct(_terms(F.col("passage")))).alias("term")).groupBy("term").count(), "frequencies")
    known, seldom = _weights(spark, frequencies, passages.count() + len(notices), notices)
    at = ["place", "doc_id", "path", "held"]
    tf = passages.select(*at, F.explode(_terms(F.col("passage"))).alias("term")).groupBy(*at, "term").agg(F.count(F.lit(1)).alias("tf"))
    w = materialize(tf.join(F.broadcast(known), "term", "left"), "terms")
    w = w.where("idf IS NOT NULL").unionByName(w.where("idf IS NULL").drop("idf").join(seldom, "term"))
    x = F.col("tf") * F.col("idf")
    sums = [F.sum(x * F.coalesce(F.col("weights")[i], F.lit(0.0))) for i in range(len(notices))]
    scored = w.groupBy(*at).agg(F.sum(x * x).alias("n2"), F.array(*sums).alias("dots"))
    each = F.transform("dots", lambda d, i: F.struct(F.array_contains("held", i).alias("held"), F.round(d / F.sqrt("n2"), 9).alias("similarity"), F.element_at(names, i + 1).alias("licence")))
    scored = scored.select("doc_id", "path", F.array_max(F.filter(each, lambda e: e["held"] | (e["similarity"] >= least))).alias("best")).where("best IS NOT NULL")
    first = F.max("best")
    for part, whole in PART_OF.items():
        of = F.col("best.licence")
        first = F.when(F.bool_or(of == whole), F.max(F.when(of != part, F.col("best")))).otherwise(first)
    own = scored.groupBy("doc_id", "path").agg(first.alias("best"))
    own = materialize(own.select("doc_id", "path", F.col("best.licence").alias("own"), F.col("best.similarity").alias("similarity")), "notices")

    folder = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).when(F.col("path").isNotNull(), F.lit(""))
    name = F.element_at(F.split("path", "/"), -1)
    licensed = own.where(name.rlike(LICENCE_FILE)).select(folder.alias("dir"), F.struct("similarity", F.col("own").alias("licence")).alias("best"))
    licensed = licensed.where("dir IS NOT NULL").groupBy("dir").agg(F.max("best").alias("best"))
    dirs = base.select(folder.alias("at")).where("at IS NOT NULL").distinct()  # each directory once, not each file
    parts = F.split("at", "/")
    ancestors = F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), F.array(F.lit("")))
    near = dirs.select("at", F.explode(F.array_distinct(ancestors)).alias("dir")).join(licensed, "dir").groupBy("at").agg(F.max(F.struct(F.length("dir").alias("depth"), "dir", "best")).alias("near"))
    near = near.select("at", F.col("near.dir").alias("licence_dir"), F.col("near.best.licence").alias("inherited"))

    out = base.select("doc_id", "path", folder.alias("_at"))
    out = out.join(own.toDF("_id", "_path", "own", "similarity"), F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("path").eqNullSafe(F.col("_path")), "left")
    out = out.join(near, F.col("_at") == F.col("at"), "left")
    mine = F.col("own").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("own", "inherited").alias("licence"), F.when(mine, F.col("similarity")).alias("similarity"),
        F.when(mine, "notice").when(F.col("inherited").isNotNull(), "inherited").alias("origin"), F.when(~mine, F.col("licence_dir")).alias("licence_dir"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of a tree: source / language / id. No such name is a licence file, so none inherits."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    return scan(docs.select("doc_id", "text", path.alias("path")))
