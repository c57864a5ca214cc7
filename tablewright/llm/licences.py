"""Licences of files: TF-IDF cosine of notices to templates, then inheritance from the nearest directory above.

Built from DataFrame operations only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import read
from tablewright.sources.staging import stage

_AS_IS = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
          "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
          "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. ")
_BSD_3 = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
          "without specific prior written permission. ")
_BSD_AS_IS = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
              "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
              "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS "
              "OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
              "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."


def _creative(short: str, long: str) -> list[str]:
    return [f"Licensed under CC {short} 4.0.", f"This work is licensed under a Creative Commons {long} 4.0 International License.", f"Creative Commons {long} 4.0 International Public License"]


def _gnu(name: str, version: str) -> list[str]:
    return [f"licensed under the GNU {name} Public License, version {version}.", f"GNU {name} Public License, version {version}", f"GNU {name} Public License v{version}",
            f"under the terms of the GNU {name} Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."]


#: Usual wording of notices, headers and titles, whole texts of the short licences, and the openings of the long ones (fixed values of the licences).
TEMPLATES = {
    "AGPL-3.0": [*_gnu("Affero General", "3"), f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the '
                   "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing '
                   "permissions and limitations under the License.",
                   "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
                   "Apache License, Version 2.0", "Apache License 2.0"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "BSD 2-Clause License", _BSD + _BSD_AS_IS],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.",
                     "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "BSD 3-Clause License", _BSD + _BSD_3 + _BSD_AS_IS],
    "CC-BY-4.0": _creative("BY", "Attribution"),
    "CC-BY-NC-4.0": _creative("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-SA-4.0": _creative("BY-SA", "Attribution-ShareAlike"),
    "CC-BY-ND-4.0": _creative("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _creative("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0": _creative("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "GPL-2.0": [*_gnu("General", "2"), f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. {_VERBATIM}"],
    "GPL-3.0": [*_gnu("General", "3"), f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}"],
    "ISC": ["Released under the ISC License.", "ISC License",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
            "and this permission notice appear in all copies."],
    "LGPL-2.1": _gnu("Lesser General", "2.1"),
    "LGPL-3.0": [*_gnu("Lesser General", "3"), f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}"],
    "MIT": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Licensed under the MIT license.", "MIT License",
            'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
            "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
            f"notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one "
                "at http://mozilla.org/MPL/2.0/.", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    # Named without a version.
    "AGPL": ["GNU Affero General Public License"],
    "Apache": ["Apache License"],
    "GPL": ["GNU General Public License"],
    "LGPL": ["GNU Lesser General Public License"],
}
THRESHOLD = 0.75
#: Texts without one of these are not compared; the words that a stretch is laid around are the first of these in a template.
NAMED = r"(?i)licen[cs]e|permission|redistribution"
ANCHORS = ("license", "licensed", "permission", "redistribution")
#: Titles of fewer words than this count only where no longer notice was found.
SENTENCE = 5
#: A template of so many words at most needs all its numbers, so that another version is not taken for it.
NUMBERED = 35
SPDX = r"(?i)SPDX-Licen[cs]e-Identifier:\s*\(?((?:[a-z0-9.+-]*[a-z0-9+])(?:\s+(?:OR|AND|WITH)\s+[a-z0-9.+-]*[a-z0-9+])*)"
#: Share of a file's words that its notices make up if the file is a licence file, and the names such files have.
BULK = 0.5
FILE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|unlicense)(\.(txt|md))?$"


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def spelled(words: Column) -> Column:
    return F.transform(words, lambda w: F.when(w == "licence", "license").when(w == "licenced", "licensed").otherwise(w))


def templates_in_words() -> list[tuple[int, str, list[str], str, int]]:
    """template (number), licence, words, its anchor and the words before that."""
    out = []
    for name, texts in TEMPLATES.items():
        for content in texts:
            words = re.findall(r"[^\W_]+", content.lower())
            before = next(i for i, w in enumerate(words) if w in ANCHORS)
            out.append((len(out), name, words, words[before], before))
    return out


def template_terms(spark: SparkSession) -> DataFrame:
    """template (number), licence, anchor, before, size, term, count, needed. Some thousand rows, whatever the corpus."""
    rows = [(i, name, anchor, before, len(words), term, words.count(term), int(len(words) <= NUMBERED and any(c.isdigit() for c in term)))
            for i, name, words, anchor, before in templates_in_words() for term in sorted(set(words))]
    return spark.createDataFrame(rows, "template int, licence string, anchor string, before int, size int, term string, count int, needed int")


def weights(files: DataFrame) -> DataFrame:
    """term, idf of the templates' terms, from how many of all files hold them."""
    words = sorted({w for _, _, own, _, _ in templates_in_words() for w in own})
    vocabulary = files.sparkSession.createDataFrame([(w,) for w in words], "term string")
    held = files.select(F.explode(F.array_intersect(terms(F.col("text")), F.array(*[F.lit(w) for w in words]))).alias("term"))
    total = files.agg(F.count("text")).scalar()
    counts = held.groupBy("term").agg(F.count("*").alias("held"))
    return (vocabulary.join(counts, "term", "left").withColumn("files", total)
            .select("term", (F.log((1 + F.col("files")) / (1 + F.coalesce("held", F.lit(0)))) + 1).alias("idf"), "files"))


def notices(files: DataFrame, idf: DataFrame) -> DataFrame:
    """path, at, until, licence, score, sentence: the best template of every stretch, laid around the words that licences are named by.

    `files` has each path once, `idf` comes from `weights`.

    A stretch is a run of a template's number of words, anywhere in the text, whatever lines and comment signs it crosses, with the
    anchor where the template has it. The cosine is over sparse TF-IDF vectors; terms outside the templates weigh as
    much as the rarest term. An SPDX identifier is taken as it stands.
    """
    spark = files.sparkSession
    rarest = F.log(1 + F.col("files")) + 1
    own = template_terms(spark)
    shapes = F.broadcast(own.select("anchor", "before", "size").distinct())
    split = files.where(F.col("text").rlike(NAMED)).select("path", spelled(terms(F.col("text"))).alias("words"))
    places = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("anchor"), i.alias("place"))), lambda x: x["anchor"].isin(*ANCHORS))
    begin = F.greatest(F.col("place") - F.col("before"), F.lit(0))
    stretch = (split.select("path", "words", F.explode(places).alias("x")).select("path", "words", "x.*").join(shapes, "anchor")
               .select("path", "anchor", "place", "before", "size", begin.alias("at"), F.slice("words", begin + 1, F.col("size") + F.col("place") - F.col("before") - begin).alias("words")))
    key = ["path", "anchor", "place", "before", "size"]
    counted = stretch.select(*key, "at", (F.col("at") + F.size("words")).alias("until"), F.explode("words").alias("term")).groupBy(*key, "at", "until", "term").agg(F.count("*").alias("count"))
    weighed = counted.join(F.broadcast(idf.select("term", "idf")), "term", "left").withColumn("files", idf.agg(F.max("files")).scalar())
    weighed = weighed.withColumn("weight", F.col("count") * F.coalesce("idf", rarest))
    templates = own.join(F.broadcast(idf.select("term", "idf")), "term").withColumn("own", F.col("count") * F.col("idf"))
    norms = templates.groupBy("template").agg(F.sqrt(F.sum(F.col("own") * F.col("own"))).alias("norm"), F.sum("needed").alias("needs"))
    templates = F.broadcast(stage(templates.join(F.broadcast(norms), "template").select(
        "term", "anchor", "before", "size", "template", "licence", "needed", "needs", (F.col("own") / F.col("norm")).alias("own")), "licence-templates"))
    length = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    dots = (weighed.where("idf is not null").join(templates, ["term", "anchor", "before", "size"]).groupBy(*key, "at", "until", "template", "licence", "needs")
            .agg(F.sum(F.col("weight") * F.col("own")).alias("dot"), F.sum("needed").alias("had")).where("had = needs"))
    scored = dots.join(length, key).withColumn("score", F.round(F.col("dot") / F.col("length"), 9)).where(F.col("score") >= THRESHOLD)
    # The first template in the list wins a tie.
    best = scored.groupBy(*key, "at", "until").agg(F.max(F.struct("score", (-F.col("template")).alias("t"), "licence")).alias("best"))
    found = best.select("path", "at", "until", F.col("best.licence").alias("licence"), F.col("best.score").alias("score"),
                        ((F.col("size") >= SENTENCE) & ~F.col("best.licence").isin("AGPL", "Apache", "GPL", "LGPL")).alias("sentence"))
    named = files.where(F.col("text").rlike(SPDX)).withColumn("licence", F.regexp_extract("text", SPDX, 1))
    ahead = F.size(terms(F.expr(f"substring(text, 1, regexp_instr(text, r'{SPDX}') - 1)")))
    plain = F.regexp_replace(F.regexp_replace("licence", r"(?i)-(only|or-later)(?=\s|$)|\+(?=\s|$)", ""), r"\s+", " ")
    spdx = named.select("path", ahead.alias("at"), (ahead + 3 + F.size(terms(F.col("licence")))).alias("until"), plain.alias("licence"), F.lit(1.0).alias("score"), F.lit(True).alias("sentence"))
    return found.unionByName(spdx)


def parent(path: Column) -> Column:
    """Directory of a path; of a path without `/`, the empty one."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def scan(files: DataFrame) -> DataFrame:
    """path, licence, score, kind ('notice', 'inherited' or NULL), inherited_from of every path of `files` (path, text).

    A file's own notice (sentences before bare titles, then the most similar; ties: the first in the text) counts before an inherited one. A
    licence file gives its licence to all files below its directory that have none of their own, the nearest
    directory first; of several licence files in a directory the one with the smallest path counts. Files with a
    NULL path are left out; of repeated paths the longest text counts (of equally long ones that with the largest digest),
    while the term weights count every row; a NULL text has no notice. Very long texts are looked at whole; other columns
    are ignored. Of all texts only those that name a licence are shuffled.
    """
    rows = files.where("path is not null").select("path", "text", F.coalesce(F.length("text"), F.lit(-1)).alias("chars"), F.xxhash64("text").alias("digest"))
    paths = stage(rows.groupBy("path").agg(F.max(F.struct("chars", "digest")).alias("x")).select("path", "x.*"), "licence-paths")
    telling = rows.where(F.col("text").rlike(NAMED) | F.col("text").rlike(SPDX)).dropDuplicates(["path", "chars", "digest"])
    files = stage(telling.join(paths, ["path", "chars", "digest"]).select("path", "text"), "licence-files")
    found = stage(notices(files, stage(weights(rows), "licence-idf")), "licence-notices")
    # Words that notices cover, each counted once.
    covered = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "until"))), F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
                          lambda a, x: F.struct((a["n"] + F.greatest(x["until"] - F.greatest(x["at"], a["reach"]), F.lit(0))).alias("n"), F.greatest(a["reach"], x["until"]).alias("reach")))["n"]
    own = found.groupBy("path").agg(F.max_by(F.struct("licence", "score"), F.struct("sentence", "score", (-F.col("at")).alias("a"), "until", F.hash("licence").alias("h"))).alias("own"), covered.alias("words"))
    own = stage(own.select("path", "own.licence", "own.score", "words"), "licence-own")
    sized = own.join(files, "path").withColumn("size", F.size(terms(F.col("text"))))
    licence_files = sized.where((F.col("words") >= BULK * F.col("size")) | F.col("path").rlike(FILE_NAMES))
    given = stage(licence_files.groupBy(parent(F.col("path")).alias("directory")).agg(F.min(F.struct("path", "licence")).alias("given"))
                  .select("directory", F.col("given.path").alias("inherited_from"), F.col("given.licence").alias("inherited")), "licence-given")
    # Inheritance is found once a directory; its files then join their own directory.
    placed = paths.select("path").withColumn("home", parent(F.col("path")))
    homes = placed.select("home").distinct()
    parts = F.split("home", "/")
    above = homes.select("home", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).withColumn(
        "directory", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice(F.split("home", "/"), F.lit(1), F.col("depth")), "/")))
    nearest = stage(above.join(given, "directory").groupBy("home").agg(F.max_by(F.struct("inherited", "inherited_from"), "depth").alias("near"))
                    .select("home", "near.*"), "licence-nearest")
    joined = placed.join(own.select("path", "licence", "score"), "path", "left").join(nearest, "home", "left")
    kind = F.when(F.col("licence").isNotNull(), "notice").when(F.col("inherited").isNotNull(), "inherited")
    return joined.select("path", F.coalesce("licence", "inherited").alias("licence"), "score", kind.alias("kind"),
                         F.when(F.col("licence").isNull(), F.col("inherited_from")).alias("inherited_from"))


def op7_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of their source's tree: source/thousands/hundreds/id.txt; a short text that is a notice is a licence file."""
    number = F.col("doc_id").cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 100).cast("string"),
                       F.concat(number, F.lit(".txt")))
    documents = read(spark, folder, "documents").where("doc_id is not null").select(path.alias("path"), "text")
    return scan(documents).select(F.regexp_extract("path", r"([0-9-]+)\.txt$", 1).cast("long").alias("doc_id"), "path", "licence", "score", "kind", "inherited_from")
