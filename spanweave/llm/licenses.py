"""Licence scans: TF-IDF cosine of header lines and licence files to templates, then inheritance along directories."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize

# Notices by licence, as their licences word them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

# Whole licences, for licence files.
WHOLE = (
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)

#: Cosine from which a licence file is a whole licence, whatever notice its lines come nearer to.
WHOLE_THRESHOLD = 0.9

#: Lines of a wrapped notice, at most, and its words as a multiple of those of the longest template.
SPAN_LINES, SPAN_LENGTH = 12, 2

#: Least cosine at which a line or file carries a template's licence.
THRESHOLD = 0.75
#: What the name of a licence file looks like.
LICENSE_FILE = r"(?i)^(license|licence|copying|unlicense)([._-].*)?$"

_TOKEN = "[a-z0-9]+"


def tokens(text: str) -> list[str]:
    return re.findall(_TOKEN, text.lower())


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, text in templates for w in tokens(text)})


def weights(templates, idf: dict[str, float], rest: float | None = None) -> list[tuple[int, str, float]]:
    """(template, word, weight) of unit vectors; rest: weight of a word without idf."""
    out = []
    for k, (_, text) in enumerate(templates):
        own = {w: n * (idf[w] if rest is None else idf.get(w, rest)) for w, n in sorted(Counter(tokens(text)).items())}
        length = math.sqrt(sum(x * x for x in own.values()))
        out += [(k, w, x / length) for w, x in own.items()]
    return out


def signature_words(unit: list[tuple[int, str, float]], threshold: float) -> set[str]:
    """Words of which a text has at least one if its cosine to any template reaches the threshold.

    Of each template the lightest words are left out while the length of what is left out stays below the threshold:
    by Cauchy-Schwarz a text with none but those stays below it too.
    """
    out = set()
    for k in {t for t, _, _ in unit}:
        own, left = sorted((x, w) for t, w, x in unit if t == k), 0.0
        for x, w in own:
            left += x * x
            if math.sqrt(left) >= threshold - 1e-9:
                out.add(w)
    return out


def wrapped(files: DataFrame, line_sign: str, most: int) -> DataFrame:
    """(rid, line): runs of 2 to SPAN_LINES consecutive lines with a signature word and at most `most` words in all.

    Runs begin and end in a line with words, since empty ones add nothing. All runs of a file are made inside its row.
    """
    ls = files.where("text is not null").select("rid", F.split("text", "\n").alias("ls")).where(F.size("ls") > 1)
    ls = ls.select("rid", "ls", F.transform("ls", lambda x: F.lower(x).rlike(line_sign)).alias("sg"), F.transform("ls", lambda x: F.size(F.regexp_extract_all(F.lower(x), F.lit(f"({_TOKEN})")))).alias("ns"))
    starts = F.filter(F.sequence(F.lit(1), F.size("ls") - 1), lambda i: F.element_at("ns", i).between(1, most) & F.exists(F.slice("sg", i, SPAN_LINES), lambda x: x))
    runs = ls.select("rid", "ls", "sg", "ns", starts.alias("starts")).where(F.size("starts") > 0)

    def of(i):
        lengths = F.sequence(F.lit(2), F.least(F.lit(SPAN_LINES), F.size("ls") - i + 1))
        fits = lambda n: (F.element_at("ns", i + n - 1) > 0) & F.exists(F.slice("sg", i, n), lambda x: x) & (F.aggregate(F.slice("ns", i, n), F.lit(0), lambda a, b: a + b) <= most)
        return F.transform(F.filter(lengths, fits), lambda n: F.array_join(F.slice("ls", i, n), "\n"))

    return runs.select("rid", F.explode(F.flatten(F.transform("starts", of))).alias("line"))


def scan_licenses(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, own_license, own_score, license, license_path): one row per file.

    1. Document frequencies of the templates' words are counted over all whole texts; a word of no template counts as
    unseen. 2. Each line of each file, each run of consecutive lines of a notice's length (a wrapped notice), and each licence
    file as a whole, is compared with every template and every text of WHOLE by the cosine of their TF-IDF vectors; lines and
    runs without a signature word cannot reach a template's threshold and are left out first. A
    licence file that is WHOLE_THRESHOLD near to a whole licence has that one; else the best template of a file (ties: its
    name, then its place) gives own_license. 3. A file without one takes that of the licence file
    in the nearest directory above, its own first; of several there the best score, then the smallest path.
    Ancestors are made once for each distinct directory and joined by path.

    Null or empty text has no licence of its own; a null path has no directory and inherits nothing. Very long texts and
    lines are read whole. Repeated rows give repeated rows. Empty table, empty result. Templates are a bounded parameter;
    only their words' counts reach the driver.
    """
    spark = files.sparkSession
    words = vocabulary(templates)
    rows = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    named = F.coalesce(F.regexp_extract("path", r"[^/]*$", 0).rlike(LICENSE_FILE), F.lit(False))

    present = F.array_intersect(F.split(F.lower("text"), "[^a-z0-9]+"), F.array(*map(F.lit, words)))
    seen = rows.select(F.explode(F.concat(present, F.array(F.lit("")))).alias("word")).groupBy("word").count().collect()  # one row per word of the templates, and "" for each text
    df = {r["word"]: r["count"] for r in seen}
    idf = {w: math.log((1 + df.get("", 0)) / (1 + df.get(w, 0))) + 1 for w in words}
    rest = math.log(1 + df.get("", 0)) + 1
    unit = weights(templates, idf)
    names = [name for name, _ in (*templates, *WHOLE)]
    whole = [(len(templates) + k, w, x) for k, w, x in weights(WHOLE, idf, rest)]
    most = SPAN_LENGTH * max(len(tokens(text)) for _, text in templates)
    sign = "|".join(sorted(signature_words(unit, threshold)))

    line_sign = rf"(?<![a-z0-9])({sign})(?![a-z0-9])"
    slim = materialize(rows.select("doc_id", "path", named.alias("named"), F.when(named | F.lower("text").rlike(line_sign), F.col("text")).alias("text")).withColumn("rid", F.monotonically_increasing_id()), "files")
    lines = slim.select("rid", F.explode(F.split("text", "\n")).alias("line")).where(F.lower("line").rlike(line_sign))
    units = lines.unionByName(wrapped(slim, line_sign, most)).unionByName(slim.where("named and text is not null").select("rid", F.col("text").alias("line")))
    units = units.distinct()
    idf_rows = spark.createDataFrame([(w, x) for w, x in idf.items()], "word string, idf double")
    vectors = spark.createDataFrame([(t, names[t], w, x) for t, w, x in unit + whole], "template int, name string, word string, weight double")
    token = units.select("rid", "line", F.explode(F.regexp_extract_all(F.lower("line"), F.lit(f"({_TOKEN})"))).alias("word"))
    key = ["rid", F.xxhash64("line").alias("unit")]
    tf = token.select(*key, "word").groupBy("rid", "unit", "word").agg(F.count("*").alias("n"))
    tf = tf.join(F.broadcast(idf_rows), "word", "left").withColumn("x", F.col("n") * F.coalesce("idf", F.lit(rest)))
    own = Window.partitionBy("rid", "unit")
    tf = tf.withColumn("norm", F.sqrt(F.sum(F.col("x") * F.col("x")).over(own)))
    close = tf.join(F.broadcast(vectors), "word").groupBy("rid", "unit", "norm", "template", "name").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    close = close.select("rid", "template", "name", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)
    notice = (F.col("template") < len(templates)) | (F.col("score") < WHOLE_THRESHOLD)
    best = close.groupBy("rid").agg(F.min(F.struct(notice.alias("notice"), (-F.col("score")).alias("s"), "name", "template")).alias("b")).select("rid", F.col("b.name").alias("own_license"), (-F.col("b.s")).alias("own_score"))

    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    known = slim.drop("text").join(best, "rid", "left").withColumn("dir", F.when(F.col("path").contains("/"), directory).when(F.col("path").isNotNull(), F.lit("")))
    known = materialize(known, "own-licenses")
    given = known.where("named and own_license is not null and dir is not null").groupBy(F.col("dir").alias("above")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_license")).alias("g")).select("above", F.col("g.path").alias("license_path"), F.col("g.own_license").alias("license"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    chain = known.select("dir").where("dir is not null").distinct().select("dir", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), above))).alias("above"))
    nearest = chain.join(given, "above").groupBy("dir").agg(F.max_by(F.struct("license", "license_path"), F.length("above")).alias("near"))
    out = known.join(nearest, "dir", "left")
    return out.select("doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "near.license").alias("license"), F.when(F.col("own_license").isNotNull(), F.col("path")).otherwise(F.col("near.license_path")).alias("license_path"))


def document_files(docs: DataFrame) -> DataFrame:
    """Paths that documents stand for: source / package / module / file, one file in 25 being a LICENSE."""
    i = F.col("doc_id")
    name = F.when(i % 25 == 0, F.concat(F.lit("LICENSE."), i)).otherwise(F.concat(F.lit("f"), i, F.lit(".txt")))
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/p"), F.floor(i / 500), F.when(i % 25 == 0, F.lit("")).otherwise(F.concat(F.lit("/m"), F.floor(i / 50) % 10)), F.lit("/"), name)
    return docs.select("doc_id", path.alias("path"), "text")
