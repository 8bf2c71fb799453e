"""Licence scans: Dice coefficient over word bigrams against licence templates.

A text is judged line by line, as a whole, and by runs of words that a wrapped or
embedded notice may take. Dice >= t needs 2/3 of a template's
bigrams at t = 0.8, so of any larger third of them one must occur: each template
gives such a set of its longest bigrams, and units meet templates by an equi-join
on those, with the size bounds in the join. A scan for those bigrams comes first. All of it is DataFrame functions.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Templates are a small curated library; they are held as literals, so their number and length are bounded.
MAX_TEMPLATES, MAX_TEMPLATE_WORDS = 2000, 20_000

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_GPL3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."

#: (licence, text): texts and one-line notices in common use.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("BSD-2-Clause", _BSD2),
    ("Apache-2.0", _APACHE),
    ("GPL-3.0-or-later", _GPL3),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("proprietary", "All rights reserved."),
]


def normalised(text: Column) -> Column:
    """Lower case; every run of characters that are no letters or digits as one space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bigrams(text: Column) -> Column:
    """Distinct bigrams of a normalised text; none for fewer than two words."""
    words = F.split(text, " ")
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Sizes a set may have if its Dice coefficient with one of ``n`` elements reaches the threshold."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def _prepared(spark: SparkSession, templates: list[tuple[str, str]], threshold: float):
    """Templates as (bigram, template, ...) rows for the join, and the bigrams to scan for."""
    sets = [_template_bigrams(t) for _, t in templates]
    if len(templates) > MAX_TEMPLATES or any(len(s) > MAX_TEMPLATE_WORDS for s in sets):
        raise ValueError("more or longer templates than the library may hold")
    often = Counter(b for s in sets for b in s)
    rows, anchors = [], set()
    for i, ((licence, _), have) in enumerate(zip(templates, sets, strict=True)):
        if not have:
            continue
        low, high = size_bounds(len(have), threshold)
        # Of so many bigrams one must occur; long ones are the least likely to occur elsewhere.
        rare = sorted(have, key=lambda b: (-len(b), often[b], b))[: len(have) - low + 1]
        anchors.update(rare)
        rows += [(b, i, licence, have, len(have), low, high) for b in rare]
    return spark.createDataFrame(rows, "bigram string, template int, license string, have array<string>, n int, low int, high int"), sorted(anchors)


def _anchor_pattern(bigrams: list[str]) -> str:
    """A regular expression that is met wherever one of ``bigrams`` occurs, in lower-cased text as it is.

    It may also be met elsewhere, as ends of words and letters beyond ASCII aren't checked.

    Common beginnings are shared, so that most positions of a text cost one comparison.
    """

    def tree(rest: list[str]) -> str:
        if "" in rest:  # a shorter word covers the longer ones
            return ""
        heads = sorted({w[0] for w in rest})
        parts = [("[^a-z0-9]+" if h == " " else re.escape(h)) + tree([w[1:] for w in rest if w[0] == h]) for h in heads]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return f"[^a-z0-9]{tree(bigrams)}"


def _runs(texts: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """The best runs of words of each text, over line ends or within lines: ``doc_id, uid, first, last`` (lines) and the template.

    A run begins and ends with a bigram of its template and has at most twice as many
    bigrams as a set that can reach ``threshold``. Of runs that overlap the best is
    kept, ties going to the earlier template, then to the earlier run.
    """
    words = F.flatten(F.transform(F.split("text", "\n"), lambda x, i: F.transform(F.split(normalised(x), " "), lambda w: F.struct(w.alias("w"), (i + 1).alias("line")))))
    texts = texts.select("doc_id", F.monotonically_increasing_id().alias("uid"), F.filter(words, lambda x: x["w"] != "").alias("words")).where(F.size("words") > 1)
    texts = texts.select("doc_id", "uid", F.transform("words", lambda x: x["line"]).alias("lines"), F.transform("words", lambda x: x["w"]).alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b))
    texts = texts.select("doc_id", "uid", "lines", pairs.alias("pairs")).withColumn("own", F.array_distinct("pairs"))
    # A run in reach needs as many bigrams of the template as the smallest set in reach has.
    near = texts.join(F.broadcast(rows.drop("bigram").dropDuplicates(["template"])), F.size(F.array_intersect("own", "have")) >= F.col("low")).drop("own")
    near = near.withColumn("marked", F.transform("pairs", lambda x: F.concat(F.when(F.array_contains("have", x), "+").otherwise("-"), x))).drop("pairs", "have")
    starts = F.filter(F.transform("marked", lambda x, i: F.when(x.startswith("+"), i + 1)), lambda i: i.isNotNull())
    runs = near.select("*", F.explode(starts).alias("start")).withColumn("run", F.slice("marked", F.col("start"), 2 * F.col("high"))).drop("marked")
    # Bigrams by first occurrence: the k-th is where a run comes to k distinct ones.
    runs = runs.withColumn("own", F.array_distinct("run"))
    runs = runs.withColumn("hits", F.filter(F.transform("own", lambda x, i: F.when(x.startswith("+"), i + 1)), lambda i: i.isNotNull()))
    runs = runs.withColumn("best", F.array_max(F.transform("hits", lambda k, m: F.struct((2.0 * (m + 1) / (k + F.col("n"))).alias("dice"), (-k).alias("size"))))).where(F.col("best.dice") >= threshold)
    end = F.col("start") + F.array_position("run", F.element_at("own", -F.col("best.size"))).cast("int") - 1
    line = lambda at: F.element_at("lines", at)
    runs = runs.withColumn("end", end).select("doc_id", "uid", F.struct((-F.col("best.dice")).alias("least"), "template", "start", "end", line(F.col("start")).alias("first"), line(F.col("end") + 1).alias("last"), "license").alias("r"))
    apart = lambda kept, r: ~F.exists(kept, lambda k: (k["start"] <= r["end"]) & (r["start"] <= k["end"]))
    found = runs.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list("r")).alias("rs"))
    found = found.withColumn("kept", F.aggregate("rs", F.slice("rs", 1, 1), lambda kept, r: F.when(apart(kept, r), F.concat(kept, F.array(r))).otherwise(kept)))
    return found.select("doc_id", F.explode("kept").alias("r")).select("doc_id", "r.first", "r.last", "r.license", "r.template", (-F.col("r.least")).alias("dice"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", runs: bool = False) -> DataFrame:
    """Lines and whole texts, and with ``runs`` runs of words, whose Dice coefficient with a template reaches ``threshold``.

    Returns ``doc_id, line`` (from 1; 0 is the whole text), ``license, template, dice``
    of the best template, ties going to the earlier one. A run of words (see ``_runs``)
    counts where no unit of lines says it already: not if it lies in one line that
    has a row, or in a text that has one as a whole; its line is the one it begins
    in, which can have rows of several runs. Defined cases: null or empty
    texts and units of fewer than two words match nothing; a text of one line is
    judged as line 1 and as a whole; a text of any length is judged whole; repeated rows
    give one result; a null doc_id is kept; an empty table gives no rows; other columns
    are ignored. More than MAX_TEMPLATES templates, or one of more than
    MAX_TEMPLATE_WORDS distinct bigrams, are an error, as all are broadcast.
    """
    rows, anchors = _prepared(docs.sparkSession, TEMPLATES if templates is None else templates, threshold)
    if not anchors:
        rows, anchors = rows.limit(0), ["\0"]
    anchored = F.concat(F.lit(" "), F.lower(F.col("text"))).rlike(_anchor_pattern(anchors))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(anchored)
    units = texts.select("doc_id", F.posexplode(F.concat(F.array("text"), F.split("text", "\n"))).alias("line", "text")).where(anchored)
    units = units.select("doc_id", "line", bigrams(normalised(F.col("text"))).alias("own")).withColumn("size", F.size("own"))
    most = rows.agg(F.max("high")).first()[0] or 0
    met = units.where(F.col("size").between(1, most)).select("*", F.explode("own").alias("bigram")).join(F.broadcast(rows), "bigram").where(F.col("size").between(F.col("low"), F.col("high")))
    dice = F.lit(2.0) * F.size(F.array_intersect("own", "have")) / (F.col("size") + F.col("n"))
    scored = met.select("doc_id", "line", "template", "license", dice.alias("dice")).where(F.col("dice") >= threshold)
    best = F.max(F.struct("dice", (-F.col("template")).alias("first"), "license"))
    units = scored.groupBy("doc_id", "line").agg(best.alias("b")).select("doc_id", "line", F.col("b.license").alias("license"), (-F.col("b.first")).alias("template"), F.round("b.dice", 6).alias("dice"))
    if not runs:
        return units
    said = units.select(F.col("doc_id").alias("said_id"), F.col("line").alias("said_line"))
    within = F.col("doc_id").eqNullSafe(F.col("said_id")) & ((F.col("said_line") == 0) | ((F.col("said_line") == F.col("first")) & (F.col("first") == F.col("last"))))
    found = _runs(texts, rows, threshold).join(said, within, "left_anti")
    return units.unionByName(found.select("doc_id", F.col("first").alias("line"), "license", "template", F.round("dice", 6).alias("dice")).distinct())
