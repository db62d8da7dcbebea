"""Licence scans: whole normalised texts, and whole lines, looked up by digest."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable

#: Rows of a catalogue (licence, digest) that may be broadcast: about 5 MB.
MOST_KNOWN = 50_000

# Short licences and licence notices, as published.
LICENCES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "ISC": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
    ],
}
# The BSD licences' parts, as published.
_BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
]
# Titles that published files put before a text.
_TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'],
}


def _complete(known: dict[str, list[str]]) -> dict[str, list[str]]:
    """The catalogue with the BSD licences (numbered or not), the texts of ``licence_texts``, each also
    without what follows its terms, and the short texts under their titles."""
    out = {k: list(v) for k, v in known.items()}
    for name, conditions in (("BSD-2-Clause", _BSD[1:3]), ("BSD-3-Clause", _BSD[1:4])):
        numbered = [f"{i}. {x}" for i, x in enumerate(conditions, 1)]
        out[name] = ["\n".join([_BSD[0], *c, _BSD[4]]) for c in (conditions, numbered)]
    for name, titles in _TITLES.items():
        bodies = [t for t in out[name] if len(t) > 200]
        out[name] = [f"{title}\n{t}" for title in titles for t in bodies] + out[name]
    for file in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        text = file.read_text("utf-8")
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        out[file.stem] = out.get(file.stem, []) + list(dict.fromkeys([text, terms + end, terms]))
    return out


LICENCES = _complete(LICENCES)
# Spellings that licence matching treats as one; whole texts are rewritten alike on
# both sides, so the rewriting needs no word boundaries.
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("organis", "organiz"),
    ("authoris", "authoriz"),
    ("recognis", "recogniz"),
    ("judgement", "judgment"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("wilful", "willful"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
    ("whilst", "while"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\r©“”‘’–—…", "abcdefghijklmnopqrstuvwxyz\nc       "
MARKS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
# A line that states a copyright, with its year or the place for it before or after the name, or rights reserved.
COPYRIGHT = "^((copyright( c)?|c) [0-9]|copyright c |(c )?copyright .{0,100}(19|20)[0-9][0-9]( |$)|c .{0,100} (19|20)[0-9][0-9]( all rights reserved)?$|copyright (yyyy|year)( |$)|all rights reserved$)"


def normal_lines(text: Column) -> Column:
    """The text's lines, lowered (A-Z), each run of ASCII marks a space, spellings made equal,
    without empty lines and lines that state a copyright or reserved rights."""
    t = F.regexp_replace(F.translate(text, UPPER, LOWER), MARKS, " ")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(COPYRIGHT))


def licence_table(spark: SparkSession, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """(licence, digest) of the catalogue; its size is the catalogue's, whatever the input."""
    rows = [(k, t) for k, v in (texts or LICENCES).items() for t in v]
    known = spark.createDataFrame(rows, "licence string, text string")
    return known.select("licence", F.md5(F.array_join(normal_lines(F.col("text")), " ")).alias("digest")).distinct()


def scan_licences(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", most_known: int = MOST_KNOWN) -> DataFrame:
    """One row per document: the licence that its whole text is (whole_licence), those that whole
    lines of it are (licences, sorted, joined by a comma; n_licences of them), and text_digest.

    ``known`` is (licence, digest). Up to ``most_known`` rows of it are broadcast, and a document's lines
    are looked up where it is read; a larger table is joined by digest, with the same result. Null and
    empty texts match nothing; a text with no line left has the digest of the empty text and matches
    nothing; repeated rows each get their row; other columns are ignored, whatever their names.
    """
    known = (licence_table(docs.sparkSession) if known is None else known).select("licence", "digest").where("licence is not null and digest is not null").distinct()
    parts = docs.select(F.col(id_col).alias("_id"), normal_lines(F.coalesce(F.col(text_col), F.lit(""))).alias("_lines"))
    whole = parts.select("_id", F.md5(F.array_join("_lines", " ")).alias("text_digest"), F.array_distinct(F.transform("_lines", lambda x: F.md5(x))).alias("_digests"), F.size("_lines").alias("_n"))
    small = len(known.limit(most_known + 1).select(F.lit(1)).collect()) <= most_known
    entire = known.groupBy(F.col("digest").alias("text_digest")).agg(F.min("licence").alias("whole_licence"))
    if small:
        of = known.groupBy("digest").agg(F.collect_set("licence").alias("of"))
        one = of.agg(F.collect_list("digest").alias("_all"), F.map_from_entries(F.collect_list(F.struct("digest", "of"))).alias("_of"))  # one row of most_known digests
        rows = whole.crossJoin(F.broadcast(one)).withColumn("_hits", F.array_intersect("_digests", "_all"))
        rows = rows.withColumn("_set", F.array_sort(F.array_distinct(F.flatten(F.transform("_hits", lambda h: F.element_at("_of", h))))))
        rows = rows.select("_id", "text_digest", "_n", "_set").join(F.broadcast(entire), "text_digest", "left")
    else:
        whole = whole.withColumn("_key", F.monotonically_increasing_id())
        whole = durable(whole, "lines")  # read twice, normalised once
        hits = whole.select("_key", F.explode("_digests").alias("digest")).join(known, "digest").groupBy("_key").agg(F.array_sort(F.collect_set("licence")).alias("_set"))
        rows = whole.drop("_digests").join(entire, "text_digest", "left").join(hits, "_key", "left").withColumn("_set", F.coalesce("_set", F.array().cast("array<string>")))
    return rows.select(
        F.col("_id").alias(id_col),
        "text_digest",
        F.when(F.col("_n") > 0, F.col("whole_licence")).alias("whole_licence"),
        F.array_join("_set", ",").alias("licences"),
        F.size("_set").alias("n_licences"),
    )
