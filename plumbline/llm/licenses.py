"""Licence scan by canonical digests.

A text is brought into a canonical form: A-Z in lower case, copyright lines left out,
equivalent spellings made one, punctuation and white space turned into single spaces.
The MD5 of that form is looked up in the digests of known licences by a hash join.
Two kinds of entire texts are looked up: the whole document, and each of its lines,
since notices of one line stand inside longer texts.

Only DataFrame functions are used.  The known texts are a parameter whose size the
caller sets, so their digests are broadcast; documents are not shuffled for the lookup,
and only lines that match go on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import ascii_lower

# Spellings that licence matching treats as equal.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("centre", "center"), ("emphasised", "emphasized"),
    ("favour", "favor"), ("fulfilment", "fulfillment"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"),
    ("licence", "license"), ("noncommercial", "non-commercial"), ("organisation", "organization"),
    ("organise", "organize"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("sub-license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"),
    ("wilful", "willful"), ("copyright holder", "copyright owner"),
)

_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
          "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
          "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
          "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
          "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
          "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD_AS_IS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
              "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES "
              "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
              "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
              "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
              "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
              "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
              "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN "
              "ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
              "DAMAGE.")
_ISC_GRANT = ("Permission to use, copy, modify, and/or distribute this software for any purpose with "
              "or without fee is hereby granted")
_ISC_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD "
              "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN "
              "NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
              "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
              "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
              "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_BSD_2 = ("Redistribution and use in source and binary forms, with or without modification, are "
          "permitted provided that the following conditions are met:\n"
          "1. Redistributions of source code must retain the above copyright notice, this list of "
          "conditions and the following disclaimer.\n"
          "2. Redistributions in binary form must reproduce the above copyright notice, this list of "
          "conditions and the following disclaimer in the documentation and/or other materials "
          "provided with the distribution.\n")
_BSD_3 = ("3. Neither the name of the copyright holder nor the names of its contributors may be used "
          "to endorse or promote products derived from this software without specific prior written "
          "permission.\n")

# Public licence texts and the usual one-line notices.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy "
            "of this software and associated documentation files (the \"Software\"), to deal in the "
            "Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
            "to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions:\nThe above copyright notice and this permission notice shall be included in "
            "all copies or substantial portions of the Software.\n" + _AS_IS),
    ("ISC", "ISC License\n" + _ISC_GRANT + ", provided that the above copyright notice and this "
            "permission notice appear in all copies.\n" + _ISC_AS_IS),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_AS_IS),
    ("BSD-2-Clause", _BSD_2 + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_AS_IS),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)

#: A line that only states who holds the rights.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}]*(copyright [^\p{L}]*[0-9]|copyright ?\(c\)|\(c\) ?[0-9]|©|all rights reserved[^\p{L}\p{N}]*$)"


def canonical_line(line: Column) -> Column:
    """The canonical form of one line; empty for a copyright line."""
    low = ascii_lower(line)
    spelt = low
    for other, one in SPELLINGS:
        spelt = F.replace(spelt, F.lit(other), F.lit(one))
    any_of = "|".join(other for other, _ in SPELLINGS)
    spelt = F.when(low.rlike(any_of), spelt).otherwise(low)
    plain = F.trim(F.regexp_replace(spelt, r"[^\p{L}\p{N}]+", " "))
    return F.when(low.rlike(COPYRIGHT_LINE), F.lit("")).otherwise(plain)


def _lines(text: Column) -> Column:
    found = F.array_remove(F.transform(F.split(text, "\n", -1), canonical_line), "")
    return F.coalesce(found, F.array().cast("array<string>"))


#: Spellings of several words, as canonical lines have them: a line end may part their words.
ACROSS = tuple((other.replace("-", " "), one.replace("-", " ")) for other, one in SPELLINGS
               if " " in other.replace("-", " "))


def whole_text(lines: Column) -> Column:
    """The canonical form of a whole text, however its lines are wrapped."""
    joined = F.array_join(lines, " ")
    for other, one in ACROSS:
        joined = F.replace(joined, F.lit(other), F.lit(one))
    return joined


def known_digests(docs: DataFrame, known: Sequence[tuple[str, str]]) -> DataFrame:
    """Digest and licence name of every known text, one row per digest (first name wins)."""
    rows = [(i, name, text) for i, (name, text) in enumerate(known)]
    texts = docs.sparkSession.createDataFrame(rows, "i int, licence string, text string")
    digest = F.md5(whole_text(_lines(F.col("text"))))
    return (texts.select(digest.alias("digest"), F.struct("i", "licence").alias("x"))
            .groupBy("digest").agg(F.min("x")["licence"].alias("licence")))


def scan_licenses(docs: DataFrame, known: Sequence[tuple[str, str]] = KNOWN) -> DataFrame:
    """Look up every whole text and every line of ``docs`` in the known licences.

    Returns doc_id, digest (of the canonical whole text), licence (of the whole text, or
    null) and notices (licences of single lines, distinct, sorted, comma-joined, or null).
    A null or empty text has the digest of the empty string and no licence, unless a known
    text is empty as well.  Repeated rows are each returned; rows with a null doc_id too.
    Other columns are not looked at.  No documents give no rows.
    """
    digests = F.broadcast(known_digests(docs, known))  # as many rows as the parameter has
    lines = docs.select("doc_id", _lines(F.col("text")).alias("lines"))
    whole = stored(lines.select("doc_id", F.md5(whole_text(F.col("lines"))).alias("digest"),
                                F.transform("lines", F.md5).alias("lines")))
    hits = (whole.select("doc_id", F.col("digest").alias("text_digest"),
                         F.explode("lines").alias("digest"))
            .join(digests, "digest").groupBy("doc_id", "text_digest")
            .agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices"))
            .withColumnRenamed("doc_id", "hit_id"))
    named = whole.drop("lines").join(digests, "digest", "left")
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("text_digest"))
    return (named.join(hits, same, "left")
            .select("doc_id", "digest", "licence", "notices"))
