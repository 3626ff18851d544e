"""Licence scans by canonical digest: a text and each of its lines are normalised, digested and hash-joined to known licences.

Canonical form: lower case; copyright lines go, and a title in the first line; equivalent spellings become one; everything but
letters and digits becomes one space. So a licence is found whatever its case, punctuation, line breaks, title or copyright
holder. A copyright line begins with © or with "copyright" or "(c)" and a year (or a place for one), with "copyright" and the
other mark, or with "Copyright" and a capitalised holder; or it is "all rights reserved" alone. It goes up to its end, or to the
sentence of a licence that follows in it ("Copyright 2020 A. Person. Permission is hereby granted ..."). Lines that go on with the
words of a licence ("copyright notice and ...") stay. The units of a document are its whole text and each of its lines; a unit matches a licence if the whole
canonical texts are equal (SHA-256).

Defined cases: null and blank texts, and units without a letter or digit, match nothing and have a null digest; a licence
that occurs in several lines counts each time in n_notices and once in notices; null or repeated ids are rows like any other;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import picked, written

# Equivalent spellings, applied in this order to lower-case text.
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("whilst", "while"),
    ("http://", ""),
    ("https://", ""),
    ("&", " and "),
]
# What the sentences that follow a copyright notice begin with; copyright lines, for Java and Python alike; in the second, no word that licences use after "copyright" is a holder.
_OPENERS = "permission is hereby|permission to use|redistribution and use|licen[sc]ed under|released under|this work is licen[sc]ed|this software is|the software is"
# Up to the line's end, or to a sentence of the licence that follows in the same line.
_REST = rf"[^\n]*?(?=(?<=\.)[ \t]+(?i:{_OPENERS})|(?![^\n]))"
COPYRIGHT = [
    r"(?im)^[ \t]*(?:copyright[ \t:,-]*(?:\(c\)|©|(?:19|20)\d\d\b|[<\[{(]?(?:year|yyyy)\b)|©|\(c\)[ \t]*(?:copyright\b|(?:19|20)\d\d\b|[<\[{(]?(?:year|yyyy)\b)|all rights reserved[^\w\n]*(?=\n|$))" + _REST,
    r"(?m)^[ \t]*(?:Copyright|COPYRIGHT)[ \t]+(?:by[ \t]+|BY[ \t]+)?(?!(?i:(?:notice|holder|owner|law|licen[sc]e|permission|statement|disclaimer|interest|claim|patent|treat(?:y|ie)|act|right|protection|infringement)s?|and|or|in|on|is|are|of|to|for|as|by|from|under|with|that|which|this|shall|may|be)\b)[A-Z]" + _REST,
]
# A title in the first line, before other lines.
TITLE = r"\A\s*(?:the )?(?:mit|expat|isc|modified bsd|new bsd|simplified bsd|bsd(?: [23]-clause)?(?: \"(?:new|revised|simplified)\"(?: or \"(?:new|revised)\")?)?|[23]-clause bsd) licen[sc]e(?: \((?:mit|expat|isc)\))?[:.]?[ \t\r]*\n"
OWNER = r"copyright(\s+)owner"
# What a copyright line begins with in the SQL, which tells the two kinds of line apart less well.
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
OTHER = r"[^\p{L}\p{N}]+"
OTHER_IN_LINE = r"[^\p{L}\p{N}\n]+"

#: Whole licences that are too long for this file.
TEXTS = Path(__file__).parent / "texts"
#: Known licences that are broadcast, at most.
BROADCAST = 100_000

# Known notices and short licences, also in the SQL.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        'included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE.",
    ),
]

BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
]


def whole_texts() -> list[tuple[str, str]]:
    """Whole licences: BSD with numbered and with bulleted conditions, Apache and GPL with their appendix and without."""
    out = []
    for name, conditions in (("BSD-2-Clause", BSD[1:3]), ("BSD-3-Clause", BSD[1:4])):
        out += [(name, "\n".join([BSD[0], *(f"{mark(k)} {x}" for k, x in enumerate(conditions, 1)), BSD[4]])) for mark in (lambda k: f"{k}.", lambda k: "*")]
    for name in ("Apache-2.0", "GPL-3.0"):
        text = (TEXTS / f"{name}.txt").read_text()
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        out += [(name, text), (name, terms + end), (name, terms)]
    return out


def canonical_lines(text: Column) -> Column:
    """The text with each line in canonical form but for spaces at its ends."""
    out = text
    for pattern in COPYRIGHT:
        out = F.regexp_replace(out, pattern.replace("[A-Z]", r"\p{Lu}"), " ")
    out = F.regexp_replace(F.regexp_replace(F.lower(out), TITLE, " "), OWNER, "copyright$1holder")
    for pattern, other in SPELLINGS:
        out = F.replace(out, F.lit(pattern), F.lit(other))
    return F.regexp_replace(out, OTHER_IN_LINE, " ")


def digest_of(text: str) -> str:
    """The same for one text on the driver; for ASCII texts such as KNOWN."""
    out = text
    for pattern in COPYRIGHT:
        out = re.sub(pattern, " ", out)
    out = re.sub(OWNER, r"copyright\1holder", re.sub(TITLE, " ", out.lower()))
    for pattern, other in SPELLINGS:
        out = out.replace(pattern, other)
    return hashlib.sha256(re.sub(r"[^a-z0-9]+", " ", out).strip().encode()).hexdigest()


def known_digests(texts: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return sorted({(digest_of(text), name) for name, text in texts})


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_digest, license (of the whole text), notices (of lines, sorted), n_notices.

    known: (digest, license); joined by hash, broadcast if it has `BROADCAST` rows at most.
    """
    if known is None:
        known = docs.sparkSession.createDataFrame(known_digests(KNOWN + whole_texts()), "digest string, license string")
    known = known.groupBy("digest").agg(F.min("license").alias("license"))
    known = known.select(F.unhex("digest").alias("digest"), "license")
    if known.limit(BROADCAST + 1).count() <= BROADCAST:
        known = F.broadcast(known)
    rows = picked(docs, doc_id=id_col, text=text_col).select("doc_id", F.monotonically_increasing_id().alias("row"), canonical_lines(F.col("text")).alias("form"))
    parts = rows.select("doc_id", "row", F.filter(F.transform(F.split("form", "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("lines"))
    sha = lambda x: F.unhex(F.sha2(x.cast("binary"), 256))
    # The texts are read and normalised once; the digests are what both joins read.
    found = written(parts.select("doc_id", "row", F.when(F.size("lines") > 0, sha(F.array_join("lines", " "))).alias("whole"), F.transform("lines", sha).alias("units")), "digests")
    units = found.select(F.col("row").alias("of"), F.explode("units").alias("digest"))
    notices = units.join(known, "digest").groupBy("of").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"), F.count("*").alias("n_notices"))
    out = found.select("doc_id", "row", "whole").join(known.withColumnRenamed("digest", "whole"), "whole", "left").join(notices, F.col("row") == F.col("of"), "left")
    return out.select("doc_id", F.lower(F.hex("whole")).alias("text_digest"), "license", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def oracle_sql() -> str:
    def form(x: str) -> str:
        out = f"regexp_replace(lower({x}), '{COPYRIGHT_LINE}', ' ', 'g')"
        for pattern, other in SPELLINGS:
            out = f"replace({out}, '{pattern}', '{other}')"
        return f"trim(regexp_replace({out}, '{OTHER}', ' ', 'g'))"

    values = ", ".join(f"('{d}', '{name}')" for d, name in known_digests(KNOWN))
    return f"""
    WITH known(digest, license) AS (VALUES {values}),
    whole AS (SELECT doc_id, text, {form("text")} AS form FROM documents),
    lines AS (SELECT doc_id, {form("line")} AS form FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
    notices AS (
      SELECT doc_id, array_to_string(list_sort(list_distinct(list(license))), ',') AS notices, count(*) AS n_notices
      FROM lines JOIN known ON sha256(form) = digest WHERE form <> '' GROUP BY doc_id)
    SELECT w.doc_id, CASE WHEN form <> '' THEN sha256(form) END AS text_digest, license, coalesce(notices, '') AS notices,
           coalesce(n_notices, 0) AS n_notices
    FROM whole w LEFT JOIN known k ON form <> '' AND sha256(form) = k.digest LEFT JOIN notices n ON n.doc_id = w.doc_id
    """
